"""Rules with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lyrebird.functions import keys, quality
from lyrebird.operators import answer, monitor, search, speakers, views
from tests.test_functions import one


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("availability", "title", "want"),
    [
        ("unlisted", "a", True),
        ("private", "a", False),
        ("subscriber_only", None, True),
        ("public", "Q&A MEMBERS EXCLUSIVE", True),
        (None, "An early access cut", True),
        (None, "Patreon Exclusive: one", True),
        (None, "How to join this channel", False),
        (None, "membership news", False),
        (None, None, False),
    ],
)
def test_members_only(spark, availability, title, want):
    assert one(spark, quality.members_only(F.col("a"), F.col("t")), a=text(availability), t=text(title)) is want


def test_titles_and_messages(spark):
    t = F.col("t")
    for title, want in (("A long CHAT", True), ("Debate night", True), ("Q&A", False), ("Small talks", True), (None, False)):
        assert one(spark, quality.interview(t), t=text(title)) is want
    for message, want in (("ERROR: Membership required here", True), ("This video is available to members only.", True), ("404", False), (None, False)):
        assert one(spark, quality.members_only_error(t), t=text(message)) is want


@pytest.mark.parametrize(
    ("label", "logprob", "compression", "want"),
    [
        ("PRIMARY", -0.55, 2.4, "good_quality"),
        ("PRIMARY", -0.56, 1.0, "low_quality"),
        ("PRIMARY", -0.1, 2.41, "low_quality"),
        ("GUEST", -0.8, 2.6, "good_quality"),
        ("GUEST", -0.56, 2.41, "good_quality"),
        ("GUEST", -0.81, 1.0, "low_quality"),
        ("GUEST", -0.1, 2.61, "low_quality"),
        ("Unknown", -3.0, 9.0, "good_quality"),
        (None, -3.0, 9.0, "good_quality"),
    ],
)
def test_quality_label(spark, label, logprob, compression, want):
    assert one(spark, quality.quality_label(F.col("l"), F.col("p"), F.col("c")), l=text(label), p=logprob, c=compression) == want


def test_display_name_falls_back_to_the_label(spark):
    rows = [("PRIMARY",), ("GUEST",), ("Bob",), (None,)]
    df = spark.createDataFrame(rows, "speaker_label string").withColumns({"start_sec": F.lit(1.0), "end_sec": F.lit(3.0), "avg_logprob": F.lit(0.0), "compression_ratio": F.lit(1.0)})
    assert [r.speaker_display_name for r in views.segments_with_metadata(df).collect()] == ["Primary speaker", "Guest", "Bob", None]


def test_provenance_rank(spark):
    ranks = [one(spark, search.provenance_rank(F.col("p")), p=text(p)) for p in ("owner", "yt_caption", None, "yt_dlp", "whisper", "other")]
    assert ranks == [1, 2, 2, 3, 4, 5]


@pytest.mark.parametrize(
    ("kind", "url", "sid", "want"),
    [
        (None, "https://zoom.us/1", "x", "youtube"),
        ("", "u", "x", "youtube"),
        ("", "https://zoom.us/1", None, "zoom"),
        ("local_file", "https://www.youtube.com/watch", "x", "youtube"),
        ("local_file", None, "youtube_1", "youtube"),
        ("youtube", "u", "zoom_1", "zoom"),
        ("youtube", "https://www.youtube.com/zoom", "x", "zoom"),
        ("local_file", "https://youtu.be/x", "local_1", "local_file"),
        ("zoom", "https://www.youtube.com/", "x", "youtube"),
    ],
)
def test_source_type_repair(spark, kind, url, sid, want):
    assert one(spark, keys.repaired_source_type(F.col("k"), F.col("u"), F.col("i")), k=text(kind), u=text(url), i=text(sid)) == want


def test_attribution_by_raw_margin_without_cap(spark):
    profiles = spark.createDataFrame([("p", [1.0, 0.0], 0.6), ("q", [1.0, 0.35], 0.6), ("r", [1.0, 0.35], 0.6), ("high", [0.0, 1.0], 1.04)], "name string, centroid array<double>, threshold double")
    clusters = spark.createDataFrame([(0, 20.0, [1.0, 0.0]), (1, 20.0, [1.0, 0.17]), (2, 11.0, [0.0, 1.0]), (3, 10.0, [0.0, 1.0]), (4, 6.0, [1.0, 0.0])], "cluster int, seconds double, centroid array<double>")
    got = {r.cluster: r for r in speakers.attribute_clusters(clusters, profiles).collect()}
    assert [got[i].label for i in range(5)] == ["p", "Unknown", "high", "Unknown", "p"]  # 3: 1.02 is below 1.04
    assert got[0].similarity == pytest.approx(1.05) and got[4].similarity == pytest.approx(1.02)
    assert got[0].second == pytest.approx(1 / (1 + 0.35**2) ** 0.5)
    alone = speakers.attribute_clusters(clusters, profiles.filter("name = 'q' or name = 'r'")).filter("cluster = 0").first()
    assert alone.label == "q" and alone.second is None


def test_recommended_mode(spark):
    items = spark.createDataFrame([(i, None if i == 0 else 600.0) for i in range(12)], "i int, duration_s double")
    mode = lambda n, **k: monitor.recommend_mode(items.filter(F.col("i") < n), "i", **k).first()
    assert mode(5).mode == "cloud_api" and mode(0).mode == "cloud_api" and mode(0).hours == 0
    row = mode(12)  # first ten: (1800 + 9 * 600) / 10 = 720 s; 12 of them are 2.4 h, 0.864 of cost
    assert (row.avg_s, row.hours, row.cost, row.gpu_hours, row.mode) == (720.0, pytest.approx(2.4), pytest.approx(0.864), pytest.approx(0.3), "local_gpu")
    assert mode(12, most_cost=0.8, gpu=False).mode == "local_gpu"
    assert mode(12, gpu=False).mode == "cloud_api"
    assert mode(8).mode == "cloud_api" and mode(8, key=False).mode == "local_gpu"
    assert mode(12, local_backlog=False).mode == "cloud_api"


def state(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("done", at(1, 0), 10, None, 60.0), ("done", at(1, 12), None, None, 180.0), ("done", at(3, 0), 20, None, None), ("error", at(3, 1), 5, "boom", 9.0), ("error", at(3, 2), 5, "boom", 9.0), ("error", at(2, 0), 5, None, 9.0)]
    return spark.createDataFrame(rows, "status string, updated_at timestamp, chunk_count int, last_error string, duration_s double").withColumns({"has_captions": F.col("chunk_count").isNotNull(), "has_recognised": F.lit(False)})


def test_processing_rates(spark):
    row = monitor.processing_rates(state(spark)).first()  # 48 hours from the first to the last that is done
    assert (row.n_items, row.n_chunks, row.hours, row.per_hour, row.chunks_per_hour) == (3, 30, 48.0, 0.06, 0.63)
    assert monitor.processing_rates(state(spark).limit(1)).first().per_hour is None
    assert monitor.processing_rates(state(spark).limit(0)).first().n_items == 0


def test_report_quota_and_alerts(spark):
    as_of = F.expr("TIMESTAMP '2024-01-03 03:00:00'")
    report = monitor.metrics_report(state(spark), as_of)
    got = {(r.section, r.name): r.value for r in report.collect()}
    assert got["status", "done"] == 3 and got["errors", "boom"] == 2 and len([k for k in got if k[0] == "errors"]) == 1
    assert got["last_day", "items"] == 1 and got["last_day", "chunks"] == 20
    assert got["sources", "captions_pct"] == 66.7 and got["durations", "median_s"] == 120.0 and got["durations", "mean_s"] == 120.0
    assert (got["quota", "n_items"], got["quota", "units"], got["quota", "quota_pct"]) == (3, 126, 1.3)
    assert [tuple(r) for r in monitor.alerts(report).collect()] == [("warning", "error rate", 50.0)]
    busy = spark.range(191).select(F.lit("done").alias("status"), F.expr("TIMESTAMP '2024-01-03 02:00:00'").alias("updated_at"))
    row = monitor.quota(busy, as_of).first()  # 191 * 42 units
    assert (row.n_items, row.units, row.quota_pct, row.alert) == (191, 8022, 80.2, True)
    assert monitor.quota(busy.limit(190), as_of).first().alert is False


def test_impact(spark):
    assert [one(spark, monitor.impact(F.col("p")), p=p) for p in (70.1, 70.0, 50.1, 50.0)] == ["high", "medium", "medium", "low"]


def test_transcript_without_segments(spark):
    issues = quality.transcript_issues(F.col("t"), F.col("s"))
    assert one(spark, issues, t=text(None), s=0.0) == ["no_content"]
    assert one(spark, quality.transcript_score(issues), t=text(None), s=0.0) == 0
    assert one(spark, quality.needs_upgrade(issues), t=text(None), s=0.0) is True


def test_prompt_lines_hold_whole_texts(spark):
    long = "x" * 900
    df = spark.createDataFrame([("v", 75.0, "T", long, 1), ("v", 5.0, None, "b", 2), ("w", 0.0, "U", None, 3)], "id string, start_sec double, title string, text string, i int")
    got = {r.id: r for r in answer.prompt_package(df, "id", F.asc("i"), "i", 3, title="title").collect()}
    assert got["v"].prompt == f"1. [T - v @ 1:15]: {long}\n\n2. [Unknown Video - v @ 0:05]: b"
    assert got["v"].citations == ["v@1:15", "v@0:05"] and got["w"].prompt == "1. [U - w @ 0:00]: "
    assert answer.prompt_package(df, "id", F.asc("i"), "i", 1, text_chars=4).filter("id = 'v'").first().prompt == "1. [Unknown Video - v @ 1:15]: xxxx"


def test_speaker_figures(spark):
    df = spark.createDataFrame([("a", 0.0, 3.0, 0.5, True, None), ("a", 3.0, 4.0, 0.9, None, [1.0]), ("Unknown", 4.0, 8.0, None, False, [2.0])], "speaker_label string, start_sec double, end_sec double, speaker_conf double, re_asr boolean, embedding array<double>")
    got = {r.speaker_label: r for r in speakers.speaker_stats(df).collect()}
    assert (got["a"].n_segments, got["a"].share_pct, got["a"].min_conf, got["a"].max_conf, got["a"].avg_conf, got["a"].n_refined, got["a"].n_embedded) == (2, 50.0, 0.5, 0.9, 0.7, 1, 1)
    assert got["Unknown"].avg_conf is None and got["Unknown"].n_embedded == 1
    q = spark.createDataFrame([("a", -0.4, 1.0, 0.1), ("Unknown", None, 2.4, 0.3), ("a", 0.0, None, 0.2)], "speaker_label string, avg_logprob double, compression_ratio double, no_speech_prob double")
    row = speakers.quality_means(q).first()
    assert (row.n_segments, row.n_low_conf, row.n_unknown) == (3, 2, 1) and row.low_conf_pct == pytest.approx(200 / 3)
    assert row.avg_logprob_mean == pytest.approx(-0.4 / 3) and row.compression_ratio_mean == pytest.approx(4.4 / 3) and row.no_speech_prob_mean == pytest.approx(0.2)
    s = spark.createDataFrame([("p", 0.62), ("p", 0.6), ("p", None)], "k string, similarity double")
    row = speakers.threshold_share(s, "k").first()
    assert (row.n, row.least, row.most, row.above_pct) == (2, 0.6, 0.62, 50.0)


def test_progress_and_percent(spark):
    rate, eta = monitor.progress(F.col("d"), F.col("t"), F.col("m"))
    assert (one(spark, rate, d=30, t=90, m=10.0), one(spark, eta, d=30, t=90, m=10.0)) == (3.0, 20.0)
    assert one(spark, eta, d=0, t=90, m=10.0) is None and one(spark, rate, d=3, t=9, m=0.0) is None
    assert [one(spark, quality.percent_text(F.col("s")), s=s) for s in (0.874, -0.8756, 1.0, 0.0)] == ["87.4", "87.6", "100.0", "0.0"]
