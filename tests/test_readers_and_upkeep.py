"""Readers of listings, seeds, meetings and urls; other sinks; upkeep of tables."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import segments as seg, store, views
from lyrebird.sources import listings, sinks, subtitles
from tests.test_store_and_sources import VTT


def test_listing_in_latin_1(spark, tmp_path):
    line = lambda i, t: json.dumps({"id": i, "title": t}, ensure_ascii=False)
    (tmp_path / "a.jsonl").write_bytes((line("a", "Café") + "\n\nnot json\n" + line("b", "x") + "\n").encode("latin-1"))
    (tmp_path / "b.jsonl").write_bytes((line("c", "Café 天") + "\r\n" + line("d", None)).encode())
    assert sorted((r.video_id, r.title) for r in listings.read_listing(spark, str(tmp_path)).collect()) == [("a", "Café"), ("b", "x"), ("c", "Café 天")]


def test_seed_files(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"sources": [{"url": "b", "note": 1}, {"url": "a"}]}, indent=1))
    (r,) = listings.read_seeds(spark, str(good)).collect()
    assert r.seed_hash == hashlib.md5(json.dumps(["a", "b"]).encode()).hexdigest()
    for name, text in (("none", "{}"), ("empty", '{"sources": []}'), ("nourl", '{"sources": [{"url": "a"}, {"x": 1}]}'), ("broken", "{")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            listings.read_seeds(spark, str(tmp_path / name))


def test_url_lists_and_meetings(spark):
    lines = spark.createDataFrame([("# list",), ("",), ("https://youtu.be/abcdefghij_",), (" abcdefghij_ ",), ("https://example.com",), ("https://www.youtube.com/watch?v=ABCDEFGHIJK&t=1",)], "value string")
    assert sorted(r.video_id for r in listings.url_list(lines).collect()) == ["ABCDEFGHIJK", "abcdefghij_"]
    raw = spark.createDataFrame(
        [("m1", "T", dt.datetime(2024, 1, 1), 2, [("MP4", "x", "u1", None), ("TRANSCRIPT", "audio_transcript", "u2", None)]), ("m2", "U", None, 3, [("MP4", "x", "u", None)])],
        listings.MEETINGS,
    )
    (r,) = listings.meetings(raw).collect()
    assert (r.source_id, r.duration_s, r.transcript_url) == ("m1", 120, "u2")


def test_vtt_entries(spark):
    files = spark.createDataFrame([("m.vtt", VTT)], "path string, value string")
    rows = subtitles.entries(subtitles.vtt_cues(files)).orderBy("start").collect()
    assert [(r.start, round(r.duration, 3), r.text) for r in rows] == [(1.0, 1.0, "Hello there"), (2.9, 1.1, "again you")]


def test_vtt_words_summary_and_ledger(spark, tmp_path):
    s = spark.createDataFrame([("m", 1, 2.0, 3.5, "GUEST", "b"), ("m", 0, 0.0, 2.0, "PRIMARY", "a")], "media_id string, seq int, start_sec double, end_sec double, speaker_label string, text string")
    assert sinks.vtt(s, "PRIMARY").first().value == "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\n<v PRIMARY><b>a</b>\n\n00:00:02.000 --> 00:00:03.500\n<v GUEST>b\n"
    assert sinks.summary(s).first().value == "2 segments, 3.5 s, 2 speakers"
    words = sinks.word_json(s.withColumnRenamed("text", "word")).first().value
    assert [w["word"] for w in json.loads(words)] == ["a", "b"]
    for status in ("done", "failed"):
        sinks.append_ledger(spark.createDataFrame([("k", status, dt.datetime(2024, 1, 1))], "key string, status string, at timestamp"), str(tmp_path / "ledger"))
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["done", "failed"]
    sinks.write_report(s, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_compact_reset_analyse(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(8).write.parquet(many)
    assert views.compact(spark, many) == 1
    assert spark.read.parquet(many).count() == 1000 and len(list((tmp_path / "many").glob("*.parquet"))) == 1
    spark.range(1000).write.parquet(few)
    with pytest.raises(ValueError):
        views.reset(spark, few, "other")
    views.reset(spark, few, few)
    assert spark.read.parquet(few).count() == 0 and spark.read.parquet(few).columns == ["id"]
    spark.sql(f"CREATE TABLE upkeep USING parquet LOCATION '{many}'")
    try:
        views.analyse(spark, "upkeep")
        stats = spark.sql("DESCRIBE EXTENDED upkeep").filter("col_name = 'Statistics'").first().data_type
        assert "1000 rows" in stats
    finally:
        spark.sql("DROP TABLE upkeep")


def test_work_lists(spark):
    state = spark.createDataFrame([(1, dt.datetime(2024, 1, 9), "pending", None), (2, dt.datetime(2024, 1, 8), "error", "local_gpu"), (3, dt.datetime(2024, 1, 8), "done", None), (4, dt.datetime(2024, 1, 1), "pending", None), (5, dt.datetime(2024, 1, 9), "error", "cloud_api")], "i int, created_at timestamp, status string, processing_method string")
    got = store.recent_unprocessed(state, F.expr("TIMESTAMP '2024-01-10'"), 7, "local_gpu", 10, "i").collect()
    assert [r.i for r in got] == [1, 5]
    assert [r.i for r in store.next_unprocessed(state, state.filter("i = 1"), "i", 2, F.asc("i")).collect()] == [2, 3]
    rows = spark.createDataFrame([(1, None), (1, 7), (2, None), (None, None)], "k int, ref int")
    parents = spark.createDataFrame([(1, 10), (3, 30)], "pk int, id int")
    assert sorted(map(str, store.fill_from(rows, parents, "k", "pk", "ref", "id").collect())) == sorted(map(str, [rows.first().__class__(k=1, ref=10)] + [r for r in rows.collect() if (r.k, r.ref) != (1, None)]))


def test_refined_spans(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", -1.0, 2.0, False, True) for i in range(5)], "media_id int, seq int, text string, avg_logprob double, compression_ratio double, re_asr boolean, needs_refinement boolean")
    new = spark.createDataFrame([(1, 1, 3, 1, "b", -0.2, 1.5), (1, 1, 3, 0, "a", -0.4, 1.1)], "media_id int, first_seq int, last_seq int, part int, text string, avg_logprob double, compression_ratio double")
    got = [(r.seq, r.text, r.avg_logprob, r.compression_ratio, r.re_asr, r.needs_refinement, r.merged_into) for r in seg.replace_spans(df, new).orderBy("seq").collect()]
    assert got == [
        (0, "t0", -1.0, 2.0, False, True, None),
        (1, "a b", -0.2, 1.1, True, False, None),
        (2, "", -1.0, 2.0, True, False, 1),
        (3, "", -1.0, 2.0, True, False, 1),
        (4, "t4", -1.0, 2.0, False, True, None),
    ]


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, 0.0, 6.0, 1.0), (2, 1.0, 4.0, 1.0), (3, 0.0, 2.9, 1.0), (4, 0.0, 60.0, 0.0), (5, 0.0, 60.0, None)], "i int, start_sec double, end_sec double, energy double")
    got = [(r.i, r.window_start, r.window_end) for r in seg.sliding_windows(df, F.col("energy") > 0.5).orderBy("i", "window_start").collect()]
    assert got == [(1, 0.0, 3.0), (1, 1.5, 4.5), (1, 3.0, 6.0), (2, 1.0, 4.0)]
