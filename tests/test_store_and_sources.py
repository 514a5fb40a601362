"""Keyed writes, file readers and sinks, and the incremental job."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import store
from lyrebird.sources import listings, sinks, subtitles
from lyrebird.streaming import ingest

SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> &amp;lt;\nworld\n\n2\n00:00:03,000 --> 00:00:04,000\n\nx\n00:00:05,000 --> 00:00:06,000\nno number\n\n"
VTT = "WEBVTT\n\n00:01.000 --> 00:02.000\nHello there\n\ncue-2\n00:00:02.900 --> 00:00:04.000\nagain <b>you</b>\n\n00:05.500 --> 00:06.000\n[Music]\n\n00:07.000 --> 00:07.500\nok\n"


def test_upsert_is_idempotent_and_keeps_old_values(spark):
    old = spark.createDataFrame([(1, "a", "{\"x\":1}"), (2, "b", None)], "k int, title string, metadata string")
    new = spark.createDataFrame([(1, None, "{}"), (3, "c", "{\"y\":2}")], "k int, title string, metadata string")
    once = store.upsert(old, new, ["k"])
    want = [(1, "a", "{\"x\":1}"), (2, "b", None), (3, "c", "{\"y\":2}")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert(once, new, ["k"]).collect())) == want
    always = store.upsert(old, new, ["k"], always=("title",)).collect()
    assert {r.k: r.title for r in always} == {1: None, 2: "b", 3: "c"}


def test_replaced_children_leave_no_stale_rows(spark):
    old = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "p int, i int")
    new = spark.createDataFrame([(1, 0)], "p int, i int")
    assert sorted(map(tuple, store.replace_children(old, new, "p").collect())) == [(1, 0), (2, 0)]


def test_queue_ttl_and_batches(spark):
    state = spark.createDataFrame([(1, "error", 2), (2, "pending", 0), (3, "error", 3), (4, "done", 0)], "i int, status string, retries int")
    assert [r.i for r in store.pending_queue(state, 5, "i").collect()] == [2, 1]
    rows = spark.createDataFrame([(1, None), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:01")], "i int, e string").withColumn("e", F.col("e").cast("timestamp"))
    assert sorted(r.i for r in store.unexpired(rows, "e", F.expr("TIMESTAMP '2024-01-01'")).collect()) == [1, 3]
    got = {r.id: r.batch_no for r in store.batches(spark.range(1000).repartition(7), "id", 64).collect()}
    assert got == {i: i // 64 for i in range(1000)}


def test_integrity_counts(spark):
    parents = spark.createDataFrame([(1,), (2,)], "p int")
    children = spark.createDataFrame([(1, 1), (1, 1), (9, 2), (None, 3)], "p int, u int")
    assert tuple(store.integrity(parents, children, "p", "p", ["u"]).first()) == (4, 1, 1, 1)


def test_srt_reader_strict_and_lenient(spark, tmp_path):
    (tmp_path / "talk abcdefghij_ x.srt").write_text(SRT.replace("\n", "\r\n"), newline="")
    strict = subtitles.read_srt(spark, str(tmp_path)).collect()
    assert [(r.media_id, r.start_sec, r.end_sec, r.text) for r in strict] == [("abcdefghij_", 1.0, 2.5, "Hello &lt; world")]
    texts = sorted(r.text for r in subtitles.read_srt(spark, str(tmp_path), lenient=True).collect())
    assert texts == ["Hello &lt; world", "no number"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.srt", SRT)
        z.writestr("readme.txt", "no")
    assert [(r.media_id, r.text) for r in subtitles.read_zipped_srt(spark, str(tmp_path)).collect()] == [("one", "Hello &lt; world")]


def test_vtt_reader_and_caption_merge(spark, tmp_path):
    (tmp_path / "v.vtt").write_text(VTT)
    rows = subtitles.read_vtt(spark, str(tmp_path))
    assert sorted((r.start_sec, r.text) for r in rows.collect()) == [(1.0, "Hello there"), (2.9, "again you")]
    merged = subtitles.merged_captions(rows).collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in merged] == [(1.0, 4.0, "Hello there again you")]


def test_listing_reader_skips_broken_lines(spark, tmp_path):
    lines = [json.dumps({"id": "a", "title": "T", "upload_date": "20240102", "duration": "61.0", "thumbnails": [{"url": "x"}, {"url": "y"}]}), "", "not json", json.dumps({"id": "b", "title": None})]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    (r,) = listings.read_listing(spark, str(tmp_path / "l.jsonl")).collect()
    assert (r.video_id, str(r.published_at), r.duration_s, r.thumbnail, r.url) == ("a", "2024-01-02 00:00:00", 61, "y", "https://www.youtube.com/watch?v=a")


def test_api_pages_local_files_and_profiles(spark, tmp_path):
    page = {"items": [{"id": "v1", "snippet": {"title": "t", "publishedAt": "2024-01-01T00:00:00Z"}, "contentDetails": {"duration": "PT2M"}, "statistics": {"viewCount": "7"}}, {"id": "v2", "snippet": {"title": "live"}, "liveStreamingDetails": {"actualStartTime": "2024-01-01T00:00:00Z"}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = listings.api_videos(spark.read.schema(listings.API_PAGE).json(str(tmp_path / "p.json"))).collect()
    assert [(r.video_id, r.duration_s, r.view_count) for r in got] == [("v1", 120, 7)]
    media = tmp_path / "media" / "sub"
    media.mkdir(parents=True)
    (media / "a.MP4").write_bytes(b"x")
    (media / "b.txt").write_bytes(b"x")
    (r,) = listings.local_media(spark, str(tmp_path / "media")).collect()
    assert r.video_id.startswith("local_") and len(r.video_id) == 17
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.json").write_text("")
    with pytest.raises(FileNotFoundError):
        listings.read_profiles(spark, str(empty))


def test_sinks(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.5, "A", "one"), (1, 1, 1.5, 2.0, "A", "two"), (1, 2, 2.0, 3.0, "B", "three")], "media_id long, seq int, start_sec double, end_sec double, speaker_label string, text string")
    value = lambda f: f(s).first().value
    assert value(sinks.srt).startswith("1\n00:00:00,000 --> 00:00:01,500\none\n\n2\n")
    assert value(sinks.vtt).startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v A>one")
    assert value(sinks.speaker_text) == "A: one two\n\nB: three\n"
    assert len(json.loads(value(sinks.full_json))["segments"]) == 3
    assert value(sinks.summary) == "3 segments, 3.0 s, 2 speakers"


def test_incremental_ingest_takes_files_once(spark, tmp_path):
    schema = "k int, v string, at timestamp"
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, t string").select("k", "v", F.col("t").cast("timestamp").alias("at"))
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    rows((1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01")).coalesce(1).write.parquet(land)
    ingest.ingest(spark, land, schema, out, check, ["k"], "at").awaitTermination()
    rows((2, None, "2024-01-03"), (3, "d", "2024-01-03")).coalesce(1).write.mode("append").parquet(land)
    ingest.ingest(spark, land, schema, out, check, ["k"], "at").awaitTermination()
    got = {r.k: r.v for r in ingest.read_current(spark, out, spark.createDataFrame([], schema).schema).collect()}
    assert got == {1: "b", 2: "c", 3: "d"}
    assert ingest.versions(spark, out) == [0, 1]


def test_streamed_dedupe_and_windowed_counts(spark, tmp_path):
    rows = [("h1", "ok", "2024-01-01 00:10:00"), ("h1", "ok", "2024-01-01 00:10:00"), ("h2", "bad", "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "h string, status string, t string").select("h", "status", F.col("t").cast("timestamp").alias("updated_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = ingest.deduplicated(stream, "h", "updated_at")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = ingest.status_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.status, r.n) for r in spark.table("counts").collect()) == [("bad", 1), ("ok", 2)]


def test_cells_find_what_the_full_scan_finds(spark, medium):
    from lyrebird.load import table
    from lyrebird.operators import vector_search as vs

    e = table(spark, medium, "embeddings")
    q = vs.vector_of(e, 3)
    centres = vs.fit_cells(e, 8, 3)
    cells = vs.assign_cells(e, centres)
    assert cells.count() == e.count()
    full = {r.vec_id for r in vs.top_k(e, q, 10).collect()}
    assert {r.vec_id for r in vs.probe(cells, centres, q, 10, 8).collect()} == full
    assert len({r.vec_id for r in vs.probe(cells, centres, q, 10, 3).collect()} & full) >= 5


def test_batches_rewrite_touched_buckets_and_retire_old_ones(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, at int"
    merge = ingest.upsert_batches(path, ["k"], "at", buckets=8)
    rows = lambda *r: spark.createDataFrame(r, schema)
    current = lambda: sorted((r.k, r.v) for r in ingest.read_current(spark, path, rows((0, "", 0)).schema).collect())
    merge(rows(*((i, "a", 1) for i in range(40))), 0)
    held = {b: v for b, v in ingest._buckets(spark, path).items()}
    assert len(held) == 8
    merge(rows((1, "b", 2), (1, "old", 1)), 1)
    merge(rows((1, None, 3), (99, "n", 3)), 2)
    merge(rows((1, None, 3), (99, "n", 3)), 2)  # run again
    assert current() == [(i, "b" if i == 1 else "a") for i in range(40)] + [(99, "n")]
    after = ingest._buckets(spark, path)
    assert sum(len(v) for v in after.values()) <= 8 + 2 and max(map(len, after.values())) <= 2
    assert sum(v == [0] for v in after.values()) >= 6  # untouched buckets stay where they are
    merge(rows((1, "z", 4)).limit(0), 3)
    assert current()[1] == (1, "b")


def test_budget_of_a_whole_run(spark):
    rows = [(i, float(i % 7)) for i in range(500)]
    got = sorted(r.i for r in store.within_budget(spark.createDataFrame(rows, "i int, cost double").repartition(5), ["i"], "cost", 100.0).collect())
    want, spent = [], 0.0
    for i, c in rows:
        if spent < 100.0:
            want.append(i)
        spent += c
    assert got == want
