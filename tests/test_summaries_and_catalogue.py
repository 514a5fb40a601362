"""Tree summaries against a plain recursive program; functions of the catalogue against their DataFrame forms."""

import random

import pytest
from pyspark.sql import functions as F

from lyrebird.functions import catalogue, keys, text, time
from lyrebird.load import segments
from lyrebird.operators import segments as seg
from lyrebird.operators import summarise
from lyrebird.sources import subtitles

WORDS = "spark rows shuffle plan a. the! of stage? task data".split()


def tree(w, fn, size, most):
    """(summary, calls, words read, rounds) of a list of words."""
    if len(w) <= size:
        return fn(" ".join(w), most), 1, len(w), 1
    parts = [w[i : i + size] for i in range(0, len(w), size)]
    made = [x for i, p in enumerate(parts) for x in f"PART {i + 1}: {fn(' '.join(p), most)}".split()]
    summary, calls, read, rounds = tree(made, fn, size, most)
    return summary, calls + len(parts), read + len(w), rounds + 1


def items():
    """(item, no, text): one item holds most rows, others none, one word, exactly one block, one word more; nulls, blanks and a null item."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [("hot", i, some(rng.randrange(0, 9))) for i in range(700)] + [("hot", 700, some(900))]
    rows += [("none", 0, None), ("none", 1, " \t "), ("one", 0, "spark"), ("block", 0, some(40)), ("more", 0, some(40)), ("more", 1, some(1)), ("two", 1, some(80)), (None, 0, some(55))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("name", "fn"), [("lead", lambda t, n: " ".join(t.split()[:n])), ("salient", summarise.salient_sentences)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_tree_equals_recursive_program(spark, name, fn, partitions):
    df = spark.createDataFrame(items(), "item string, no int, text string").repartition(5).withColumn("block", F.lit(1)).withColumn("summary", F.lit("x"))
    got = {r["item"]: (r.summary, r.n_calls, r.words_read, r.n_rounds, r.n_words) for r in summarise.tree_summaries(df, "item", ["no"], name, 40, 9, partitions=partitions).collect()}
    of = {}
    for k, _, t in sorted(items(), key=lambda r: (str(r[0]), r[1])):
        of.setdefault(k, []).extend((t or "").split())
    assert got == {k: (*tree(w, fn, 40, 9), len(w)) for k, w in of.items() if w}
    assert got["hot"][3] >= 4 and got["block"][1] == 1 and got["more"][1] == 3


def test_tree_of_nothing_and_failures(spark, monkeypatch):
    empty = spark.createDataFrame([], "item string, no int, text string")
    assert summarise.tree_summaries(empty, "item", ["no"]).count() == 0
    with pytest.raises(ValueError):
        summarise.tree_summaries(empty, "item", ["no"], words=10, most=5)
    df = spark.createDataFrame([("a", 0, "bad " * 40 + "good " * 40), ("b", 0, "bad")], "item string, no int, text string")
    monkeypatch.setitem(summarise.SUMMARISERS, "fails", lambda t, n: F.when(~t.startswith("bad"), summarise.lead(t, n)))
    got = {r["item"]: r.summary for r in summarise.tree_summaries(df, "item", ["no"], "fails", 40, 9).collect()}
    assert got == {"a": "PART 1: [ERROR] PART 2: good good good good", "b": None}
    monkeypatch.setitem(summarise.SUMMARISERS, "long", lambda t, n: t)
    with pytest.raises(Exception, match="over 9 words"):
        summarise.tree_summaries(df, "item", ["no"], "long", 40, 9)


def test_only_blocks_are_gathered(spark):
    """A text of 200,000 words in one row and one of as many rows: no block holds more than its words."""
    df = spark.range(20_000).select(F.lit("rows").alias("item"), F.col("id").alias("no"), F.repeat(F.lit("w "), 10).alias("text"))
    df = df.unionByName(spark.range(1).select(F.lit("text").alias("item"), F.col("id").alias("no"), F.repeat(F.lit("w "), 200_000).alias("text")))
    got = {r["item"]: r for r in summarise.tree_summaries(df, "item", ["no"], "lead", 1000, 100, partitions=8).collect()}
    assert got["rows"].asDict() | {"item": ""} == got["text"].asDict() | {"item": ""}
    assert got["rows"].n_words == 200_000 and got["rows"].n_calls == 200 + 21 + 3 + 1


@pytest.fixture(scope="module")
def catalogued(spark):
    names = catalogue.register(spark)
    assert {"video_id", "word_blocks", "cues", "duration_chunks"} <= set(names)
    assert all(spark.catalog.functionExists(n) for n in names)
    return spark


def same(spark, sql, forms, schema, values):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    df.createOrReplaceTempView("catalogue_values")
    a = spark.sql(f"SELECT {', '.join(sql)} FROM catalogue_values").collect()
    b = df.select(*forms).collect()
    assert sorted(map(str, (tuple(r) for r in a))) == sorted(map(str, (tuple(r) for r in b)))


def test_scalar_functions_equal_their_columns(catalogued):
    t, x = F.col("t"), F.col("x")
    urls = ["https://a.b/watch?v=abcdefghijk&t=3s", "https://youtu.be/abcdefghijk", "abcdefghijk", "nothing", "", None]
    same(catalogued, ["video_id(t)", "base_url(t)", "deep_link(t, 75.9, 'youtube')", "deep_link(t, 0, 'youtube')"], [keys.video_id(t), keys.base_url(t), keys.deep_link(t, F.lit(75.9), F.lit("youtube")), keys.deep_link(t, F.lit(0.0), F.lit("youtube"))], "t string", urls)
    same(catalogued, ["m_ss(x)", "cue_time(x, ',')", "cue_time(x, '.')"], [time.m_ss(x), time.cue_time(x), time.cue_time(x, ".")], "x double", [0.0, 5.25, 59.9996, 75.0, 3599.999, 3600.5, 359999.5, 400000.123, None])
    same(catalogued, ["parse_m_ss(t)", "parse_cue_time(t)"], [time.parse_m_ss(t), time.parse_cue_time(t)], "t string", ["1:15", "1:1:1", "00:01:02,500", "01:02.5", " 2:00:00.07 ", "x", "", None])
    texts = ["a  b\tc", "", " ", None, "a text of more than twenty characters", "a text of more than twenty characters ends. ", "x\n\ny " * 9]
    same(catalogued, ["word_count(t)", "token_estimate(t)", "clean_segment(t)", "chunk_hash(t, 1.5, 2, t)"], [text.word_count(t), text.token_estimate(t), text.clean_segment(t), keys.chunk_hash(t, F.lit(1.5), F.lit(2.0), t)], "t string", texts)


def test_word_blocks_table_function(catalogued, medium):
    catalogued.read.parquet(f"{medium}/documents.parquet").createOrReplaceTempView("catalogue_documents")
    got = catalogued.sql("SELECT d.doc_id, b.block, b.text FROM catalogue_documents d, LATERAL word_blocks(d.text, 100) b")
    want = catalogued.table("catalogue_documents").select("doc_id", F.posexplode(text.word_blocks(F.col("text"), 100)).alias("block", "text"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert "Python" not in got._jdf.queryExecution().toString()


def test_cues_table_function(catalogued):
    files = ["1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i> &amp; bye\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nnext\n", "00:01.5 --> 00:02.5\r\nno number\r\n\r\n", "7\n00:00:01,000 --> 00:00:02,000\n\n8\nbad --> worse\ntext\n", "", None]
    df = catalogued.createDataFrame([(f"f{i}.srt", f) for i, f in enumerate(files)], "path string, value string")
    df.createOrReplaceTempView("catalogue_files")
    got = catalogued.sql("SELECT f.path, c.* FROM catalogue_files f, LATERAL cues(f.value) c ORDER BY path, seq").collect()
    assert [tuple(r) for r in got] == [("f0.srt", 0, 1.0, 2.5, "Hi & bye there"), ("f0.srt", 1, 3.0, 4.0, "next"), ("f1.srt", 0, 1.5, 2.5, "no number")]
    clean = df.withColumn("value", F.regexp_replace("value", "\r\n?", "\n"))
    read = subtitles.cues(clean, lenient=True).select("start_sec", "end_sec", "text").orderBy("start_sec", "text").collect()
    assert [tuple(r) for r in read] == sorted(tuple(r)[2:] for r in got)


def test_duration_chunks_table_function(catalogued, medium):
    s = segments(catalogued, medium)
    s.select("media_id", "seq", "start_sec", "end_sec", "text").createOrReplaceTempView("catalogue_segments")
    got = catalogued.sql("SELECT * FROM duration_chunks(TABLE(catalogue_segments) PARTITION BY media_id ORDER BY (start_sec, seq), 45D)")
    want = seg.duration_chunks(s).select(*got.columns)
    assert got.count() == want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
