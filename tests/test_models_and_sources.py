"""Batch rerankers, embedding by batches, sums of hot keys, scalar subqueries, database reads."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.functions.keys import video_id_of_file
from lyrebird.operators import embed, rerank, speakers, vector_search, views
from lyrebird.plans import search_plans

TEXTS = ["Alpha beta alpha", "", None, "  ", "é Ünder beta\tgamma\n", "x " * 5000]


def test_hashing_vectors_equal_a_plain_program(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {r.id: r.embedding for r in embed.embed(rows).collect()}
    for i, t in enumerate(TEXTS):
        words = t.lower().split() if t else []
        if not words:
            assert got[i] is None
            continue
        v = np.zeros(64)
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        assert np.allclose(got[i], v / (np.sqrt(v @ v) or 1), atol=1e-6)
    assert embed.embed(rows.limit(0)).collect() == []


def brute(pairs, model, k):
    out = []
    for q in {p[0] for p in pairs}:
        own = [(1 / (1 + np.exp(-model([p[2] or ""], [p[3] or ""])[0])), p[1]) for p in pairs if p[0] == q]
        out += [(q, n, turn, round(s, 9)) for n, (s, turn) in enumerate(sorted(own, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("model", [rerank.overlap, rerank.pair_model([0.1, 2.0, -1.0, 3.0, -0.5])()])
def test_rerank_each_equals_brute_force(spark, model):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(12)]
    pairs = [(int(q), i, f"w{q} w{q + 1} Other", " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for i, q in enumerate(rng.integers(0, 6, 700))]
    pairs += [(3, 900, "w3 w4 Other", None), (9, 901, None, "w1"), (3, 902, "w3 w4 Other", "w3 w4 other")]
    df = spark.createDataFrame(pairs, "q int, turn int, query string, text string").repartition(4)
    got = sorted((r.q, r.rank, r.turn, round(r.rerank_score, 9)) for r in rerank.rerank_each(df, "q", "turn", 4, lambda: model).collect())
    assert got == brute(pairs, model, 4)
    assert rerank.rerank_each(df.limit(0), "q", "turn", 4, lambda: model).collect() == []


def test_model_is_loaded_once_a_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return rerank.overlap

    df = spark.range(30_000).select(F.lit("a b").alias("query"), F.lit("b").alias("text")).coalesce(1)
    assert rerank.score_pairs(df, load).agg(F.sum("rerank_score")).first()[0] == pytest.approx(15_000)
    assert loads.value == 1


def test_pair_model_tells_turns_of_a_conversation(spark, medium):
    """Fitted on even conversations, measured on odd ones."""
    pairs = search_plans._opening_pairs(spark, medium)
    other = pairs.select((F.col("conv_id") - 1).alias("conv_id"), "text").join(pairs.select("conv_id", "query").distinct(), "conv_id")
    labelled = pairs.select("conv_id", "query", "text", F.lit(1).alias("label")).unionByName(other.select("conv_id", "query", "text", F.lit(0).alias("label")))
    weights = rerank.fit_pairs(labelled.filter("conv_id % 2 = 0"))
    assert weights == rerank.fit_pairs(labelled.filter("conv_id % 2 = 0").repartition(7))
    scored = rerank.score_pairs(labelled.filter("conv_id % 2 = 1"), rerank.pair_model(weights)).toPandas()
    good, bad = (scored.rerank_score[scored.label == v].to_numpy() for v in (1, 0))
    area = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert area > 0.75
    assert rerank.fit_pairs(labelled.filter("label = 1")) == [0.0] * 5


def test_sums_of_hot_keys_are_dealt_and_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(i, "hot" if i % 3 else f"k{i % 40}", [float(x) for x in (rng.standard_normal(5) + 0.5) * (i % 19 > 0)]) for i in range(900)]
    df = spark.createDataFrame(data, "vec_id int, label string, embedding array<float>").repartition(6)
    plain = {r.label: r for r in speakers.pair_similarities(df, "label", "embedding").collect()}
    monkeypatch.setattr(speakers, "KEY_ROWS", 50)
    dealt = {r.label: r for r in speakers.pair_similarities(df, "label", "embedding").collect()}
    assert set(plain) == set(dealt) and plain["hot"].n_pairs == 600 * 599 // 2
    for k, r in plain.items():
        vs = [np.float32(v).astype(float) for _, key, v in data if key == k]
        cos = [0.0 if not a.any() or not b.any() else a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, a in enumerate(vs) for b in vs[i + 1 :]]
        for got in (r, dealt[k]):
            assert (got.n_pairs, got.mean, got.deviation) == (len(cos), pytest.approx(np.mean(cos)), pytest.approx(np.std(cos)))
    assert speakers.pair_similarities(df.limit(0), "label", "embedding").collect() == []


@pytest.mark.parametrize("measure", ["cosine", "l2"])
def test_search_by_scalar_subquery(spark, medium, measure):
    e = spark.read.parquet(f"{medium}/embeddings.parquet")
    got = vector_search.top_k_like(e, 3, 10, measure=measure)
    want = vector_search.top_k(e, vector_search.vector_of(e, 3), 10, measure=measure)
    assert [(r.vec_id, round(r.score, 9)) for r in got.collect()] == [(r.vec_id, round(r.score, 9)) for r in want.collect()]
    assert vector_search.top_k_like(e, -1, 10, measure=measure).collect() == []


def test_database_table_is_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    rows = spark.range(1000).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).alias("TWICE"), F.concat(F.lit("t"), "id").alias("NAME"))
    rows.write.jdbc(url, "ITEMS", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = views.read_jdbc(spark, url, "ITEMS", "ID", 100, 900, 5, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", fetchsize=100)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i, f"t{i}") for i in range(1000)]  # rows outside the bounds are read too
    assert got.filter("ID < 10").select("NAME").count() == 10
    plan = got.filter("ID < 10").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(ID,10)" in plan


def test_ids_of_file_names(spark):
    names = {"/a/b/dQw4w9WgXcQ.mp4": "dQw4w9WgXcQ", "talk [dQw4w9WgXcQ].srt": "dQw4w9WgXcQ", "/x/plain name.v2.vtt": "plain name.v2", "twelve_chars.srt": "twelve_chars", "": ""}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", video_id_of_file(F.col("n")).alias("id")).collect()
    assert {r.n: r.id for r in got} == names


def test_shares_of_speakers_do_not_hang_on_the_order_of_rows(spark):
    """Three lengths whose sum in doubles depends on its order: ones beside 2^53 are lost, unless they come first."""
    rows = [("m", 0.0, 2.0**53, "B"), ("m", 1.0, 2.0, "C"), ("m", 2.0, 3.0, "A")]
    got = set()
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(order, "media_id string, start_sec double, end_sec double, speaker_label string").coalesce(1)
        got.add(tuple(sorted(speakers.speaker_map(df, "media_id").first().shares.items())))
    lengths = {k: e - s for _, s, e, k in rows}
    total = lengths["B"] + lengths["C"] + lengths["A"]
    assert got == {tuple(sorted((k, 100.0 * v / total) for k, v in lengths.items()))}
