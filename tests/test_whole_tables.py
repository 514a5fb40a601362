"""Queries that once took a part of their table: plan and SQL read all of it."""

from collections import Counter

import numpy as np

from lyrebird.load import segments
from lyrebird.operators.speakers import pair_similarities
from lyrebird.plans import registry
from tests.test_oracle import duck, rows  # noqa: F401


def equal_without(spark, duck, folder, name, part):  # noqa: F811
    """The query gives the rows of its SQL, which doesn't hold the filter ``part``."""
    sql = registry.oracle_sql()[name]
    assert part not in sql
    got, want = registry.queries()[name](spark, folder), duck.sql(sql)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_pair_similarities_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(k), [float(x) for x in (rng.standard_normal(6) + 1) * (i % 17 > 0)]) for i, k in enumerate(rng.integers(18, 25, 300))]
    data += [(900, 77, [1.0] * 6), (901, None, [1.0] * 6), (902, 20, None)]
    got = {r.label: r for r in pair_similarities(spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").repartition(5), "label", "embedding").collect()}
    by = {}
    for _, k, v in data[:300]:
        by.setdefault(k, []).append(np.float32(v).astype(float))
    assert set(got) == set(by) and max(by) >= 20
    for k, vs in by.items():
        cos = [0.0 if not a.any() or not b.any() else a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, a in enumerate(vs) for b in vs[i + 1 :]]
        assert got[k].n_pairs == len(cos)
        assert abs(got[k].mean - np.mean(cos)) < 1e-9 and abs(got[k].deviation - np.std(cos)) < 1e-9


def test_pairwise_threshold_takes_every_vector(spark, medium):
    n = Counter(r.label for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect())
    got = {r.label: r.n_pairs for r in registry.queries()["vector_pairwise_threshold"](spark, medium).collect()}
    assert got == {k: c * (c - 1) // 2 for k, c in n.items() if c > 1}


def test_pairwise_threshold_equals_sql_over_all_vectors(spark, duck, medium):  # noqa: F811
    equal_without(spark, duck, medium, "vector_pairwise_threshold", "WHERE a.vec_id % 20 = a.label AND b.vec_id % 20 = b.label")


def test_speaker_margin_labels_every_vector(spark, duck, medium):  # noqa: F811
    assert registry.queries()["speaker_margin"](spark, medium).count() == spark.read.parquet(f"{medium}/embeddings.parquet").count()
    equal_without(spark, duck, medium, "speaker_margin", " WHERE vec_id % 10 = 0")


def test_close_captions_keep_every_segment(spark, duck, medium):  # noqa: F811
    out = registry.queries()["close_caption_merge"](spark, medium)
    n = Counter(r.media_id for r in segments(spark, medium).collect())
    got = Counter()
    for r in out.collect():
        got[r.media_id] += r.n_rows
    assert got == n
    equal_without(spark, duck, medium, "close_caption_merge", "seq % 3 <> 1")
    assert max(n.values()) <= 3 or out.count() > len(n)


def test_chunk_hash_covers_every_segment(spark, duck, medium):  # noqa: F811
    assert registry.queries()["chunk_hash"](spark, medium).count() == spark.read.parquet(f"{medium}/conversations.parquet").count()
    equal_without(spark, duck, medium, "chunk_hash", " WHERE seq = 0")
