"""Ordered scans: exact on many ranges, wide rows and hot keys."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import cluster, intervals, store
from lyrebird.operators.scan import ranked, running_sum, spread


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """600,000 wide rows in 16 files, in no order."""
    folder = tmp_path_factory.mktemp("wide")
    rng = np.random.default_rng(1)
    ids = rng.permutation(600_000).astype(np.int64)
    cost = rng.integers(0, 100, ids.size)
    texts = np.array([f"text {i} " * 8 for i in range(997)], object)
    for f, part in enumerate(np.array_split(np.arange(ids.size), 16)):
        pq.write_table(pa.table({"i": ids[part], "cost": cost[part], "text": texts[ids[part] % 997], "other": ids[part] * 3}), folder / f"{f}.parquet")
    return str(folder)


@pytest.mark.parametrize("partitions", [None, 5, 37])
def test_batches_of_many_wide_rows(spark, wide, partitions):
    got = store.batches(spark.read.parquet(wide), "i", 1000, partitions)
    assert got.columns == ["i", "cost", "text", "other", "batch_no"]
    assert got.filter("batch_no <> floor(i / 1000) or other <> 3 * i").count() == 0
    sizes = got.groupBy("batch_no").count()
    assert sizes.count() == 600 and sizes.filter("count <> 1000").count() == 0


@pytest.mark.parametrize("partitions", [None, 11])
def test_budget_in_the_middle_of_many_rows(spark, wide, partitions):
    want = duckdb.sql(f"SELECT count(*), sum(i), max(i) FROM (SELECT i, coalesce(sum(cost) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM '{wide}/*.parquet') WHERE s < 15000000").fetchall()[0]
    kept = store.within_budget(spark.read.parquet(wide), ["i"], "cost", 15_000_000, partitions=partitions)
    assert tuple(kept.agg(F.count("*"), F.sum("i"), F.max("i")).first()) == want
    assert 200_000 < want[0] < 400_000


def test_ranges_are_frozen(spark, wide):
    ranges = spread(spark.read.parquet(wide), ["i"], 9)
    first, second = (sorted(map(tuple, ranges.groupBy("_p").agg(F.min("i"), F.max("i"), F.count("*"), F.max("_pos")).collect())) for _ in range(2))
    assert first == second and len(first) > 4
    assert all(n == top + 1 for *_, n, top in first)
    assert all(a[2] < b[1] for a, b in zip(first, first[1:]))


def test_ranks_and_sums_of_odd_tables(spark):
    none = spark.createDataFrame([], "k string, v long")
    assert ranked(none, ["k"], "r").collect() == [] and running_sum(none, ["k"], "v", "s").collect() == []
    rows = [("b", 2), (None, 5), ("a", None), ("b", 2), ("c", 1)]
    got = running_sum(spark.createDataFrame(rows, "k string, v long"), ["k", "v"], "v", "s", 3).collect()
    assert sorted((str(r.k), r.s) for r in got) == [("None", 0), ("a", 5), ("b", 5), ("b", 7), ("c", 9)]
    assert sorted(r.n for r in ranked(spark.createDataFrame(rows, "k string, v long"), ["k", "v"], "n", 3).collect()) == list(range(5))


@pytest.fixture(scope="module")
def hot():
    """Timed rows: nine tenths of them of one key, some of no key, with equal and nested spans and null bounds."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(6000):
        key = "hot" if i % 10 else [None, "a", "b", "c"][i // 10 % 4]
        start = float(rng.integers(0, 40_000)) / 4
        end = start + float(rng.choice([0.0, 0.25, 0.5, 2.0, 9.0, 300.0], p=[0.1, 0.3, 0.3, 0.2, 0.09, 0.01]))
        out.append((key, i, start, None if i % 97 == 0 else end, ["x", "y", None][int(rng.integers(0, 3))]))
    return out


def frame(spark, hot):
    return spark.createDataFrame(hot, "k string, i int, start_sec double, end_sec double, who string").repartition(7)


def by_key(hot):
    keys = {}
    for r in hot:
        keys.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[1])) for k, v in keys.items()}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_clusters_of_a_hot_key_equal_a_walk(spark, hot, partitions):
    df = frame(spark, hot)
    gaps, unions, paras = {}, {}, {}
    for rows in by_key(hot).values():
        g = u = p = 0
        far = None
        for n, r in enumerate(rows):
            last = rows[n - 1]
            g += not n or last[3] is None or r[2] - last[3] > 1.0
            u += far is None or r[2] - far > 1.0
            p += not n or last[4] is None or r[4] is None or last[4] != r[4]
            far = r[3] if far is None else far if r[3] is None else max(far, r[3])
            gaps[r[1]], unions[r[1]], paras[r[1]] = g, u, p
    for want, got in (
        (gaps, cluster.gap_clusters(df, "k", "i", 1.0, partitions=partitions)),
        (unions, cluster.span_unions(df, "k", "i", 1.0, partitions=partitions)),
    ):
        assert {r.i: r.cluster for r in got.collect()} == want
    order = {r[1]: n for rows in by_key(hot).values() for n, r in enumerate(rows)}
    placed = df.join(spark.createDataFrame(list(order.items()), "i int, n int"), "i")
    assert {r.i: r.cluster for r in cluster.paragraphs(placed, "k", "n", "who", partitions=partitions).collect()} == paras


def test_a_hot_key_lies_in_many_ranges(spark, hot):
    sizes = [r["count"] for r in spread(frame(spark, hot), ["k", "start_sec", "i"], 40).groupBy("_p").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 0.06 * len(hot)


@pytest.mark.parametrize("partitions", [1, 40])
def test_overlaps_equal_all_pairs(spark, hot, partitions):
    want = {}
    for rows in by_key(hot).values():
        whole = [r for r in rows if r[3] is not None]
        s, e, i = (np.array([r[c] for r in whole]) for c in (2, 3, 1))
        over = np.minimum(e[:, None], e[None]) - np.maximum(s[:, None], s[None]) > 0.3
        np.fill_diagonal(over, False)
        want |= {r[1]: False for r in rows} | dict(zip(i.tolist(), over.any(axis=1).tolist()))
    got = {r.i: r.is_overlap for r in intervals.overlapping(frame(spark, hot), "k", "i", partitions=partitions).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_overlap_of_nested_and_equal_spans(spark):
    rows = [("a", 1, 0.0, 10.0), ("a", 2, 1.0, 2.0), ("a", 3, 20.0, 21.0), ("a", 4, 20.0, 21.0), ("a", 5, 21.0, 22.0), ("a", 6, 21.8, 23.0), ("b", 1, 0.0, 10.0), ("b", 2, None, 5.0)]
    df = spark.createDataFrame(rows, "k string, i int, start_sec double, end_sec double")
    got = {(r.k, r.i): r.is_overlap for r in intervals.overlapping(df, "k", "i").collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): True, ("a", 4): True, ("a", 5): False, ("a", 6): False, ("b", 1): False, ("b", 2): False}
