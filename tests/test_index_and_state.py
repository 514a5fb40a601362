"""The stored vector index, and streams with state against batch queries of the same rows."""

import glob
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lyrebird.functions import vector
from lyrebird.operators import vector_index
from lyrebird.operators.vector_search import top_k
from lyrebird.streaming import stateful


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """3000 vectors around 60 directions, in an index of the ruled number of lists; a third of them is added later."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((60, 24))
    data = [(i, [float(x) for x in middle[i % 60] * rng.uniform(0.5, 2) + rng.standard_normal(24) * 0.4], i % 7) for i in range(3000)]
    data += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, other int").repartition(6)
    path = str(tmp_path_factory.mktemp("index")) + "/ivf"
    n = vector_index.build(df.filter("vec_id % 3 <> 0"), path)
    before = set(glob.glob(f"{path}/rows/**/*.parquet", recursive=True))
    vector_index.add(df.filter("vec_id % 3 = 0"), path)
    return df, path, n, before


def test_lists_rule(index):
    assert [vector_index.lists_for(n) for n in (0, 9_999, 10_201, 1_000_000)] == [100, 100, 101, 1000]
    assert index[2] == 100


def test_adding_touches_no_stored_file(index):
    df, path, _, before = index
    now = set(glob.glob(f"{path}/rows/**/*.parquet", recursive=True))
    assert before < now


def test_every_row_is_in_one_list(spark, index):
    df, path, n, _ = index
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == df.count() == rows.select("vec_id").distinct().count()
    assert {r.vec_id for r in rows.filter("list = -1").collect()} == {5000, 5001, 5002}


def test_full_probe_is_exact_and_recall_is_high(spark, index):
    df, path, n, _ = index
    hits = 0
    for q in range(0, 200, 20):
        query = [float(x) for x in df.filter(F.col("vec_id") == q).first().embedding]
        exact = [(r.vec_id, r.score) for r in top_k(df.filter("vec_id < 5000"), query, 10).collect()]
        if q < 60:
            full = [(r.vec_id, r.score) for r in vector_index.search(spark, path, query, 10, n).filter("vec_id < 5000").collect()]
            assert full[:5] == exact[:5]
        hits += len({i for i, _ in exact} & {r.vec_id for r in vector_index.search(spark, path, query, 10, 10).collect()})
    assert hits >= 90


def test_probing_reads_few_files(spark, index):
    df, path, n, _ = index
    query = [float(x) for x in df.filter("vec_id = 4").first().embedding]
    read = []
    for nprobe in (1, 5, 25, n):
        got = vector_index.rows_of(spark, path, vector_index.probed(spark, path, query, nprobe))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
        read.append(got.select("_metadata.file_path").distinct().count())
    assert read == sorted(read) and read[0] < read[1] < read[2] < read[3] and read[0] <= 4


def test_many_queries_equal_single_ones(spark, index):
    df, path, n, _ = index
    queries = df.filter("vec_id in (1, 2, 77)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vector_index.search_many(spark, path, queries, 10, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in (1, 2, 77):
        query = [float(x) for x in df.filter(F.col("vec_id") == q).first().embedding]
        want = [r.vec_id for r in vector_index.search(spark, path, query, 10, 6).collect()]
        assert len(set(want) & set(got[q].values())) >= 9 and sorted(got[q]) == list(range(1, 11))


def test_cells_of_a_list_give_what_its_pairs_give(spark, tmp_path, monkeypatch):
    """Copies in more rows than a cell holds, ties by id, rows of every length but none: small cells against each pair's cosine."""
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(150)]
    data += [(200 + i, data[i % 3][1]) for i in range(60)] + [(300 + i, [2 * x for x in data[7][1]]) for i in range(15)] + [(400, None), (401, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    path = f"{tmp_path}/ivf"
    n = vector_index.build(df, path, lists=3)
    queries = df.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    for name, value in (("CELL_ROWS", 20), ("CELL_QUERIES", 7), ("BLOCK", 3), ("PAIRS", 11)):
        monkeypatch.setattr(vector_index, name, value)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_index.search_many(spark, path, queries, 10, n).collect())
    pairs = queries.select("query_id", vector_index._direction(F.col("embedding")).alias("u")).filter("u is not null").crossJoin(df.filter("vec_id < 400"))
    scored = pairs.select("query_id", "vec_id", vector.cosine(F.col("embedding"), F.col("u")).alias("score")).collect()
    want = {}
    for r in sorted(scored, key=lambda r: (r.query_id, -r.score, r.vec_id)):
        want.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == [(q, i + 1, *x) for q in sorted(want) for i, x in enumerate(want[q][:10])]


def test_a_direction_adds_up_its_length_once(spark):
    """A row's work grows with its components, not with their square."""
    df = spark.range(0, 64, 1, 8).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: (i + F.col("id")).cast("float")).alias("v"))
    began = time.monotonic()
    unit = df.select(vector_index._direction(F.col("v")).alias("u")).select(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert time.monotonic() - began < 12 and all(abs(r.n - 1) < 1e-9 for r in unit)


# --- streams


def land(folder, n, rows, columns, times):
    df = pd.DataFrame(rows, columns=columns)
    for t in times:
        df[t] = pd.to_datetime(df[t], unit="s").astype("datetime64[us]")
    os.makedirs(folder, exist_ok=True)
    for c in set(columns) & {"key", "media_id", "status", "last_error"}:
        df[c] = df[c].astype("string")
    df.to_parquet(f"{folder}/{n}.parquet")


def run(stream, spark, name, mode, checkpoint):
    """All that the stream gives from what has landed, as one more step of its checkpoint."""
    rows = []

    def take(batch, _):
        rows.extend(batch.collect())

    q = stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return rows


@pytest.fixture(scope="module")
def stateful_spark(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_sessions_of_three_batches_equal_the_batch_query(stateful_spark, tmp_path):
    spark = stateful_spark
    rng = np.random.default_rng(3)
    rows = [(f"k{int(rng.integers(0, 3))}", int(s), int(s + rng.integers(0, 40))) for s in np.sort(rng.integers(0, 3000, 150))]
    rows += [(None, 5, 9), ("k1", 50, 40), ("k0", 100, 900)]
    late = rng.permutation(len(rows))  # within the delay, rows come in any order
    parts = [[rows[i] for i in sorted(late[:50])], [rows[i] for i in sorted(late[50:100])], [rows[i] for i in sorted(late[100:])], [("end", 100_000, 100_000)], [("end", 200_000, 200_000)]]
    folder, columns = str(tmp_path / "in"), ["key", "start_ts", "end_ts"]
    got = []
    for n, part in enumerate(parts):  # each step is a restart from the checkpoint
        land(folder, n, part, columns, columns[1:])
        stream = spark.readStream.schema("key string, start_ts timestamp, end_ts timestamp").parquet(folder)
        got += run(stateful.sessions(stream, 20_000, "3600 seconds"), spark, "s", "append", str(tmp_path / "cp"))
    want = stateful.sessions_of(spark.read.schema("key string, start_ts timestamp, end_ts timestamp").parquet(folder).filter("key <> 'end'"), 20_000).collect()
    assert sorted(map(tuple, (r for r in got if r.key != "end"))) == sorted(map(tuple, want)) and len(want) > 20


def test_status_machine_over_restarts(stateful_spark, tmp_path):
    spark = stateful_spark
    columns = ["media_id", "status", "last_error", "updated_at"]
    steps = [
        [("a", "pending", None, 1), ("b", "pending", None, 1)],
        [("a", "error", "timeout", 2), ("a", "error", "quota", 3), ("b", "done", None, 5)],
        [("a", "transcribed", None, 9), ("b", "error", "late", 4), (None, "error", "x", 1)],
    ]
    folder, now = str(tmp_path / "in"), {}
    for n, part in enumerate(steps):
        land(folder, n, part, columns, ["updated_at"])
        stream = spark.readStream.schema("media_id string, status string, last_error string, updated_at timestamp").parquet(folder)
        now |= {r.media_id: (r.status, r.last_error, r.retries) for r in run(stateful.status_machine(stream), spark, "m", "update", str(tmp_path / "cp"))}
    assert now == {"a": ("transcribed", "quota", 2), "b": ("done", "late", 1)}


def test_rate_limit_a_key_and_period(stateful_spark, tmp_path):
    spark = stateful_spark
    folder, columns, got = str(tmp_path / "in"), ["key", "at", "n"], []
    for n, part in enumerate([[("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 4, 4)], [("a", 8, 5), ("a", 12, 6), ("b", 9, 7), ("b", 9, 8)]]):
        land(folder, n, part, columns, ["at"])
        stream = spark.readStream.schema("key string, at timestamp, n long").parquet(folder)
        got += run(stateful.rate_limited(stream, "key", "at", 2, 10_000, "60 seconds"), spark, "r", "append", str(tmp_path / "cp"))
    assert sorted(r.n for r in got) == [1, 2, 4, 6, 7]
