"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes; a row's home is the first point clockwise of its
key's hash. A shard takes rows up to its capacity; rows that meet a full shard continue clockwise to the next
point whose shard has room. Rows of one arc are interchangeable, so the walk is planned on row counts per arc (shards *
vnodes numbers, the only thing the driver sees), and each row then finds its place by its rank in its arc.

With ``slack`` a capacity is (1 + slack) times the mean: few rows move when shards come or go. Without it, shards have
exact quotas that differ by at most one row.

Ranks are counted in sub-buckets of an arc. A row's sub-bucket follows from its key, so its place depends on the rows alone and not on how
they are partitioned; only rows of one key that has very many of them, which stand for each other, are dealt by the scan's partition.

Defined results: null text has 0 bytes; a null key has a home like any other; repeated rows are placed as
often as they occur; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.llm.common import hot_keys, materialize

#: Sub-buckets of an arc; with the arcs they bound the broadcast table of ranks.
SUB_BUCKETS = 64


def ring_points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ring's points in order, and the shard that owns each."""
    at = np.array([xxhash.xxh3_64_intdigest(f"shard {s} point {v}") for s in range(shards) for v in range(vnodes)], np.uint64)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def plan_walk(counts: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each arc's rows go. All arcs step together, one point at a time."""
    left, used = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    done = np.zeros(len(counts), np.int64)
    plan, waiting, n = [], [(a, a) for a in range(len(counts)) if counts[a]], len(owners)
    while waiting:
        onward = []
        for arc, at in waiting:
            shard = owners[at]
            take = int(min(left[shard], counts[arc] - done[arc]))
            if take:
                plan.append((arc, int(done[arc]), int(done[arc]) + take, int(shard), int(used[shard])))
                left[shard] -= take
                used[shard] += take
                done[arc] += take
            if done[arc] < counts[arc]:
                onward.append((arc, (at + 1) % n))
        waiting = onward
    return plan


def capacities(n_rows: int, shards: int, slack: float | None) -> np.ndarray:
    """Rows that each shard takes at most."""
    if slack is None:
        return np.array([n_rows // shards + (s < n_rows % shards) for s in range(shards)], np.int64)
    return np.full(shards, int(np.ceil((1 + slack) * n_rows / shards)), np.int64)


def shard_rows(docs: DataFrame, shards: int, vnodes: int = 64, slack: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    points, owners = ring_points(shards, vnodes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            arc = np.searchsorted(points, h) % len(points)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(arc.astype(np.int32)), b.column(4)], ["doc_id", "size", "text_crc32", "arc", "sub"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("h"),
    )
    dealt = F.spark_partition_id() % SUB_BUCKETS
    by_key = F.pmod(F.xxhash64("h", F.lit("sub")), F.lit(SUB_BUCKETS)).cast("int")
    hot = hot_keys(rows.select("h"), "h")
    if hot is None:
        rows = rows.withColumn("sub", by_key)
    else:
        rows = rows.join(F.broadcast(hot), "h", "left").select("doc_id", "size", "text_crc32", "h", F.when(F.col("n").isNotNull(), dealt).otherwise(by_key).alias("sub"))
    homes = materialize(rows.mapInArrow(home, "doc_id long, size long, text_crc32 long, arc int, sub int"), "homes")
    per_sub = homes.groupBy("arc", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_sub.select("arc", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = homes.groupBy("arc").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(len(points), np.int64)
    counts[totals["arc"].to_numpy()] = totals["n"].to_numpy()
    plan = plan_walk(counts, owners, capacities(int(counts.sum()), shards, slack))
    goes = spark.createDataFrame(pa.Table.from_arrays([pa.array([p[i] for p in plan], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["arc", "lo", "hi", "shard", "slot0"]))
    local = Window.partitionBy("arc", "sub").orderBy("doc_id", "text_crc32", "size")
    ranked = homes.withColumn("local", F.row_number().over(local) - 1).join(F.broadcast(firsts), ["arc", "sub"]).withColumn("rank", F.col("first") + F.col("local")).alias("r")
    goes = F.broadcast(goes.alias("g"))
    placed = ranked.join(goes, F.expr("r.arc = g.arc and r.rank >= g.lo and r.rank < g.hi"))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
