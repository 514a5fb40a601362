"""Shared helpers: scratch tables in the folder all executors share, and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: A key is hot if it has more rows than this, and than one in ``HOT_KEYS`` of all rows: so many hot keys there are at most.
HOT_ROWS = 1000
HOT_KEYS = 20_000
HOT_BUCKETS = 1 << 17
_OWN_ROOT: dict[str, str] = {}
#: Tables written inside each open ``scratch_scope``.
_SCOPES: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and all executors are this process (local tests)."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="lyrebird-scratch-")
    return _OWN_ROOT[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lyrebird-{name}-{uuid.uuid4().hex}"


def cap_batches(spark: SparkSession) -> None:
    """From now on this session hands Python batches of at most 8 MB, or fewer bytes if it is set so: texts may be long,
    and batches are held several times over, outside the heap and in the workers."""
    if int(str(spark.conf.get(BATCH_KEY)).rstrip("bB")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors.

    The written path is kept on the result as ``scratch`` so that ``drop_scratch`` can remove it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    cap_batches(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    for scope in _SCOPES:
        scope.append(out)
    return out


@contextlib.contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], None]]:
    """Drops at its end all tables written inside it, but for those given to the function it yields."""
    written: list[DataFrame] = []
    kept: list[str] = []
    _SCOPES.append(written)
    try:
        yield lambda df: kept.append(df.scratch)
    finally:
        _SCOPES.remove(written)
        drop_scratch(*(df for df in written if df.scratch not in kept))


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables written by ``materialize``; only for tables no later plan reads."""
    for df in frames:
        spark, path = df.sparkSession, df.scratch
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def hot_keys(keys: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """(key, n) of the keys with over ``least`` rows and over one in ``HOT_KEYS`` of all rows; None if there are none. Null isn't a key.

    Counts per hash bucket come first, so that only rows of full buckets are counted by key. At most ``HOT_KEYS`` keys come out. DataFrame functions only.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(HOT_BUCKETS)).cast("int")
    counts = materialize(keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "buckets")  # at most HOT_BUCKETS rows
    most = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    full = counts.filter(F.col("n") > most).select("bucket")
    if full.isEmpty():
        drop_scratch(counts)
        return None
    some = keys.filter(F.col(key).isNotNull()).withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    hot = materialize(some.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most), "hot")
    drop_scratch(counts)
    return None if hot.isEmpty() else hot


def join_dealt(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """Equi-join (inner or left) of rows whose key may be very frequent with a ``right`` that has each key once and short rows: rows of hot keys stay where they are."""
    hot = hot_keys(left.select(key), key, least)
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot.select(key))
    warm = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return warm.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def join_counted(left: DataFrame, right: DataFrame, key: list[str], n: str, total: int, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """Equi-join (inner or left) with a ``right`` that has each key once, short rows and, in ``n``, the number of left rows of the key, of ``total``.

    Keys with over ``least`` rows and over one in ``HOT_KEYS`` of all rows, at most ``HOT_KEYS`` of them, are broadcast, so that their rows stay where they are. Keys aren't null.
    """
    hot = right.filter(F.col(n) > max(least, total // HOT_KEYS))
    if hot.isEmpty():
        return left.join(right, key, how)
    warm = left.join(F.broadcast(hot), key, "inner")
    cold = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(right.join(F.broadcast(hot.select(*key)), key, "left_anti"), key, how)
    return warm.unionByName(cold)


def trim() -> None:
    """Give this process's freed memory back, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when their plans are garbage on the driver."""
    trim()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gather(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """All batches of one bounded partition as one table."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else schema.empty_table()


def worker_slot(key, make: Callable):
    """The one object that a worker process remembers between tasks; another key replaces it, so caches never add up."""
    kept = sys.__dict__.setdefault("_lyrebird_slot", {})
    if key not in kept:
        kept.clear()
        trim()
        kept[key] = make()
    return kept[key]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which a column holds about ``most`` bytes: what a worker makes of them stays small."""
    rows = max(1, batch.num_rows * most // max(1, batch.column(column).nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def input_partitions(df: DataFrame, rows_each: int, n_rows: int, least: int = 1) -> int:
    """Partitions so that each holds about ``rows_each`` rows."""
    return max(least, -(-n_rows // rows_each))


def fresh(names: Iterable[str], name: str) -> str:
    """A column name that none of ``names`` equals, in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def wider(df: DataFrame, name: str, kind: str) -> StructType:
    """The frame's schema with one more column."""
    return StructType([*df.schema, *StructType.fromDDL(f"`{name}` {kind}")])
