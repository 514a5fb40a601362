"""Incremental ingest: new files are taken once, and a keyed table is kept current by foreachBatch.

A table is dealt into buckets by its key's hash. A batch writes, as one version, the buckets that it touches and no others; a bucket's newest finished
version is current. A batch that is run again after a failure replaces its own version and nothing else, as what it read is kept; what
an earlier version has replaced is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lyrebird.operators.store import latest, upsert


#: Column and folders of the buckets, and their number unless it is given.
BUCKET, BUCKETS = "key_bucket", 64


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    done = [p for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def _buckets(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """The versions that hold each bucket, in order."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for v in versions(spark, path):
        if below is None or v < below:
            for s in fs.listStatus(jvm_path(f"{path}/v={v}")):
                name = s.getPath().getName()
                if name.startswith(f"{BUCKET}="):
                    out.setdefault(int(name[len(BUCKET) + 1 :]), []).append(v)
    return out


def _read(spark: SparkSession, path: str, places: dict[int, list[int]], schema) -> DataFrame:
    found = [f"{path}/v={held[-1]}/{BUCKET}={b}" for b, held in sorted(places.items())]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, path, _buckets(spark, path), schema)


def upsert_batches(path: str, key: list[str], order: str, buckets: int = BUCKETS, **rules) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row per key of a batch is merged into the table at ``path``. The number of buckets stays what it was at first."""

    def run(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        new = latest(batch, key, F.desc_nulls_last(order), F.xxhash64(*batch.columns))
        touched = {r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
        before = {b: held for b, held in _buckets(spark, path, number).items() if b in touched}
        merged = upsert(_read(spark, path, before, schema), new, key, **rules).select(batch.columns)
        merged.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={number}")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b, held in before.items():
            for v in held[:-1]:  # the last one is what this batch has read
                fs.delete(jvm_path(f"{path}/v={v}/{BUCKET}={b}"), True)

    return run


def ingest(spark: SparkSession, landing: str, schema, path: str, checkpoint: str, key: list[str], order: str, **rules) -> StreamingQuery:
    """Take all files that landed since the last run, then stop."""
    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(upsert_batches(path, key, order, **rules)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: content hashes make deliveries idempotent."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, at: str = "updated_at", status: str = "status", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts per status and window of event time; rows later than ``delay`` are left out."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, window), status).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), status, "n")
