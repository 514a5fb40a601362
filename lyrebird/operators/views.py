"""Views, gates and maintenance of the segment store."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.keys import pair_digest
from lyrebird.functions.quality import quality_label
from lyrebird.operators.bounds import broadcast_if_small
from lyrebird.schemas import GUEST, PRIMARY


def segments_with_metadata(segments: DataFrame) -> DataFrame:
    """Segments with duration, display name (the label itself for other speakers) and quality label."""
    name = F.when(F.col("speaker_label") == PRIMARY, "Primary speaker").when(F.col("speaker_label") == GUEST, "Guest").otherwise(F.col("speaker_label"))
    return segments.withColumn("duration", F.col("end_sec") - F.col("start_sec")).withColumn("speaker_display_name", name).withColumn("quality", quality_label(F.col("speaker_label"), F.col("avg_logprob"), F.col("compression_ratio")))


def stored(segments: DataFrame, primary_only: bool) -> DataFrame:
    """What the store takes: with ``primary_only`` the primary speaker's segments only."""
    return segments.filter(F.col("speaker_label") == PRIMARY) if primary_only else segments


def gated_embedding(label: Column, embedding: Column) -> Column:
    """Embeddings are kept for the primary speaker only."""
    return F.when(label == PRIMARY, embedding)


def processing_cost_summary(log: DataFrame, cost: Column) -> DataFrame:
    """Items and cost per day and method."""
    return log.groupBy(F.date_trunc("day", "updated_at").alias("day"), "method").agg(F.count("*").alias("n_items"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("avg_cost"))


def processing_quality_analysis(log: DataFrame, ok: Column, json_path: str) -> DataFrame:
    """Success rate and the mean of a number in the metadata, per method."""
    good = F.count_if(ok)
    return log.groupBy("method").agg(
        F.count("*").alias("n_items"),
        good.alias("n_ok"),
        F.round(100.0 * good / F.nullif(F.count("*"), F.lit(0)), 2).alias("success_rate"),
        F.avg(F.get_json_object("metadata", json_path).try_cast("double")).alias("avg_value"),
    )


def cleanup_expired(df: DataFrame, expires: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row: n_removed)."""
    gone = F.coalesce(F.col(expires) <= as_of, F.lit(False))
    return df.filter(~gone), df.agg(F.count_if(gone).alias("n_removed"))


def coverage(segments: DataFrame, durations: DataFrame, key: str = "media_id") -> DataFrame:
    """Share of each item's duration that its segments cover; null without a duration."""
    spoken = segments.groupBy(key).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("covered_s"), F.count("*").alias("n_segments"))
    return durations.join(spoken, key, "left").select(key, "duration_s", F.coalesce("covered_s", F.lit(0.0)).alias("covered_s"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.try_divide(F.coalesce("covered_s", F.lit(0.0)), F.nullif("duration_s", F.lit(0.0))).alias("coverage"))


def analyse(spark: SparkSession, table: str) -> None:
    """Statistics for the optimizer, of the table and of all its columns."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def file_stats(spark: SparkSession, path: str, dead: Column | None = None) -> DataFrame:
    """(folder, file, bytes, n_rows, dead_rows) of a Parquet folder's files: what a table holds, and how much of it no longer counts.

    Without a condition for dead rows only footers are read. Files without rows aren't listed.
    """
    file = F.col("_metadata.file_path")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    per = rows.groupBy(file.alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"), (F.count_if(dead) if dead is not None else F.lit(0)).cast("long").alias("dead_rows"))
    return per.select(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder"), "file", "bytes", "n_rows", "dead_rows")


def folder_sizes(stats: DataFrame, small_bytes: int = 64 << 20) -> DataFrame:
    """Per folder: files, bytes, rows, files below ``small_bytes`` and the share of dead rows."""
    return stats.groupBy("folder").agg(
        F.count("*").alias("n_files"),
        F.sum("bytes").alias("bytes"),
        F.sum("n_rows").alias("n_rows"),
        F.count_if(F.col("bytes") < small_bytes).alias("n_small"),
        F.round(F.sum("dead_rows") / F.sum("n_rows"), 4).alias("dead_share"),
    )


def packed_files(sizes: list[tuple[str, int]], bytes_each: int) -> list[list[str]]:
    """First fit, largest first: groups of at least two files that together come near ``bytes_each``, and not above it."""
    groups: list[tuple[int, list[str]]] = []
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = next((i for i, (held, _) in enumerate(groups) if held + size <= bytes_each), None)
        if at is None:
            groups.append((size, [name]))
        else:
            groups[at] = (groups[at][0] + size, [*groups[at][1], name])
    return [names for _, names in groups if len(names) > 1]


def compact(spark: SparkSession, path: str, bytes_each: int = 256 << 20) -> int:
    """Pack the small files of each folder (below half of ``bytes_each``) into files near that size; all others stay as they are. Returns the number of new files.

    Each group's new file is written beside the table first, moved in, and only then its old files go: a failure in
    between leaves rows twice, never none, and the staging folder names the group. Nobody else may write meanwhile. File names are the
    driver's, as they are in any scan of the table. A task writes one group: hashes of group numbers would put several into one.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    store = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    small: dict[str, list[tuple[str, int]]] = {}
    for r in file_stats(spark, path).filter(F.col("bytes") < bytes_each // 2).select("folder", "file", "bytes").toLocalIterator():
        small.setdefault(r["folder"], []).append((r["file"], r["bytes"]))
    groups = [(folder, names) for folder, sizes in sorted(small.items()) for names in packed_files(sizes, bytes_each)]
    if not groups:
        return 0
    stage = f"{path.rstrip('/')}/_compact-{uuid.uuid4().hex}"
    place = spark.createDataFrame([(name, i) for i, (_, names) in enumerate(groups) for name in names], "_file string, _group int")
    rows = spark.read.parquet(*(unquote(name) for _, names in groups for name in names)).withColumn("_file", F.col("_metadata.file_path"))
    rows.join(broadcast_if_small(place, 1_000_000), "_file").drop("_file").repartitionById(len(groups), F.col("_group")).write.partitionBy("_group").parquet(stage)
    done = 0
    for i, (folder, names) in enumerate(groups):
        for s in store.listStatus(jvm_path(f"{stage}/_group={i}")):
            if not store.rename(s.getPath(), jvm_path(f"{unquote(folder)}/{s.getPath().getName()}")):
                raise OSError(f"{s.getPath()} could not be moved to {folder}; its old files are untouched")
            done += 1
        for name in names:
            store.delete(jvm_path(unquote(name)), False)
    store.delete(jvm_path(stage), True)
    return done


def reset(spark: SparkSession, path: str, confirm: str) -> None:
    """Empty a table's folder; the caller repeats the path, so that nothing goes by mistake."""
    if confirm != path:
        raise ValueError("the path must be confirmed")
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def status_page(sources: DataFrame, segments: DataFrame, as_of: Column) -> DataFrame:
    """One row: numbers of sources (id, duration_s, created_at) and segments (source_id, text, speaker_label, embedding, created_at), what came in the last
    hour, repeated texts, and rows without label or vector."""
    hour = as_of - F.expr("INTERVAL 1 HOUR")
    s = sources.agg(
        F.count("*").alias("n_sources"),
        F.round(F.avg("duration_s") / 60.0, 4).alias("avg_minutes"),
        F.round(F.sum("duration_s") / 3600.0, 4).alias("total_hours"),
        F.count_if(F.col("created_at") > hour).alias("recent_sources"),
    )
    g = segments.agg(
        F.count("*").alias("n_segments"),
        F.count_distinct("source_id").alias("n_with_segments"),
        F.count_distinct(F.when(F.col("created_at") > hour, F.col("source_id"))).alias("recent_items"),
        F.count_if(F.col("speaker_label").isNull()).alias("n_null_labels"),
        F.count("embedding").alias("n_embedded"),
    )
    d = segments.groupBy(pair_digest("source_id", "text").alias("pair")).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_repeated"))
    out = s.join(g, F.lit(True)).join(d, F.lit(True))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0))), F.lit(0.0)), 4)
    return out.withColumn("segments_each", share("n_segments", "n_with_segments")).withColumn("embedded_share", share("n_embedded", "n_segments"))


def latest_sources(sources: DataFrame, segments: DataFrame, k: int = 5) -> DataFrame:
    """The newest k sources with their numbers of segments; only those meet the segments."""
    top = sources.orderBy(F.desc_nulls_last("created_at"), "id").limit(k)
    return top.join(segments.select(F.col("source_id").alias("id"), "text"), "id", "left").groupBy("id", "created_at").agg(F.count("text").alias("n_segments"))


def ingestion_stats(state: DataFrame, sources: DataFrame, chunks: DataFrame, kind: str = "youtube") -> DataFrame:
    """(section, name, n): totals of items, sources of one kind and chunks, items by status, and the five most frequent errors."""
    total = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")
    status = state.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), "name", "n")
    failed = state.filter((F.col("status") == "error") & F.col("last_error").isNotNull())
    errors = failed.groupBy(F.col("last_error").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5).select(F.lit("error").alias("section"), "name", "n")
    return total("items", state).unionByName(total("sources", sources.filter(F.col("source_type") == kind))).unionByName(total("chunks", chunks)).unionByName(status).unionByName(errors)
