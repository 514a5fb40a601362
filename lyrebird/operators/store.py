"""Keyed writes as DataFrames: upserts, replacement, dedupe, state machine, TTL, queues, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.operators.scan import ranked, running_sum


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the given order, which must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], always: tuple[str, ...] = (), only: tuple[str, ...] | None = None, keep_old_on_null: bool = True) -> DataFrame:
    """Full outer merge on the key. A column of an incoming row replaces the old value, unless it is null and ``keep_old_on_null``.

    ``always`` columns are replaced even by null; with ``only``, no other column of existing rows changes. An empty JSON
    object in ``metadata`` counts as null.
    """
    rest = [c for c in existing.columns if c not in key]
    old = existing.withColumn("_old", F.lit(True)).select(*key, *(F.col(c).alias(f"o_{c}") for c in rest), "_old")
    new = incoming.withColumn("_new", F.lit(True)).select(*key, *(F.col(c).alias(f"n_{c}") for c in rest), "_new")
    both = old.join(new, key, "full_outer")

    def value(c: str) -> Column:
        n = F.when(F.col(f"n_{c}") != "{}", F.col(f"n_{c}")) if c == "metadata" else F.col(f"n_{c}")
        if only is not None and c not in only:
            n = F.when(F.col("_old").isNull(), n).otherwise(F.col(f"o_{c}"))
            return n
        if c in always or not keep_old_on_null:
            return F.when(F.col("_new"), n).otherwise(F.col(f"o_{c}"))
        return F.coalesce(n, F.col(f"o_{c}"))

    return both.select(*key, *(value(c).alias(c) for c in rest))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of incoming parents are replaced as a whole, so no stale row with a higher index stays."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


#: Column and folders of a stored table's buckets.
BUCKET = "parent_bucket"


def write_children(rows: DataFrame, path: str, parent: str, buckets: int = 256) -> None:
    """Store a table of children in folders by a hash of their parent."""
    dealt = rows.withColumn(BUCKET, F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int"))
    dealt.repartitionByRange(BUCKET, parent).write.partitionBy(BUCKET).parquet(path)


def read_children(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def replace_stored(incoming: DataFrame, path: str, parent: str, buckets: int = 256) -> int:
    """Children of incoming parents replace the stored ones; only the buckets of those parents are read and written, in one commit. Returns their number.

    The new files are staged and take their buckets' place when all are written: a failed write leaves the old rows. ``buckets`` must be what
    the table was written with.
    """
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")
    new = incoming.withColumn(BUCKET, bucket)
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).select(new.columns)
    merged = replace_children(old, new, parent)
    merged.repartitionByRange(BUCKET, parent).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return len(touched)


def dedupe_first(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    return latest(df, key, *(F.col(c) for c in order))


def conditional_update(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Status changes (key, status, error or null, count): error only if given, retries up by one where asked."""
    c = changes.select(key, F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("count").alias("_c"))
    j = df.join(c, key, "left")
    return j.withColumn("status", F.coalesce("_s", "status")).withColumn("last_error", F.coalesce("_e", "last_error")).withColumn("retries", F.col("retries") + F.when(F.col("_c"), 1).otherwise(0)).drop("_s", "_e", "_c")


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that are still valid; null never expires."""
    return df.filter(F.col(expires).isNull() | (F.col(expires) > as_of))


def unprocessed(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def next_unprocessed(items: DataFrame, ledger: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k items, in a total order, that the ledger doesn't hold: the limit counts open items only."""
    return unprocessed(items, ledger, key).orderBy(*order).limit(k)


def recent_unprocessed(state: DataFrame, as_of: Column, days: int, method: str, k: int, tie: str) -> DataFrame:
    """The newest k items of the last days that aren't done and weren't taken up by ``method``."""
    fresh = state.filter((F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("status") != "done"))
    return fresh.filter(F.col("processing_method").isNull() | (F.col("processing_method") != method)).orderBy(F.desc("created_at"), tie).limit(k)


def fill_from(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, column: str, value: str) -> DataFrame:
    """``column`` is filled, where it is null, with ``value`` of the one parent whose ``parent_key`` equals the row's ``key``; other rows stay as they are."""
    p = parents.groupBy(F.col(parent_key).alias(key)).agg(F.min(value).alias("_v"))
    return rows.join(p, key, "left").withColumn(column, F.coalesce(column, "_v")).select(rows.columns)


def without_labels(parents: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Parents that have rows, none of which has a label, with their number of rows."""
    per = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count(label).alias("_labelled")).filter("_labelled = 0").drop("_labelled")
    return parents.join(per, key)


def pending_queue(state: DataFrame, k: int, tie: str, max_retries: int = 3) -> DataFrame:
    """Pending items first, then errors with retries left."""
    open_ = state.filter((F.col("status") == "pending") | ((F.col("status") == "error") & (F.col("retries") < max_retries)))
    return open_.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), tie).limit(k)


def batches(df: DataFrame, order: str, size: int, partitions: int | None = None) -> DataFrame:
    """``batch_no`` of consecutive rows in order; the order must be total."""
    return ranked(df, [order], "_rank", partitions).withColumn("batch_no", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def within_budget(df: DataFrame, order: list[str], cost: str, cap: float, by: str | None = None, partitions: int | None = None) -> DataFrame:
    """Rows, in a total order, whose earlier rows cost less than the cap: of a whole run, or of each ``by``. A null cost is 0.

    Costs that are whole numbers or decimals are summed exactly; sums of doubles round as their ranges fall.
    """
    if by is None:
        return running_sum(df, order, cost, "_spent", partitions).filter(F.col("_spent") < cap).select(df.columns)
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0.0))).over(w), F.lit(0.0))
    return df.withColumn("_spent", spent).filter(F.col("_spent") < cap).select(df.columns)


def integrity(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, unique: list[str]) -> DataFrame:
    """One row: n_children, n_orphans, n_null_parents, n_duplicate_groups."""
    orphans = children.filter(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti").agg(F.count("*").alias("n_orphans"))
    dups = children.groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_duplicate_groups"))
    base = children.agg(F.count("*").alias("n_children"), F.count_if(F.col(child_key).isNull()).alias("n_null_parents"))
    return base.join(orphans, F.lit(True)).join(dups, F.lit(True))
