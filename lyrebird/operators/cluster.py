"""Clusters of timed rows: gap sessions, span unions, paragraphs. One item may hold most of the rows: its clusters are numbered over many ranges of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.operators.scan import carried, parts_before, spread, with_carry


def _numbered(df: DataFrame, key: str, order: list[str], value: Column, new: Callable[[Column, Column], Column], largest: bool = False, partitions: int | None = None) -> DataFrame:
    """``cluster``: running count, from 1 for each key, of rows that begin one.

    ``new(before, row)`` tells it from the ``value`` of the row before, or from the largest of all rows before, and from the row (its order and
    ``_v``); null means yes. Rows of a key may lie in many ranges: a range hands on its last or largest value, then its number of beginnings.
    """
    ranges = spread(df, [key, *order], partitions)
    here = Window.partitionBy("_p", key).orderBy("_pos")
    boxed = F.struct(value.alias("v"))
    known = F.when(value.isNotNull(), boxed)
    parts = ranges.groupBy("_p", key).agg((F.max(known) if largest else F.max_by(boxed, "_pos")).alias("_tail"))
    handed = F.max("_tail").over(parts_before(key)) if largest else F.lag("_tail").over(Window.partitionBy(key).orderBy("_p"))
    rows = with_carry(ranges, key, carried(parts, key, {"_from": handed}))
    if largest:
        seen = F.greatest(F.max(known).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("_from"))
    else:
        seen = F.coalesce(F.lag(boxed).over(here), F.col("_from"))
    begins = F.when(F.coalesce(new(F.col("_seen.v"), F.struct(*order, value.alias("_v"))), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("_seen", seen).withColumn("_new", begins).withColumn("_here", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy("_p", key).agg(F.sum("_new").alias("_n"))
    carry = carried(counts, key, {"_add": F.sum("_n").over(parts_before(key))})
    return with_carry(rows, key, carry).withColumn("cluster", F.coalesce("_add", F.lit(0)) + F.col("_here")).select(*df.columns, "cluster")


def gap_clusters(df: DataFrame, key: str, tie: str, gap: float, start: str = "start_sec", end: str = "end_sec", absolute: bool = False, partitions: int | None = None) -> DataFrame:
    """A row begins a cluster if it starts more than ``gap`` after the row before ends. A null bound of either begins one."""

    def new(before: Column, row: Column) -> Column:
        apart = row[start] - before
        return (F.abs(apart) if absolute else apart) > gap

    return _numbered(df, key, [start, tie], F.col(end), new, partitions=partitions)


def span_unions(df: DataFrame, key: str, tie: str, gap: float, start: str = "start_sec", end: str = "end_sec", partitions: int | None = None) -> DataFrame:
    """As ``gap_clusters``, but measured from the largest end so far, which is the union of intervals."""
    return _numbered(df, key, [start, tie], F.col(end), lambda before, row: row[start] - before > gap, largest=True, partitions=partitions)


def paragraphs(df: DataFrame, key: str, order: str, speaker: str, partitions: int | None = None) -> DataFrame:
    """A row begins a paragraph if the speaker changes; null is a speaker of its own, and a null one never continues."""
    return _numbered(df, key, [order], F.col(speaker), lambda before, row: before != row["_v"], partitions=partitions)


def joined_text(text: str, *order: str, by: str = " ") -> Column:
    """Aggregate: texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda r: r[text]), by)


def merged(df: DataFrame, key: str, tie: str, by: str = " ... ", start: str = "start_sec", end: str = "end_sec", text: str = "text") -> DataFrame:
    """One row per cluster: first start, last row's end, number of rows, texts joined in order."""
    last = F.max_by(end, F.struct(start, tie))
    return df.groupBy(key, "cluster").agg(F.min(start).alias(start), last.alias(end), F.count("*").alias("n_rows"), joined_text(text, start, tie, by=by).alias(text))


def best_of(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Per cluster the row with the highest score, the first of equals."""
    w = Window.partitionBy(key, "cluster").orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
