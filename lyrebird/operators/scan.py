"""Ordered scans over tables of any size: global ranks and running sums, and running values of keys that may hold most of the rows.

Rows are dealt into ranges of a total order and sorted there, once; the range's number and the row's place in it are written beside the row, so the
bounds, which Spark draws from a sample, are frozen. Whatever a scan carries from one range to the next is made of one summary a range (and key),
combined in the order of ranges, and added to what the rows of a range find among themselves. So no window is global, and no key is one task's work.

Columns that the scans add are ``_p``, the range, and ``_pos``, the place in it from 0. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.storage import stored

#: ``monotonically_increasing_id`` keeps the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def spread(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with ``_p`` and ``_pos``, written once. The order must be total but for rows that are interchangeable; nulls come first."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = dealt.sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    place = F.col("_n").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return stored(numbered.withColumn("_p", F.shiftright("_n", _PLACE_BITS).cast("int")).withColumn("_pos", place).drop("_n"), "ranges")


def _before(ranges: DataFrame, total: Column) -> DataFrame:
    """(_p, _before): for each range the sum of ``total`` over all ranges before it. One row a range: bounded by the number of partitions."""
    per = ranges.groupBy("_p").agg(total.alias("_n"))
    every = per.agg(F.sort_array(F.collect_list(F.struct("_p", "_n"))).alias("a"))
    kind = dict(per.dtypes)["_n"]
    walked = F.aggregate(
        "a",
        F.struct(F.lit(0).cast(kind).alias("sum"), F.array().cast(f"array<struct<_p:int,_before:{kind}>>").alias("out")),
        lambda s, r: F.struct((s["sum"] + F.coalesce(r["_n"], F.lit(0).cast(kind))).cast(kind).alias("sum"), F.concat(s["out"], F.array(F.struct(r["_p"].alias("_p"), s["sum"].alias("_before")))).alias("out")),
    )
    return every.select(F.inline(walked["out"]))


def ranked(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``, the row's number from 0 in the order. Wide rows are shuffled once and written once."""
    ranges = spread(df, order, partitions)
    return ranges.join(F.broadcast(_before(ranges, F.count("*"))), "_p").withColumn(name, F.col("_before") + F.col("_pos")).drop("_p", "_pos", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``, the sum of ``value`` over all rows before this one in the order; null counts as 0. Whole numbers and decimals are exact."""
    ranges = spread(df, order, partitions)
    here = Window.partitionBy("_p").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(dict(df.dtypes)[value])
    within = F.coalesce(F.sum(F.coalesce(F.col(value), zero)).over(here), F.lit(0))
    carried = F.broadcast(_before(ranges, F.sum(F.coalesce(F.col(value), zero))))
    return ranges.withColumn("_sum", within).join(carried, "_p").withColumn(name, F.col("_before") + F.col("_sum")).drop("_p", "_pos", "_before", "_sum")


def carried(segments: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """What every part of a key after its first takes over: (_p, _key, the columns), computed by window over the parts of one key.

    ``segments`` has a row for each (_p, key). Only keys that several ranges share are returned, at most two rows a range, so the
    result may be broadcast whatever the table's size.
    """
    one = Window.partitionBy(key)
    shared = segments.withColumn("_parts", F.count("*").over(one)).filter("_parts > 1")
    return shared.select("_p", F.col(key).alias("_key"), *(c.alias(n) for n, c in columns.items()))


def parts_before(key: str) -> Window:
    """The window over all earlier parts of a key."""
    return Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def parts_after(key: str) -> Window:
    """The window over all later parts of a key."""
    return Window.partitionBy(key).orderBy("_p").rowsBetween(1, Window.unboundedFollowing)


def with_carry(rows: DataFrame, key: str, carry: DataFrame) -> DataFrame:
    """The rows of ranges with the columns of ``carried`` beside them, null in a key's first part."""
    c = F.broadcast(carry.withColumnRenamed("_p", "_cp"))
    return rows.join(c, (F.col("_p") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_cp", "_key")
