"""Range joins of timed rows, through bins: intervals are spread over fixed bins, joined on key and bin, and rechecked. Overlaps by a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.operators.scan import carried, parts_after, parts_before, spread, with_carry

BIN_S = 30.0


def _binned(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    lo = F.floor(F.col(start) / width)
    return df.withColumn("_bin", F.explode(F.sequence(lo, F.greatest(lo, F.floor(F.col(end) / width)))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str = "start_sec", end: str = "end_sec", prefix: str = "r_", width: float = BIN_S) -> DataFrame:
    """Pairs of one key whose intervals overlap by more than a touch, each once; right columns get the prefix.

    A pair is kept in the bin where the later of its two starts falls, so none is repeated.
    """
    right = right.select(key, *(F.col(c).alias(prefix + c) for c in right.columns if c != key))
    l, r = _binned(left, start, end, width), _binned(right, prefix + start, prefix + end, width)
    pairs = l.join(r, [key, "_bin"])
    first = F.floor(F.greatest(F.col(start), F.col(prefix + start)) / width) == F.col("_bin")
    return pairs.filter((F.col(end) > F.col(prefix + start)) & (F.col(start) < F.col(prefix + end)) & first).drop("_bin")


def overlap_length(start: str = "start_sec", end: str = "end_sec", prefix: str = "r_") -> Column:
    return F.least(F.col(end), F.col(prefix + end)) - F.greatest(F.col(start), F.col(prefix + start))


def longest_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_tie: str) -> DataFrame:
    """For each left row that overlaps something, the right row with the longest overlap, and ``is_overlap`` if there are several."""
    pairs = overlap_join(left, right, key).withColumn("overlap", overlap_length())
    one = Window.partitionBy(key, left_id)
    best = one.orderBy(F.desc("overlap"), F.col("r_" + right_tie))
    return pairs.withColumn("_n", F.count("*").over(one)).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").withColumn("is_overlap", F.col("_n") > 1).drop("_n", "_rn")


def contained(words: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Pairs of a word and a span that holds it entirely."""
    pairs = overlap_join(words, spans, key)
    return pairs.filter("start_sec >= r_start_sec and end_sec <= r_end_sec")


def overlapping(df: DataFrame, key: str, row_id: str, more_than: float = 0.3, start: str = "start_sec", end: str = "end_sec", partitions: int | None = None) -> DataFrame:
    """``is_overlap``: another row of the key overlaps by more than ``more_than`` seconds. ``row_id`` names a row within its key.

    A sweep over the rows by start, without any pair: an earlier row overlaps by enough if the largest end so far does; of the later rows that
    are long enough the first to start overlaps most. A key may lie in many ranges of rows; each hands on its largest end, and to the front the
    first start of a long enough row. A row with a null bound overlaps nothing.
    """
    ranges = spread(df, [key, start, row_id], partitions)
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    stop = F.when(known, F.col(end))
    long_start = F.when(known & (F.col(end) - F.col(start) > more_than), F.col(start))
    here = Window.partitionBy("_p", key).orderBy("_pos")
    rows = ranges.withColumn("_stop", F.max(stop).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_next", F.min(long_start).over(here.rowsBetween(1, Window.unboundedFollowing)))
    parts = ranges.groupBy("_p", key).agg(F.max(stop).alias("_top"), F.min(long_start).alias("_low"))
    carry = carried(parts, key, {"_stop_before": F.max("_top").over(parts_before(key)), "_next_after": F.min("_low").over(parts_after(key))})
    both = with_carry(rows, key, carry)
    stop_before, next_start = F.greatest("_stop", "_stop_before"), F.least("_next", "_next_after")
    by_earlier = F.least(F.col(end), stop_before) - F.col(start) > more_than
    by_later = F.col(end) - next_start > more_than
    hit = known & (F.coalesce(by_earlier & stop_before.isNotNull(), F.lit(False)) | F.coalesce(by_later, F.lit(False)))
    return both.withColumn("is_overlap", hit).select(*df.columns, "is_overlap")
