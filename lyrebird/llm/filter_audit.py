"""Filter interaction audit: what each filter removes in every order of the filters, duplicates found by partition refinement.

Failure conditions of a text: A under 200 words; B under half of them distinct; C over 2 % capital letters A-Z; D one of # $ % & * |; E equal to the text of
a smaller doc_id, anywhere in the table. One scan measures A to D, the length in code points and a hash for each of the text's blocks, which grow
eightfold, so that nine of them cover any text. E refines a partition of slim rows: by length, then by one block's hash after
the other; rows alone in their class drop out at once, whole texts leave for comparison as soon as their last block is split. The texts of the
survivors are read again and compared in full with that of the smallest doc_id in their class; those that differ (colliding hashes) go
round again among themselves. The masks of failed conditions are then counted, with labels, and every order follows from the counts of the 32 masks.

A class that holds many rows is dealt out: each share meets a copy of its smallest row. Large classes and labels meet their rows by broadcast of a
bounded number of keys.

Defined results: a null text is empty, a null source the part ''. A null doc_id is larger than all others, has no label, and is no smaller id of
anything but nothing. Rows that share doc_id and text don't make each other duplicates. A document counts as good (toxic) if any
label row of its doc_id says so. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.llm.common import drop_scratch, join_counted, join_dealt, materialize
from lyrebird.llm.rows import with_keys

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Code points of the first block; each further block is this many times as long as the one before.
FIRST_BLOCK, GROWTH, BLOCKS = 256, 8, 9
#: Rows of a class that one task compares with its smallest row.
SHARE = 256
#: Classes of more rows than that are large, but no more than so many: their keys are broadcast.
LARGE_CLASSES = 500_000
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for conditions A, B, C, D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, failed in enumerate(conditions):
        mask = mask.bitwiseOR(F.when(failed, 1 << bit).otherwise(0))
    return mask


def _starts() -> list[int]:
    at, size, out = 0, FIRST_BLOCK, []
    for _ in range(BLOCKS):
        out.append(at)
        at, size = at + size, size * GROWTH
    return [*out, at]


def _hashes(text: Column, modulus: int | None) -> list[Column]:
    """Hash of each block, null beyond the end of the text. ``modulus`` makes few different hashes, for tests of collisions."""
    starts = _starts()
    out = []
    for i in range(BLOCKS):
        h = F.xxhash64(F.substring(text, starts[i] + 1, starts[i + 1] - starts[i]) if i else F.substring(text, 1, FIRST_BLOCK))
        h = F.pmod(h, F.lit(modulus)) if modulus else h
        out.append(F.when(F.length(text) > starts[i], h) if i else h)
    return out


def _key(n: Column, hashes: list[Column]) -> Column:
    """The class of a row: its length and the hashes so far. A null hash leaves the class as it is."""
    return F.xxhash64(n, *hashes)


def duplicates(docs: DataFrame, modulus: int | None = None) -> DataFrame:
    """doc_id, part, mask (all five conditions) of every row of (doc_id, part, text)."""
    names = [f"h{i}" for i in range(BLOCKS)]
    text = F.col("text")
    slim = docs.select("doc_id", "part", failures(text).alias("mask"), F.length(text).alias("n"), *(h.alias(c) for h, c in zip(_hashes(text, modulus), names)))
    alive = materialize(slim, "measures")
    total = alive.count()
    alone, whole, starts = [], [], _starts()
    old = alive
    for r in range(BLOCKS + 1):  # by length, then by each block
        keyed = alive.withColumn("key", _key(F.col("n"), [F.col(c) for c in names[:r]]))
        several = materialize(keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "classes")
        split = materialize(join_counted(keyed, several, ["key"], "rows", total, "left"), "refined")
        alone.append(split.filter("rows is null").select("doc_id", "part", "mask"))
        stay = split.filter("rows is not null").drop("rows")
        if r:
            whole.append(stay.filter(F.col("n") <= starts[r]).select("doc_id", "key"))
            stay = stay.filter(F.col("n") > starts[r])
        alive = stay.drop("key")
        drop_scratch(several)
        if r == 0:
            drop_scratch(old)
        if alive.isEmpty():
            break
    out = alone[0]
    for more in alone[1:]:
        out = out.unionByName(more)
    if not whole:
        return out
    survivors = whole[0]
    for more in whole[1:]:
        survivors = survivors.unionByName(more)
    classes = materialize(survivors.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "survivors")
    if classes.isEmpty():
        return out
    keyed = docs.withColumn("key", _key(F.length("text"), _hashes(text, modulus)))
    rows = with_keys(keyed, F.col("key"), classes.select("key")).select("key", "doc_id", "part", failures(text).alias("mask"), "text")
    while True:
        compared = materialize(_compared(rows, classes), "compared")
        out = out.unionByName(compared.filter("same").select("doc_id", "part", "mask"))
        rows = compared.filter("not same").select("key", "doc_id", "part", "mask", "text")
        if rows.isEmpty():
            return out
        classes = materialize(rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "survivors")


def _compared(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with ``same``: whether their text is that of their class's smallest doc_id; if so the mask tells duplicates, else the text is kept.

    Rows meet by (key, share). A marker of every class stands before its rows in the order of the window; rows without one aren't
    in any class and drop out. Markers of classes of several shares carry the text of the smallest row.
    """
    most = max(SHARE, (classes.agg(F.sum("rows")).first()[0] or 0) // LARGE_CLASSES)
    columns = ["key", "share", "marker", "doc_id", "part", "mask", "text", "least"]
    none = {"part": F.lit(None).cast("string"), "mask": F.lit(None).cast("int"), "doc_id": F.lit(None).cast("long"), "marker": F.lit(1)}
    large = classes.filter(F.col("rows") > most).select("key", F.col("least").alias("of"), F.ceil(F.col("rows") / SHARE).cast("int").alias("shares"))
    mine = rows.join(F.broadcast(large), "key", "left")
    # a row's place in its partition deals it, so that equal rows spread too
    share = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("shares")), F.lit(0)).cast("int")
    placed = mine.withColumns({"share": share, "marker": F.lit(0), "least": F.lit(None).cast("long")}).select(columns)
    texts = mine.filter(F.col("shares").isNotNull() & F.col("doc_id").eqNullSafe(F.col("of"))).groupBy("key").agg(F.min("text").alias("text"), F.first("of").alias("least"), F.first("shares").alias("shares"))
    heads = texts.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumns(none).select(columns)
    small = classes.filter(F.col("rows") <= most).withColumns(none | {"share": F.lit(0), "text": F.lit(None).cast("string")}).select(columns)
    marks = heads.unionByName(small)
    w = Window.partitionBy("key", "share").orderBy(F.desc("marker"), F.asc_nulls_last("doc_id"), "text").rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.unionByName(marks).withColumns({"head": F.first("text", ignorenulls=True).over(w), "known": F.first("marker").over(w), "of": F.first("least").over(w)})
    same = F.col("text") == F.col("head")
    again = same & F.col("of").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("of")))
    mask = F.col("mask").bitwiseOR(F.when(again, DUPLICATE).otherwise(0))
    return seen.filter("marker = 0 and known = 1").select("key", "doc_id", "part", F.when(same, mask).otherwise(F.col("mask")).alias("mask"), same.alias("same"), F.when(~same, F.col("text")).alias("text"))


def audit(docs: DataFrame, labels: DataFrame, modulus: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row a part, order and step."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    masks = duplicates(given, modulus)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & (F.col("good") | F.col("toxic")))
    # groups first, so that a doc_id that many rows share is one row
    per_id = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = join_dealt(per_id.filter("doc_id is not null"), marks, "doc_id", "left")
    unknown = per_id.filter("doc_id is null").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    n = F.col("n")
    counted = known.unionByName(unknown).groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    return orders(counted)


def orders(counted: DataFrame) -> DataFrame:
    """All orders and steps of each part from (part, mask, n, good, toxic): at most 32 masks a part."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, _ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_at = lambda j: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substr("filter_order", j, F.lit(1))) - 1)
    earlier = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda j: j < F.col("step")), F.lit(0), lambda a, j: a + bit_at(j))
    steps = steps.withColumn("bit", bit_at(F.col("step"))).withColumn("earlier", earlier)

    def total(where, value="n", times=lambda e: F.lit(1)) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda a, e: a + e[value] * times(e))

    has = lambda e: e["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda e: e["mask"].bitwiseAND(F.col("earlier")) != 0
    removed = lambda e: has(e) & ~gone(e)
    # in one of bit_count(mask) orders the filter is the first to fail
    share = lambda e: (F.lit(len(_ORDERS)) / F.bit_count(e["mask"])).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda e: ~has(e) & ~gone(e)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda e: has(e) & gone(e)).alias("redundant"),
        total(lambda e: e["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(has, "n", share).alias("shapley"),
    )
