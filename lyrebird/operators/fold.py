"""Greedy folds over the ordered rows of one media item, inside the JVM.

A fold walks the rows with a small state and gives every row a value, such as the number of the group it falls into. Only the order and the
columns that the step names are gathered, never texts; the values are joined back to the rows by key and order. Values are appended in blocks, so
that a step doesn't copy all values before it. Rows that share key and order are told apart by their rank, and are equal to a step in what it uses
or follow the order of that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a block.
BLOCK = 512

Step = Callable[[Column, Column], tuple[Column, Column]]


def fold_values(df: DataFrame, key: str, order: list[str], uses: dict[str, Column], state: Column, step: Step, kind: str, name: str) -> DataFrame:
    """Add ``name``: a value that ``step(state, row)`` gives for each row beside the next state.

    A row holds the columns of ``order`` and ``uses``; ``state`` is a struct.
    """
    ranked = df.withColumn("_t", F.row_number().over(Window.partitionBy(key, *order).orderBy(*uses.values())))
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "_t", *(c.alias(n) for n, c in uses.items())))).alias("rows"))
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("s"), none.alias("block"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))

    def walk(a: Column, r: Column) -> Column:
        value, after = step(a["s"], r)
        block = F.concat(a["block"], F.array(value.cast(kind)))
        full = F.size(a["block"]) >= BLOCK - 1
        return F.struct(after.alias("s"), F.when(full, none).otherwise(block).alias("block"), F.when(full, F.concat(a["blocks"], F.array(block))).otherwise(a["blocks"]).alias("blocks"))

    values = F.aggregate("rows", start, walk, lambda a: F.concat(F.flatten(a["blocks"]), a["block"]))
    places = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in order), r["_t"].alias("_t")))
    found = rows.select(key, F.explode(F.arrays_zip(places.alias("r"), values.alias("v"))).alias("z")).select(F.col(key).alias("_key"), *(F.col(f"z.r.{c}").alias(f"_{c}") for c in order), F.col("z.r._t").alias("_rank"), F.col("z.v").alias(name))
    same = F.col(key).eqNullSafe(F.col("_key"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # a rank that isn't a join key leaves the rows where the window has put them
    return ranked.join(found, same & (F.col("_t") - F.col("_rank") == 0)).select(*df.columns, name)


def fold_groups(df: DataFrame, key: str, order: list[str], uses: dict[str, Column], state: Column, step: Step, name: str = "no") -> DataFrame:
    """Add ``name``, the number from 0 of each row's group; ``step(state, row)`` gives whether the row begins a group, and the next state."""

    def numbered(a: Column, r: Column) -> tuple[Column, Column]:
        new, after = step(a["s"], r)
        no = a["no"] + F.when((a["no"] < 0) | new, 1).otherwise(0)
        return no, F.struct(after.alias("s"), no.alias("no"))

    return fold_values(df, key, order, uses, F.struct(state.alias("s"), F.lit(-1).alias("no")), numbered, "int", name)
