"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import drop_scratch, materialize

#: Edges that a task of a round writes, about.
ROWS_PER_TASK = 200_000


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (a long, b long) -> (node, root): root is the smallest node reachable; nodes without links are absent.

    Every round is written to the shared folder; nothing but a row count and a checksum reaches the driver. The result reads
    the last round's table, its ``scratch``.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        # a round leaves at most twice the edges: small ones go to few files
        nxt = materialize(small.filter("a <> b").distinct().coalesce(max(8, 2 * seen[0] // ROWS_PER_TASK)), name)
        now = _fingerprint(nxt)
        drop_scratch(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.scratch = edges.scratch
    return out
