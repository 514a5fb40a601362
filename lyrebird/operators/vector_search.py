"""Exact vector search, and cell pruning by k-means cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.vector import cosine, doubles, l2, literal


def top_k(df: DataFrame, query: list[float], k: int, vec: str = "embedding", tie: str = "vec_id", measure: str = "cosine") -> DataFrame:
    """The k rows most similar (cosine) or nearest (l2), with ``score``; ties go to the smaller id."""
    score = cosine(F.col(vec), literal(query)) if measure == "cosine" else l2(F.col(vec), literal(query))
    order = F.desc("score") if measure == "cosine" else F.asc("score")
    return df.withColumn("score", score).orderBy(order, F.col(tie)).limit(k)


def top_k_like(df: DataFrame, vec_id: int, k: int, vec: str = "embedding", tie: str = "vec_id", measure: str = "cosine") -> DataFrame:
    """The same search for the vector of one row, as a scalar subquery: nothing comes to the driver. No such row, or a null vector, gives no rows; two such rows are an error."""
    asked = df.withColumn("_asked", df.filter(F.col(tie) == vec_id).select(doubles(F.col(vec))).scalar())
    score = cosine(F.col(vec), F.col("_asked")) if measure == "cosine" else l2(F.col(vec), F.col("_asked"))
    order = F.desc("score") if measure == "cosine" else F.asc("score")
    return asked.withColumn("score", score).drop("_asked").filter("score is not null").orderBy(order, F.col(tie)).limit(k)


def vector_of(df: DataFrame, vec_id: int, vec: str = "embedding", id_col: str = "vec_id") -> list[float]:
    """One row's vector: the query of a search by example."""
    row = df.filter(F.col(id_col) == vec_id).select(vec).first()
    if row is None:
        raise KeyError(f"{id_col} {vec_id} isn't in the table")
    return [float(x) for x in row[0]]


def fit_cells(df: DataFrame, cells: int, rounds: int = 5, vec: str = "embedding", id_col: str = "vec_id", sample: int = 20_000) -> DataFrame:
    """(cell, centre) of k-means over at most ``sample`` vectors, those with the smallest hashes of id, read once; the first of them are the seeds.

    A cell that loses all its vectors keeps its centre. ``cells`` bounds what is broadcast; every row is assigned, whatever the sample.
    """
    known = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"))
    rows = known.orderBy("h", "i").limit(sample).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    centres = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        near = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return df.sparkSession.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cell long, centre array<double>")


def assign_cells(df: DataFrame, centres: DataFrame, vec: str = "embedding") -> DataFrame:
    """Each row's nearest cell."""
    packed = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("cell", "centre"))).alias("_c")))
    best = F.array_min(F.transform("_c", lambda c: F.struct(l2(F.col(vec), c["centre"]).alias("d"), c["cell"].alias("cell"))))
    return df.join(packed, F.lit(True)).withColumn("cell", best["cell"]).drop("_c")


def probe(df_cells: DataFrame, centres: DataFrame, query: list[float], k: int, nprobe: int, vec: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """Top k by cosine among the rows of the ``nprobe`` cells nearest to the query."""
    near = centres.orderBy(l2(F.col("centre"), literal(query)), "cell").limit(nprobe).select("cell")
    return top_k(df_cells.join(F.broadcast(near), "cell", "left_semi"), query, k, vec, tie)
