"""Vector arithmetic on array columns, in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def guarded_cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def sampled_max(v: Column, profile: Column, most: int = 10) -> Column:
    """Largest guarded cosine against at most ``most`` evenly stepped vectors of a profile."""
    step = F.greatest(F.lit(1), F.floor(F.size(profile) / most).cast("int"))
    some = F.slice(F.filter(profile, lambda x, i: i % step == 0), 1, most)
    return F.array_max(F.transform(some, lambda p: guarded_cosine(v, p)))


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector per key: partial sums per position are combined before the shuffle."""
    cells = df.select(by, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centroid"))
