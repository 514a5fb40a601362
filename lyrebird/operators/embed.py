"""Embedding of texts: providers by name, a deterministic hashing one as the default, and rows that miss a vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.text import words
from lyrebird.operators.store import upsert

PROVIDERS: dict[str, Callable[[Column], Column]] = {}


def provider(name: str):
    def add(fn):
        PROVIDERS[name] = fn
        return fn

    return add


@provider("hashing")
def hashing_tf(text: Column, dim: int = 64) -> Column:
    """Signed hashing of words into ``dim`` buckets, scaled to unit length; null for a text without words.

    Words are cut and hashed in the JVM; a batch of texts is added up in one step, as a model would take it.
    """

    @F.arrow_udf("array<float>")
    def run(hashes: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        h = hashes.flatten().to_numpy(zero_copy_only=False)
        cell = np.repeat(np.arange(len(n)), n) * dim + h % dim
        v = np.bincount(cell, np.where(h >> 16 & 1, 1.0, -1.0), len(n) * dim).reshape(len(n), dim)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        unit = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        ends = np.arange(len(n) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel().astype(np.float32)), mask=pa.array(n == 0))

    return run(F.transform(words(F.lower(text)), lambda w: F.crc32(w)))


def embed(df: DataFrame, name: str = "hashing", text: str = "text") -> DataFrame:
    return df.withColumn("embedding", PROVIDERS[name](F.col(text)))


def embed_missing(df: DataFrame, key: list[str], name: str = "hashing") -> DataFrame:
    """Fill null embeddings, and touch nothing else."""
    missing = embed(df.filter(F.col("embedding").isNull()), name)
    return upsert(df, missing, key, only=("embedding",))
