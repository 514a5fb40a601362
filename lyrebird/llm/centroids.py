"""Centroid clustering of integer vectors, exact: GEMM expansion of distances in blocks, sums combined by an RDD tree aggregation.

A vector takes part if it has exactly ``DIMS`` components, none null or non-finite; a component x becomes the integer floor(256 * x). Blocks of at most
``BLOCK`` vectors are stored once, in the narrowest integers that hold them, and every round reads them. A block's distances to all centroids are
|x|^2 - 2 x.c + |c|^2 by one BLAS product of float64: rows whose magnitudes bound every partial sum below 2^53 are exact that way, whatever
order BLAS adds in; the others are computed in 64-bit integers, or in Python's own where those would not do either. Each task adds up the
vectors of its blocks, ``treeAggregate`` merges the tasks' sums, and only ``k`` centroids ever reach the driver.

Defined results: ties go to the smaller cluster number. Fewer vectors than ``k`` give fewer centroids. Of rows that share a vec_id, and so
a hash, the smaller vector seeds first; vectors without a vec_id seed after all others. Every row of a repeated vector is assigned and counted. A
distance or inertia over 2^63 - 1 is null. An empty table, or one without such vectors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import cap_batches, materialize

DIMS = 64
SCALE = 256
BLOCK = 4096
#: Doubles hold every integer below this.
EXACT = 1 << 53
LONG = 1 << 63
_BLOCKS = "ids array<long>, kind string, data binary"
_ASSIGNED = "vec_id long, cluster int, distance long"

#: Per cluster: number of vectors, componentwise sums, summed distances; Python integers, so nothing overflows.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles: int64, or Python integers if one doesn't fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if not x.size or np.abs(y).max() < LONG:
        return y.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """A block's integers in the narrowest type."""
    if x.dtype == object:
        return "big", json.dumps(x.tolist()).encode()
    most = max(abs(int(x.min())), abs(int(x.max())))
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits or bits == 63)
    return kind, x.astype(kind).tobytes()


def unpack(kind: str, data: bytes) -> np.ndarray:
    if kind == "big":
        return np.array(json.loads(data), object).reshape(-1, DIMS)
    return np.frombuffer(data, kind).astype(np.int64).reshape(-1, DIMS)


def _products(x: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    """All squared distances by the expansion, in one type of number."""
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of a block; ``c`` are Python integers."""
    top = np.abs(x).max(axis=1).astype(object) if x.dtype == object else np.maximum(np.abs(x.max(axis=1)), np.abs(x.min(axis=1)))
    reach = int(np.abs(c).max())
    # no partial sum of |x|^2, 2 x.c, |c|^2 or of the three together is larger than dims * (|x| + |c|)^2
    root = lambda most: max(-1, int((most / x.shape[1]) ** 0.5) - reach - 2)
    steps = np.where(top <= root(EXACT), 0, np.where(top <= root(LONG), 1, 2))
    label, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for step, kind in enumerate((np.float64, np.int64, object)):
        at = np.flatnonzero(steps == step)
        if at.size:
            d = _products(x[at], c, kind)
            best = np.argmin(d, axis=1) if kind is not object else np.array([min(range(len(r)), key=r.__getitem__) for r in d])
            label[at] = best
            found = d[np.arange(at.size), best]
            distance[at] = found.astype(np.int64).tolist() if kind is not object else found
    return label, distance


def zero(k: int) -> Sums:
    return np.zeros(k, object), np.zeros((k, DIMS), object), np.zeros(k, object)


def add_block(acc: Sums, block, c: np.ndarray) -> Sums:
    """A block's vectors, each added to its nearest centroid's sums."""
    x = unpack(block["kind"], bytes(block["data"]))
    label, distance = nearest(x, c)
    counts, sums, inertia = acc
    order = np.argsort(label, kind="stable")
    firsts = np.flatnonzero(np.diff(label[order], prepend=-1))
    rows = x[order]
    wide = x.dtype == object or len(x) * int(np.abs(x).max()) >= LONG
    parts = np.add.reduceat(rows.astype(object) if wide else rows, firsts, axis=0)
    for i, first in enumerate(firsts):
        at = order[first : firsts[i + 1] if i + 1 < len(firsts) else None]
        n = label[at[0]]
        counts[n] += len(at)
        sums[n] += np.array(parts[i].tolist(), object)
        inertia[n] += sum(distance[at].tolist())
    return acc


def merge(a: Sums, b: Sums) -> Sums:
    return tuple(x + y for x, y in zip(a, b))


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            kind, data = pack(whole_numbers(x))
            ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], ["ids", "kind", "data"])


def _small(n: int) -> int | None:
    return n if n < LONG else None


def _assigner(c: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                label, distance = nearest(unpack(kind, data.as_py()), c)
                far = pa.array(map(_small, distance.tolist()), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values.cast(pa.int64()), pa.array(label, pa.int32()), far], ["vec_id", "cluster", "distance"])

    return assign


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    cap_batches(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    kept = given.filter((F.size("v") == DIMS) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    blocks = materialize(kept.mapInArrow(_pack_blocks, _BLOCKS), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(name), "v").limit(k).select("v").collect()  # k rows
    if not first:
        return spark.createDataFrame([], f"{_ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    c = whole_numbers(np.array([r["v"] for r in first], np.float64)).astype(object)
    for _ in range(rounds):
        counts, sums, _ = _gather(blocks, c)
        for n in np.flatnonzero(counts):
            c[n] = [s // int(counts[n]) for s in sums[n].tolist()]
    _, _, inertia = _gather(blocks, c)
    total = _small(sum(inertia.tolist()))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    about = spark.createDataFrame([(n, _small(inertia[n]), total, digests[n]) for n in range(len(c))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return blocks.mapInArrow(_assigner(c), _ASSIGNED).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _gather(blocks: DataFrame, c: np.ndarray) -> Sums:
    """Sums of all vectors by nearest centroid: each task its own, then merged in a tree."""
    return blocks.rdd.treeAggregate(zero(len(c)), lambda acc, b: add_block(acc, b, c), merge, depth=2)
