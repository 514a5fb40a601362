"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

A vector is cut into subspaces of ``SUB_DIM`` components, each coded by one of 16 centres (four bits). Codes and centres
minimise an anisotropic loss: of the residual, the part parallel to the vector, which is what changes large inner
products, weighs ``eta`` times the rest. Euclidean nearness becomes an inner product: -|q - x|^2 / 2 is q.x - |x|^2 / 2
up to a constant, so a query scans tables of 16 partial products per subspace and subtracts the stored half norm.
The best of each block of rows are reranked by exact distances on the original vectors.

Centres are learned from at most ``SAMPLE`` vectors (by hash of vec_id); every row is coded and scanned. Queries are taken in slices of
``QUERY_SLICE``, which bounds what is broadcast. Each task keeps the nearest k per query over all its blocks.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows without vec_id, take no part;
vectors are compared with those of their own length; ties go to the smaller vec_id; a row never finds rows with its own
vec_id; repeated rows are candidates as often as they occur, and repeated query rows count once; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.llm.common import materialize

SAMPLE = 10_000
QUERY_SLICE = 4096
SUB_DIM = 4
CENTRES = 16
#: Rows of a block that are reranked exactly for each query.
RERANK = 200
#: Rows scanned at once.
BLOCK = 10_000
#: Queries scanned at once.
TILE = 64

_FOUND = "query_no long, query_id long, vec_id long, score double"


def eta_of(dim: int, threshold: float = 0.2) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` of the norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _padded(x: np.ndarray) -> np.ndarray:
    spare = -x.shape[1] % SUB_DIM
    return np.pad(x, ((0, 0), (0, spare))) if spare else x


class Quantiser:
    """Centres of all subspaces: an array (subspaces, 16, SUB_DIM)."""

    def __init__(self, centres: np.ndarray, eta: float) -> None:
        self.centres, self.eta = centres, eta

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, seed: int = 5) -> Quantiser:
        rng = np.random.default_rng(seed)
        eta = eta_of(x.shape[1])
        x = _padded(x.astype(np.float64))
        parts = x.reshape(len(x), -1, SUB_DIM)
        pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self = cls(parts[pick].transpose(1, 0, 2).copy(), eta)
        norm2 = np.maximum((x**2).sum(axis=1), 1e-30)
        codes = self.encode(x)
        for _ in range(rounds):
            weight = (eta - 1) / norm2
            rest = self._parallel(parts, codes)
            for m in range(parts.shape[1]):
                part = parts[:, m]
                mine = np.einsum("nd,nd->n", part - self.centres[m][codes[:, m]], part)
                others = rest - mine
                for c in range(CENTRES):
                    at = codes[:, m] == c
                    if not at.any():
                        self.centres[m, c] = part[rng.integers(len(part))]
                        continue
                    p, w = part[at], weight[at]
                    left = at.sum() * np.eye(SUB_DIM) + (p * w[:, None]).T @ p
                    right = p.sum(axis=0) + ((w * (others[at] + (p**2).sum(axis=1)))[:, None] * p).sum(axis=0)
                    self.centres[m, c] = np.linalg.solve(left, right)
                rest = others + np.einsum("nd,nd->n", part - self.centres[m][codes[:, m]], part)
            codes = self.encode(x)
        return self

    def _parallel(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner product of each vector with its residual."""
        return sum(np.einsum("nd,nd->n", parts[:, m] - self.centres[m][codes[:, m]], parts[:, m]) for m in range(parts.shape[1]))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) that descend the anisotropic loss one subspace at a time."""
        x = _padded(np.asarray(x, np.float64))
        parts = x.reshape(len(x), -1, SUB_DIM)
        weight = (self.eta - 1) / np.maximum((x**2).sum(axis=1), 1e-30)
        subs = parts.shape[1]
        dist = [((parts[:, m, None, :] - self.centres[m][None]) ** 2).sum(axis=2) for m in range(subs)]
        along = [np.einsum("nd,nd->n", parts[:, m], parts[:, m])[:, None] - parts[:, m] @ self.centres[m].T for m in range(subs)]
        codes = np.stack([d.argmin(axis=1) for d in dist], axis=1)
        rows = np.arange(len(x))
        rest = sum(along[m][rows, codes[:, m]] for m in range(subs))
        for _ in range(sweeps):
            for m in range(subs):
                others = rest - along[m][rows, codes[:, m]]
                codes[:, m] = (dist[m] + weight[:, None] * (others[:, None] + along[m]) ** 2).argmin(axis=1)
                rest = others + along[m][rows, codes[:, m]]
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial inner products (subspaces, queries, 16)."""
        q = _padded(queries.astype(np.float64)).reshape(len(queries), -1, SUB_DIM)
        return np.einsum("qmd,mcd->mqc", q, self.centres).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def unpack_codes(packed: np.ndarray, subs: int) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :subs]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats or doubles as they are) and dim of the rows that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(rows: DataFrame, quantiser: Quantiser, dim: int) -> DataFrame:
    """vec_id, packed four-bit codes, half squared norm and the vector of every row."""
    centres, eta = quantiser.centres, quantiser.eta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(centres, eta)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _matrix(part.column(1), dim)
                packed = pack_codes(q.encode(x))
                half = (x.astype(np.float64) ** 2).sum(axis=1) / 2
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(half), part.column(1)], ["vec_id", "codes", "half", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, codes binary, half double, embedding {kind}")


def _keep_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows that aren't past the first k of equal vectors; the others can't be among k nearest."""
    order = np.argsort(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), kind="stable")
    same = np.r_[False, (x[order][1:] == x[order][:-1]).all(axis=1)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
    out = np.empty(len(x), bool)
    out[order] = np.arange(len(x)) - first < k
    return out


class Nearest:
    """Running k nearest of a slice of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, quantiser: Quantiser, k: int, rerank: int) -> None:
        self._ids, self._q, self._k, self._rerank = ids, vectors.astype(np.float64), k, rerank
        self._tables = quantiser.tables(vectors)
        self.score = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, codes: np.ndarray, half: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        order = order[_keep_first(x[order], self._k + 1)]
        ids, codes, half, x = ids[order], codes[order], half[order].astype(np.float32), x[order].astype(np.float64)
        codes = np.ascontiguousarray(codes.T)
        for at in range(0, len(self._ids), TILE):
            tile = slice(at, min(at + TILE, len(self._ids)))
            approx = np.repeat(-half[None, :], tile.stop - at, axis=0)
            for m, code in enumerate(codes):
                approx += self._tables[m, tile][:, code]
            self._rerank_tile(tile, ids, approx, x)

    def _rerank_tile(self, tile: slice, ids: np.ndarray, approx: np.ndarray, x: np.ndarray) -> None:
        n, take = approx.shape[1], min(self._rerank, approx.shape[1])
        floor = np.partition(approx, n - take, axis=1)[:, n - take]
        for i, q in enumerate(range(tile.start, tile.stop)):
            best = np.flatnonzero(approx[i] >= floor[i])
            best = best[ids[best] != self._ids[q]]
            d = np.sqrt(((x[best] - self._q[q]) ** 2).sum(axis=1))
            score, found = np.concatenate([self.score[q], d]), np.concatenate([self.found[q], ids[best]])
            top = np.lexsort((found, score))[: self._k]
            self.score[q], self.found[q] = score[top], found[top]


def _search_slice(index: DataFrame, quantiser: Quantiser, dim: int, numbers: list[int], ids: list[int], vectors: np.ndarray, k: int, rerank: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((np.array(numbers, np.int64), np.array(ids, np.int64), vectors, quantiser.centres, quantiser.eta))
    subs = quantiser.centres.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors, centres, eta = shared.value
        near = Nearest(ids, vectors, Quantiser(centres, eta), k, rerank)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                packed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                near.scan(part.column(0).to_numpy(), unpack_codes(packed, subs), part.column(2).to_numpy(), _matrix(part.column(3), dim))
        q, r = np.nonzero(np.isfinite(near.score))
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(ids[q]), pa.array(near.found[q, r]), pa.array(near.score[q, r])], ["query_no", "query_id", "vec_id", "score"])

    return index.select("vec_id", "codes", "half", "embedding").mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows of each query row."""
    spark = vectors.sparkSession
    rows, asked = valid(vectors), valid(queries)
    out = None
    for dim in sorted(r["dim"] for r in asked.select("dim").distinct().collect()):
        own = rows.filter(F.col("dim") == dim)
        learn = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
        if not learn.num_rows:
            continue
        quantiser = Quantiser.fit(_matrix(learn["embedding"].combine_chunks(), dim))
        index = materialize(build_index(own, quantiser, dim), "index")
        mine = asked.filter(F.col("dim") == dim).dropDuplicates(["vec_id", "embedding"])
        slices = max(1, -(-mine.count() // QUERY_SLICE))
        number = 0
        for s in range(slices):
            some = mine.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(slices)) == s).select("vec_id", "embedding").toArrow()
            if not some.num_rows:
                continue
            numbers = list(range(number, number + some.num_rows))
            number += some.num_rows
            found = _search_slice(index, quantiser, dim, numbers, some["vec_id"].to_pylist(), _matrix(some["embedding"].combine_chunks(), dim), k, rerank).withColumn("dim", F.lit(dim))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    by = Window.partitionBy("dim", "query_no").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
