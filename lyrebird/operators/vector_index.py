"""Inverted-list vector index, stored: rows are written once, dealt to the list of their nearest centre, and a search reads the lists it probes.

A folder holds ``centres`` (list, centre) and ``rows``, partitioned by list. Centres are fitted on a bounded sample of directions (cosine doesn't see
lengths), rows are assigned by block products in Arrow batches; a list with very many rows is several files, and tasks. Rows may be added
at any time without refitting: they are appended to the lists of the stored centres. A search names its lists in a filter on the partition column,
so that files of other lists aren't listed or read. Probing all lists is an exact search.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, are kept in list -1, which only a full probe reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lyrebird.operators.vector_search import fit_cells, top_k

#: The column and folders of the lists, and the list of rows without direction.
LIST, NOWHERE = "list", -1
FEWEST_LISTS = 100

#: Rows and queries of a list that meet in one cell, about; queries and pairs that are scored at once in it; rounding of a block product of unit vectors, at most.
CELL_ROWS, CELL_QUERIES, BLOCK, PAIRS, SLACK = 4096, 8192, 512, 1 << 16, 1e-9


def lists_for(rows: int) -> int:
    """Lists of an index: the floor of the root of the rows, 100 at least."""
    return max(FEWEST_LISTS, math.isqrt(rows))


def _direction(vec: Column) -> Column:
    """Unit vector, or null where there is none."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # inside the lambda the norm is a value; outside it would be added up again for each component
    units = F.transform(F.array(norm), lambda n: F.when((F.size(v) > 0) & whole & (n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n)))
    return units[0]


def _nearest(centres: np.ndarray, vec: int):
    """Adds each row's list: that of the centre with the largest product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = b.column(vec)
            known = np.flatnonzero(units.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(b.num_rows, NOWHERE, np.int32)
            if known.size:
                x = units.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(known.size, -1)
                if x.shape[1] == centres.shape[1]:
                    out[known] = (x @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], LIST])

    return run


def _read_centres(spark: SparkSession, path: str) -> np.ndarray:
    """The centres in order: as many as there are lists, the root of the rows at first."""
    rows = spark.read.parquet(f"{path}/centres").orderBy(LIST).collect()
    return np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1)


def add(rows: DataFrame, path: str, vec: str = "embedding") -> None:
    """Append rows to the lists of the stored centres."""
    spark = rows.sparkSession
    centres = _read_centres(spark, path)
    unit = rows.withColumn("_unit", _direction(F.col(vec)))
    schema = StructType([*rows.schema, StructField(LIST, IntegerType())])
    placed = unit.mapInArrow(_nearest(centres, len(rows.columns)), schema)
    # by ranges of list and vector: few files a list, and a list with many rows is dealt to several tasks
    placed.repartitionByRange(LIST, F.xxhash64(vec)).write.mode("append").partitionBy(LIST).parquet(f"{path}/rows")


def build(rows: DataFrame, path: str, lists: int | None = None, rounds: int = 5, vec: str = "embedding", id_col: str = "vec_id", sample: int = 20_000) -> int:
    """Fit the centres on at most ``sample`` directions, write them and all rows; returns the number of lists."""
    units = rows.select(F.col(id_col), _direction(F.col(vec)).alias(vec)).filter(F.col(vec).isNotNull())
    fitted = fit_cells(units, lists or lists_for(rows.count()), rounds, vec, id_col, sample)
    fitted.select(F.col("cell").cast("int").alias(LIST), "centre").write.parquet(f"{path}/centres")
    add(rows, path, vec)
    return fitted.count()


def probed(spark: SparkSession, path: str, query: list[float], nprobe: int) -> list[int]:
    """The lists whose centres are most similar to the query; all, and the rows without direction, if ``nprobe`` is their number or more."""
    centres = _read_centres(spark, path)
    if nprobe >= len(centres):
        return [NOWHERE, *range(len(centres))]
    q = np.array(query, np.float64)
    norms = np.linalg.norm(centres, axis=1)
    return [int(i) for i in np.argsort(-(centres @ q) / np.where(norms > 0, norms, 1), kind="stable")[:nprobe]]


def rows_of(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The stored rows of some lists; files of others aren't read."""
    return spark.read.parquet(f"{path}/rows").filter(F.col(LIST).isin(lists))


def search(spark: SparkSession, path: str, query: list[float], k: int, nprobe: int, vec: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows most similar to the query among the probed lists, with ``score``; ties go to the smaller id."""
    return top_k(rows_of(spark, path, probed(spark, path, query, nprobe)), query, k, vec, tie)


def _matrix(arrays: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.asarray(arrays.combine_chunks().flatten(), np.float64).reshape(rows, -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns, added up in the order of components, as ``functions.vector.dot`` does."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def _best_of_cell(k: int):
    """The k best rows of each query in one cell. Block products only tell which rows may be among them; those are scored again, exactly as ``cosine``
    scores them. Of rows with one vector, the k first are enough."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_start"))  # a smaller place is a smaller id
        x, u = _matrix(rows.column("v"), rows.num_rows), _matrix(asked.column("u"), asked.num_rows)
        _, same = np.unique(x.view(f"V{x.strides[0]}").ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        first = np.r_[True, same[by][1:] != same[by][:-1]]
        nth = np.arange(len(by)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = np.sort(by[nth < k])
        xt, ut = np.ascontiguousarray(x[kept].T), np.ascontiguousarray(u.T)
        x_norm, u_norm = np.sqrt(_dots(xt, xt)), np.sqrt(_dots(ut, ut))
        unit = xt / x_norm
        out = []
        for lo in range(0, len(u), BLOCK):
            near = u[lo : lo + BLOCK] @ unit
            least = np.partition(near, -k, axis=1)[:, -k] - SLACK if near.shape[1] > k else np.full(len(near), -np.inf)
            q, r = np.nonzero(near >= least[:, None])
            q += lo
            score = np.concatenate([_dots(xt[:, r[i : i + PAIRS]], ut[:, q[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]) / (x_norm[r] * u_norm[q])
            best = np.lexsort((r, -score, q))
            q, r, score = q[best], r[best], score[best]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[top], kept[r[top]], score[top]))
        q, r, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": asked.column("q").take(pa.array(q)), "id": rows.column("id").take(pa.array(r)), "score": score})

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows and asked.num_rows:
            return run(rows, asked)
        return pa.table({"q": asked.column("q").slice(0, 0), "id": rows.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

    return cell


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, nprobe: int, query_id: str = "query_id", vec: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """query_id, rank, the tie column and score of many queries at once: queries meet the rows of their probed lists, and no others.

    A list's rows and the queries that probe it are dealt into shares by hashes of their ids; each pair of shares is a cell, scored as one block product,
    of which a query's k best go on.
    """
    centres, rows = _read_centres(spark, path), spark.read.parquet(f"{path}/rows").select(LIST, tie, vec)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centres.shape[1]))
            best = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(best), pa.list_(pa.int32()))], ["q", "u", "lists"])

    kind, tie_kind = dict(queries.dtypes)[query_id], dict(rows.dtypes)[tie]
    units = queries.select(F.col(query_id).alias("q"), _direction(F.col(vec)).alias("u")).filter("u is not null")
    wanted = units.mapInArrow(lists, f"q {kind}, u array<double>, lists array<int>").select("q", "u", F.explode("lists").alias(LIST))
    share = lambda most: F.ceil(F.count("*") / most).cast("int")
    shares = F.broadcast(rows.groupBy(LIST).agg(share(CELL_ROWS).alias("_rs")).join(wanted.groupBy(LIST).agg(share(CELL_QUERIES).alias("_qs")), LIST))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(shares, LIST).withColumn("_r", one_of(tie, "_rs")).withColumn("_q", each_of("_qs")).select(LIST, "_r", "_q", F.col(tie).alias("id"), F.col(vec).alias("v"))
    asked = wanted.join(shares, LIST).withColumn("_q", one_of("q", "_qs")).withColumn("_r", each_of("_rs")).select(LIST, "_r", "_q", "q", "u")
    cell = [LIST, "_r", "_q"]
    scored = held.groupBy(cell).cogroup(asked.groupBy(cell)).applyInArrow(_best_of_cell(k), f"q {kind}, id {tie_kind}, score double").withColumnRenamed("id", tie)
    order = Window.partitionBy("q").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", tie, "score")
