"""Pick rows of wide tables by key without shuffling all of them. A key is any column expression of type string or long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import fresh, materialize
from lyrebird.llm.urlfilter import KEYS_A_BLOCK, MAX_BLOCKS, bloom_words, possible


def text_key(*more: Column | str, text: Column | str = "text") -> Column:
    """128 bits, as a string, of a row's text and of the further columns; null is a value of its own."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-"))
    return F.md5(F.concat(*(F.md5(known(c)) for c in more), known(text)))


def _marked(docs: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame | None:
    """The rows and ``name``: whether their key may be among ``keys`` (one column), by a Bloom filter of bounded size; a null key can't be.

    None without keys; true for all where the filter would be too full to tell. The filter is one broadcast row of at most 1 MB, not a
    constant, which every plan kept on the driver would spell out.
    """
    keys = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key is not null").distinct()
    n, blocks = keys.count(), 1
    if not n:
        return None
    if n > MAX_BLOCKS * KEYS_A_BLOCK:
        return docs.withColumn(name, key.isNotNull())
    while blocks * KEYS_A_BLOCK < n:
        blocks *= 2
    words = fresh((*docs.columns, name), "bloom")
    one = F.broadcast(materialize(bloom_words(keys, blocks), "bloom").select(F.col("bloom").alias(words)))
    hit = F.coalesce(possible(key.cast("string"), F.col(words), blocks), F.lit(False))
    return docs.join(one, F.lit(True)).withColumn(name, hit).drop(words)


def with_keys(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys``, and possibly some more; nothing is shuffled."""
    name = fresh(docs.columns, "hit")
    marked = _marked(docs, key, keys, name)
    return docs.limit(0) if marked is None else marked.filter(F.col(name)).drop(name)


def split_by_keys(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame | None, str]:
    """(rows whose key can't be among ``keys``, the possible ones with their key in one more column, that column's name).

    The first stay where they are; only the others need a join. None without keys.
    """
    name = fresh((*docs.columns, *keys.columns), "key")
    hit = fresh((*docs.columns, name), "hit")
    marked = _marked(docs, key, keys, hit)
    if marked is None:
        return docs, None, name
    return marked.filter(~F.col(hit)).drop(hit), marked.filter(F.col(hit)).drop(hit).withColumn(name, key), name


def without_keys(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``keys`` (one column). Rows with a null key stay.

    Rows that the Bloom filter rules out stay where they are, and only possible hits meet the keys in an anti join.
    """
    rest, hits, name = split_by_keys(docs, key, keys)
    if hits is None:
        return docs
    known = keys.select(F.col(keys.columns[0]).alias(name)).distinct()
    return rest.unionByName(hits.join(known, name, "left_anti").select(docs.columns))
