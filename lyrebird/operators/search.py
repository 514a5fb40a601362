"""Keyword search: filters, match classes, total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.text import escaped_like
from lyrebird.schemas import PROVENANCES


def contains(c: Column, term: str) -> Column:
    """The term as a substring, whatever its case; its % and _ are no wildcards."""
    return c.ilike(escaped_like(term))


def match_class(c: Column, term: str) -> Column:
    """1 exact case, 2 a whole word, 3 a substring."""
    quoted = term.replace("\\E", "\\E\\\\E\\Q")
    return F.when(F.contains(c, F.lit(term)), 1).when(c.rlike(rf"(?i)\b\Q{quoted}\E\b"), 2).otherwise(3)


def keyword(df: DataFrame, term: str, column: str = "text") -> DataFrame:
    """Rows that contain the term, with their match class."""
    return df.filter(contains(F.col(column), term)).withColumn("match_class", match_class(F.col(column), term))


def in_title_or_text(df: DataFrame, term: str, title: str, text: str = "text", score: str = "similarity") -> DataFrame:
    """Rows with the term in either column, best first by a score that is text; a score that is no number comes last."""
    hits = df.filter(contains(F.col(title), term) | contains(F.col(text), term))
    return hits.orderBy(F.desc_nulls_last(F.col(score).try_cast("double")))


def of_type(df: DataFrame, value: str, column: str = "source") -> DataFrame:
    return df if value == "all" else df.filter(F.col(column) == value)


def of_year(df: DataFrame, year: int, column: str) -> DataFrame:
    """Null dates drop out. A range of dates, so that the scan can skip by it."""
    first, after = (F.expr(f"TIMESTAMP_NTZ '{y:04d}-01-01 00:00:00'").cast(df.schema[column].dataType) for y in (year, year + 1))
    return df.filter((F.col(column) >= first) & (F.col(column) < after))


def ranked(df: DataFrame, *order: Column, limit: int, tie: str) -> DataFrame:
    """The first rows of a total order: ``tie`` ends it."""
    return df.orderBy(*order, F.col(tie).asc()).limit(limit)


def provenance_rank(c: Column) -> Column:
    """Owner transcripts first, then captions, then recognition, then others; null counts as yt_caption."""
    known = F.coalesce(c, F.lit("yt_caption"))
    out = F
    for rank, name in enumerate(PROVENANCES, 1):
        out = out.when(known == name, rank)
    return out.otherwise(len(PROVENANCES) + 1)
