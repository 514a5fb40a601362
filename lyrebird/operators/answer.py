"""Ranking and packaging of answers: lexical rerank, confidence, citations, context package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions.text import words
from lyrebird.functions.time import m_ss, years_before

#: Rerankers by name; a model is registered as a function of (rows, query) that adds ``rerank_score``.
RERANKERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def reranker(name: str):
    def add(fn):
        RERANKERS[name] = fn
        return fn

    return add


@reranker("lexical")
def lexical(df: DataFrame, query: str) -> DataFrame:
    """Share of the query's distinct words in the text, through a sigmoid."""
    asked = sorted(set(query.lower().split()))
    have = F.array_distinct(words(F.lower("text")))
    share = F.size(F.array_intersect(have, F.array(*map(F.lit, asked)))) / F.lit(max(1, len(asked)))
    return df.withColumn("rerank_score", 1 / (1 + F.exp(-(share * 8 - 4))))


def rerank(df: DataFrame, query: str, k: int, tie: str, name: str | None = "lexical") -> DataFrame:
    """The best k by a registered reranker; without one, the first k by the tie."""
    if name is None:
        return df.orderBy(tie).limit(k)
    return RERANKERS[name](df, query).orderBy(F.desc("rerank_score"), tie).limit(k)


def confidence(llm: Column, n_valid: Column, n_cited: Column, avg_similarity: Column, n_chunks: Column, n_high: Column, recent: Column) -> Column:
    """Answer confidence in [0, 1] with two decimals; no citation means no coverage."""
    coverage = F.when(n_cited > 0, n_valid / n_cited).otherwise(0.0)
    c = llm * coverage * F.least(F.lit(1.0), avg_similarity * 2)
    c = F.when((n_chunks >= 5) & (coverage >= 0.8), F.least(F.lit(1.0), c * 1.15)).otherwise(c)
    c = F.when(n_high >= 3, F.least(F.lit(1.0), c * 1.1)).otherwise(c)
    return F.round(F.least(F.lit(1.0), F.when(recent, c * 1.1).otherwise(c)), 2)


def answer_confidence(chunks: DataFrame, citations: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """answer_id and confidence: chunks (answer_id, video_id, start_sec, similarity, published_at), citations (answer_id, video_id,
    timestamp m:ss) and answers (answer_id, llm_confidence). A citation is valid if a chunk has its video and time."""
    valid = citations.join(chunks.select("answer_id", "video_id", m_ss(F.col("start_sec")).alias("timestamp")).distinct(), ["answer_id", "video_id", "timestamp"], "left_semi")
    cited = citations.groupBy("answer_id").agg(F.count("*").alias("n_cited"))
    good = valid.groupBy("answer_id").agg(F.count("*").alias("n_valid"))
    had = chunks.groupBy("answer_id").agg(
        F.avg("similarity").alias("avg_similarity"),
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("similarity") > 0.7).alias("n_high"),
        F.max(F.coalesce(years_before(F.col("published_at"), as_of) <= 2, F.lit(False))).alias("recent"),
    )
    j = answers.join(had, "answer_id", "left").join(cited, "answer_id", "left").join(good, "answer_id", "left").fillna(0)
    value = confidence(F.col("llm_confidence"), F.col("n_valid"), F.col("n_cited"), F.col("avg_similarity"), F.col("n_chunks"), F.col("n_high"), F.coalesce("recent", F.lit(False)))
    return j.select("answer_id", value.alias("confidence"))


def prompt_package(chunks: DataFrame, by: str, order: Column, tie: str, k: int, title: str | None = None, text_chars: int | None = None) -> DataFrame:
    """Per ``by`` the numbered snippets "1. [title - id @ m:ss]: text" of its best k chunks, a blank line between them, and its citations id@m:ss.

    Texts are whole, unless ``text_chars`` cuts them. A null title is "Unknown Video", a null text empty.
    """
    w = Window.partitionBy(by).orderBy(order, tie)
    named = F.coalesce(F.col(title) if title else F.lit(None).cast("string"), F.lit("Unknown Video"))
    text = F.coalesce("text", F.lit(""))
    cut = text if text_chars is None else F.substring(text, 1, text_chars)
    ident, time = F.col(by).cast("string"), m_ss(F.col("start_sec"))
    line = F.concat(F.col("_n").cast("string"), F.lit(". ["), named, F.lit(" - "), ident, F.lit(" @ "), time, F.lit("]: "), cut)
    top = chunks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    rows = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line"), F.concat(ident, F.lit("@"), time).alias("cite")))).alias("r"))
    return rows.select(by, F.array_join(F.transform("r", lambda x: x["line"]), "\n\n").alias("prompt"), F.transform("r", lambda x: x["cite"]).alias("citations"))
