"""Reranking of (query, text) pairs by a model that scores batches, for many queries at once; and a pair model trained on a bounded sample.

A model comes as a ``load`` function. Each task calls it once and gets a function from a batch of queries and texts to scores before the sigmoid. Only
the two texts of a pair go to Python. The best k of a query are cut before the shuffle as well as after it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Scores = Callable[[list[str], list[str]], np.ndarray]

#: Pairs that a model gets in one call, at most.
BATCH = 256
#: Labelled pairs that a pair model is fitted on, at most.
MOST_PAIRS = 4000
_WORD = re.compile(r"\S+", re.ASCII)


def _words(t: str) -> list[str]:
    return _WORD.findall(t.lower())


def overlap(queries: list[str], texts: list[str]) -> np.ndarray:
    """Share of the query's distinct words in the text, from -4 (none) to 4 (all)."""
    asked = [set(_words(q)) for q in queries]
    return np.array([8.0 * len(a & set(_words(t))) / max(1, len(a)) - 4 for a, t in zip(asked, texts, strict=True)])


def score_pairs(df: DataFrame, load: Callable[[], Scores], query: str = "query", text: str = "text", name: str = "rerank_score") -> DataFrame:
    """Add the model's score of each row's pair, in (0, 1); a null text is an empty one."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            q, t = q.fillna("").tolist(), t.fillna("").tolist()
            out = [model(q[at : at + BATCH], t[at : at + BATCH]) for at in range(0, len(q), BATCH)]
            yield pd.Series(1 / (1 + np.exp(-np.concatenate(out)))) if out else pd.Series([], dtype=float)

    return df.withColumn(name, run(F.col(query).cast("string"), F.col(text).cast("string")))


def rerank_each(df: DataFrame, by: str, tie: str, k: int, load: Callable[[], Scores], query: str = "query", text: str = "text") -> DataFrame:
    """The k best rows of each ``by``, with ``rerank_score`` and ``rank`` from 1; equal scores go to the smaller ``tie``. Null keys are one key."""
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), tie)
    return score_pairs(df, load, query, text).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _trigrams(t: str) -> Counter:
    t = f" {' '.join(_words(t))} "
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def pair_features(queries: list[str], texts: list[str]) -> np.ndarray:
    """Per pair: one, share of the query's words found, their Jaccard similarity, cosine of character trigrams, difference of the logarithms of lengths."""
    rows = []
    for q, t in zip(queries, texts, strict=True):
        a, b = _words(q), _words(t)
        x, y = set(a), set(b)
        g, h = _trigrams(q), _trigrams(t)
        size = np.sqrt(sum(v * v for v in g.values()) * sum(v * v for v in h.values()))
        both = len(x & y)
        rows.append((1.0, both / max(1, len(x)), both / max(1, len(x | y)), sum(v * h[s] for s, v in g.items()) / size if size else 0.0, abs(np.log1p(len(a)) - np.log1p(len(b)))))
    return np.array(rows).reshape(len(rows), 5)


def fit_pairs(pairs: DataFrame, query: str = "query", text: str = "text", label: str = "label", most: int = MOST_PAIRS, rounds: int = 20) -> list[float]:
    """Weights of a logistic model of ``pair_features``, from the ``most`` pairs with the smallest hashes; the features are found in tasks.

    Without both labels in the sample all weights are 0, and every pair scores one half.
    """

    @F.pandas_udf("array<double>")
    def features(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(list(pair_features(q.fillna("").tolist(), t.fillna("").tolist())))

    some = pairs.select(F.col(query).cast("string").alias("q"), F.col(text).cast("string").alias("t"), F.col(label).cast("double").alias("y")).filter("y is not null")
    some = some.orderBy(F.xxhash64("q", "t", "y"), "q", "t", "y").limit(most)
    got = some.select(features("q", "t").alias("x"), "y").toArrow()
    y = got["y"].to_numpy()
    w = np.zeros(5)
    if len(np.unique(y)) < 2:
        return w.tolist()
    x = np.array(got["x"].to_pylist())
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(5), x.T @ (y - p) - 1e-3 * w)
    return w.tolist()


def pair_model(weights: list[float]) -> Callable[[], Scores]:
    """``load`` of a fitted pair model."""
    return lambda: lambda queries, texts: pair_features(queries, texts) @ np.array(weights)
