"""Speaker attribution from words, turns, profiles and similarities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions.quality import low_confidence
from lyrebird.functions.vector import cosine, doubles
from lyrebird.operators.bounds import broadcast_if_small, small
from lyrebird.schemas import UNKNOWN

# Thresholds of attribution.
MARGIN, MIN_CLUSTER_S, OVERLAP_EXTRA = 0.05, 3.0, 0.03

#: Vectors of one key that are added up in one task, at most.
KEY_ROWS = 50_000


def majority_label(words: DataFrame, by: list[str], label: str = "label", confidence: str = "confidence", start: str = "start_sec") -> DataFrame:
    """Per group the label of most words, the first spoken of equals, with its mean confidence."""
    votes = words.groupBy(*by, label).agg(F.count("*").alias("votes"), F.avg(confidence).alias("mean_confidence"), F.min(start).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("votes"), "_first", label)
    return votes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_first")


def boosted(similarity: Column, seconds: Column) -> Column:
    """Similarity times 1.05 over 10 s of speech, 1.02 over 5 s; it may pass 1."""
    return similarity * F.when(seconds > 10, 1.05).when(seconds > 5, 1.02).otherwise(1.0)


def attribute_clusters(clusters: DataFrame, profiles: DataFrame, margin: float = MARGIN, least_s: float = MIN_CLUSTER_S) -> DataFrame:
    """cluster, label, similarity and second best: clusters (cluster, seconds, centroid) against profiles (name, centroid, threshold).

    Profiles are few and named by hand; they are broadcast as one packed row, after a check of their number, and no pair is made. A label
    needs enough speech, the profile's threshold on the boosted similarity, and a margin of the raw similarity over the next distinct one.
    Of equal profiles the first name wins; similarity is the boosted one, second the next distinct raw one, null without one.
    """
    p = small(profiles.select("name", "centroid", "threshold"), "voice profiles")
    packed = F.broadcast(p.agg(F.array_sort(F.collect_list(F.struct("name", "centroid", "threshold"))).alias("_p")))
    scored = F.transform("_p", lambda x: F.struct((-cosine(F.col("centroid"), x["centroid"])).alias("s"), x["name"].alias("name"), x["threshold"].alias("threshold")))
    best = clusters.join(packed, F.lit(True)).withColumn("_p", scored).withColumn("_b", F.array_min("_p"))
    raw = -F.col("_b.s")
    second = F.array_max(F.transform(F.filter("_p", lambda x: -x["s"] < raw), lambda x: -x["s"]))
    value = boosted(raw, F.col("seconds"))
    best = best.select("cluster", "seconds", F.col("_b.name").alias("name"), F.col("_b.threshold").alias("threshold"), raw.alias("raw"), value.alias("similarity"), second.alias("second"))
    known = (F.col("seconds") >= least_s) & (F.col("similarity") > 0) & (F.col("similarity") >= F.col("threshold")) & (F.col("second").isNull() | (F.col("raw") - F.col("second") >= margin))
    return best.select("cluster", F.when(known, F.col("name")).otherwise(UNKNOWN).alias("label"), "similarity", "second")


def strict_label(label: Column, confidence: Column, n_overlaps: Column, threshold: float) -> Column:
    """Unknown where several turns overlap and the confidence isn't clearly over the threshold."""
    return F.when((n_overlaps > 1) & (confidence < threshold + OVERLAP_EXTRA), UNKNOWN).otherwise(label)


def is_monologue(similarities: Column, threshold: Column, from_centroid: Column) -> Column:
    """Mean of the first five similarities against a softened threshold."""
    first = F.slice(similarities, 1, 5)
    mean = F.aggregate(first, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(first), F.lit(1))
    least = F.when(from_centroid, F.greatest(threshold * 0.9, threshold - 0.03)).otherwise(F.greatest(threshold * 0.8, threshold - 0.05))
    return (F.size(first) > 0) & (mean >= least)


def threshold_of(n: Column, mean: Column, deviation: Column, sigmas: float = 3.0) -> Column:
    """max(0.5, mean - 3 population standard deviations), 0.7 for fewer than two similarities."""
    return F.when(n < 2, 0.7).otherwise(F.greatest(F.lit(0.5), mean - sigmas * deviation))


def profile_threshold(similarities: DataFrame, by: str, column: str = "similarity", sigmas: float = 3.0) -> DataFrame:
    """The threshold of each key's similarities."""
    agg = similarities.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_pop(column).alias("d"))
    return agg.select(by, threshold_of(F.col("n"), F.col("m"), F.col("d"), sigmas).alias("threshold"))


def pair_similarities(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Per key with two vectors or more: n_pairs, mean and population deviation of the cosines of all pairs, without making a pair.

    With unit vectors u, the cosines of all pairs sum to (|sum u|^2 - sum |u|^2) / 2 and their squares to
    (|sum u u'|^2 - sum |u|^4) / 2. A key of up to ``KEY_ROWS`` vectors is added up in one task, which passes on the two sums' squares alone; a larger
    one is dealt to several tasks, each of which passes on its sums, however many batches it reads. A zero vector has similarity 0; null keys and
    vectors take no part; all vectors have one length.
    """
    known = df.select(by, doubles(F.col(vector)).alias("v"), F.spark_partition_id().alias("_p")).filter(F.col(by).isNotNull() & F.col("v").isNotNull())
    tasks = F.ceil(F.col("_n") / KEY_ROWS).cast("int")
    large = known.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > KEY_ROWS).select(by, tasks.alias("_tasks"))
    dealt = known.join(broadcast_if_small(large), by, "left").select(by, "v", F.col("_tasks").isNull().alias("whole"), F.coalesce(F.col("_p") % F.col("_tasks"), F.lit(0)).alias("_at"))
    ordered = dealt.repartition(by, "_at").sortWithinPartitions(by).select(by, "v", "whole")
    kind = known.schema[by].dataType.simpleString()
    parts = ordered.mapInArrow(_key_sums, f"`{by}` {kind}, n long, some double, ones int, cells array<double>")
    cells = parts.select(by, "n", "some", "ones", F.posexplode("cells").alias("pos", "x")).groupBy(by, "ones", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("some").alias("some"))
    square = F.col("x") * F.col("x")
    sums = cells.groupBy(by).agg(F.max("n").alias("n"), F.max("some").alias("some"), F.sum(F.when(F.col("pos") < F.col("ones"), square)).alias("one"), F.sum(F.when(F.col("pos") >= F.col("ones"), square)).alias("two"))
    pairs = sums.filter("n > 1").withColumn("n_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    mean, squares = (F.col("one") - F.col("some")) / 2 / F.col("n_pairs"), (F.col("two") - F.col("some")) / 2 / F.col("n_pairs")
    return pairs.select(by, "n_pairs", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)).alias("deviation"))


def _key_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their key: per key the number of vectors and of those that aren't zero, the sum of the unit vectors and of their outer
    products, or the lengths of both sums where the key is whole. One key is held at a time."""
    out: list[tuple] = []
    held = None

    def closed() -> tuple:
        key, whole, n, some, one, two = held
        sums = np.array([np.sqrt((one * one).sum()), np.sqrt((two * two).sum())]) if whole else np.concatenate([one, two.ravel()])
        return key, n, some, 1 if whole else len(one), sums

    def rows() -> pa.RecordBatch:
        key, n, some, ones, sums = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(n, pa.int64()), pa.array(some, pa.float64()), pa.array(ones, pa.int32()), pa.array(sums, pa.list_(pa.float64()))], [name, "n", "some", "ones", "cells"])

    for b in batches:
        if not b.num_rows:
            continue
        name, kind = b.schema.field(0).name, b.schema.field(0).type
        u = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
        size = np.linalg.norm(u, axis=1, keepdims=True)
        u = np.divide(u, size, out=np.zeros_like(u), where=size > 0)
        runs = pc.run_end_encode(b.column(0))
        lo = 0
        for key, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if held is None or held[0] != key:
                if held is not None:
                    out.append(closed())
                held = [key, b.column(2)[lo].as_py(), 0, 0.0, np.zeros(u.shape[1]), np.zeros((u.shape[1], u.shape[1]))]
            x = u[lo:hi]
            held[2] += len(x)
            held[3] += float((size[lo:hi] > 0).sum())
            held[4] += x.sum(axis=0)
            held[5] += x.T @ x
            lo = hi
        if out:
            yield rows()
            out = []
    if held is not None:
        out.append(closed())
        yield rows()


def speaker_stats(df: DataFrame, label: str = "speaker_label") -> DataFrame:
    """Rows, seconds, mean length and share of all seconds per speaker; of the columns that are there also the least, largest and mean confidence,
    and the numbers of refined and embedded rows. The total is a one-row aggregate, not a global window."""
    seconds = F.col("end_sec") - F.col("start_sec")
    more = []
    if "speaker_conf" in df.columns:
        more += [f("speaker_conf").alias(f"{name}_conf") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    if "re_asr" in df.columns:
        more.append(F.count_if(F.coalesce("re_asr", F.lit(False))).alias("n_refined"))
    if "embedding" in df.columns:
        more.append(F.count("embedding").alias("n_embedded"))
    per = df.groupBy(label).agg(F.count("*").alias("n_segments"), F.sum(seconds).alias("seconds"), F.avg(seconds).alias("avg_seconds"), *more)
    total = per.agg(F.sum("seconds").alias("_all"))
    return per.join(F.broadcast(total), F.lit(True)).withColumn("share_pct", F.when(F.col("_all") > 0, 100.0 * F.col("seconds") / F.col("_all")).otherwise(0.0)).drop("_all")


def quality_means(df: DataFrame) -> DataFrame:
    """One row: means of the quality metrics (missing ones neutral), number and share of low-confidence segments, number without a known speaker."""
    low = low_confidence(F.coalesce("avg_logprob", F.lit(0.0)), F.coalesce("compression_ratio", F.lit(1.0)))
    out = df.agg(
        F.count("*").alias("n_segments"),
        F.avg(F.coalesce("avg_logprob", F.lit(0.0))).alias("avg_logprob_mean"),
        F.avg(F.coalesce("compression_ratio", F.lit(1.0))).alias("compression_ratio_mean"),
        F.avg(F.coalesce("no_speech_prob", F.lit(0.0))).alias("no_speech_prob_mean"),
        F.count_if(low).alias("n_low_conf"),
        F.count_if(F.col("speaker_label") == UNKNOWN).alias("n_unknown"),
    )
    return out.withColumn("low_conf_pct", F.when(F.col("n_segments") > 0, 100.0 * F.col("n_low_conf") / F.col("n_segments")).otherwise(0.0))


def threshold_share(similarities: DataFrame, by: str, column: str = "similarity", threshold: float = 0.62) -> DataFrame:
    """Per key the least, mean and largest similarity and the per cent of at least ``threshold``."""
    s = F.col(column)
    return similarities.groupBy(by).agg(F.count(s).alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("most"), (100.0 * F.count_if(s >= threshold) / F.nullif(F.count(s), F.lit(0))).alias("above_pct"))


def speaker_map(df: DataFrame, by: str, label: str = "speaker_label") -> DataFrame:
    """Per key a map from speaker to its share of the key's seconds in per cent, and the speaker with most; 0 for all where there are no seconds.

    A key's total is added up in the order in which its speakers first speak, so that it doesn't hang on the order in which groups arrive.
    """
    seconds = df.groupBy(by, label).agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("s"), F.min("start_sec").alias("_first"))
    spoken = F.array_sort(F.collect_list(F.struct(F.col("_first").alias("first"), F.col(label).alias("k"), F.col("s").alias("v"))))
    total = F.aggregate("_by_first", F.lit(0.0), lambda t, x: t + F.coalesce(x["v"], F.lit(0.0)))
    pairs = seconds.filter(F.col(label).isNotNull()).groupBy(by).agg(spoken.alias("_by_first")).withColumn("t", total)
    pairs = pairs.withColumn("p", F.array_sort(F.transform("_by_first", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))))
    share = F.map_from_entries(F.transform("p", lambda x: F.struct(x["k"], F.when(F.col("t") > 0, 100.0 * x["v"] / F.col("t")).otherwise(0.0))))
    most = F.array_min(F.transform("p", lambda x: F.struct((-x["v"]).alias("v"), x["k"].alias("k"))))["k"]
    return pairs.select(by, share.alias("shares"), most.alias("main_speaker"))
