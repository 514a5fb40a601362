"""Segment optimiser: duration chunks, merges, splits, dedupe, cleaning; and hysteresis labels.

A segment is (media_id, seq, start_sec, end_sec, speaker_label, text) with the metrics of ``METRICS`` and flags of
``FLAGS``; missing ones are filled with their neutral values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions.text import clean_segment, trimmed
from lyrebird.operators.fold import fold_groups, fold_values
from lyrebird.schemas import GUEST, PRIMARY

METRICS = ("avg_logprob", "compression_ratio", "no_speech_prob", "temperature_used")
FLAGS = ("re_asr", "is_overlap", "needs_refinement")

# Limits of the optimiser.
MAX_GAP, MAX_MERGE_S, TARGET_MIN, TARGET_MAX, TINY, VERY_SHORT = 3.0, 60.0, 400, 1200, 30, 50
CHUNK_S = 45.0
HIGH, LOW, RUNS = 0.75, 0.68, 2


def complete(df: DataFrame) -> DataFrame:
    """All columns of a segment; text trimmed, null texts empty."""
    fill = {**dict.fromkeys(METRICS, F.lit(0.0)), **dict.fromkeys(FLAGS, F.lit(False)), "speaker_conf": F.lit(0.0), "original_count": F.lit(1)}
    have = [F.coalesce(F.col(c), fill[c]).alias(c) if c in df.columns else fill[c].alias(c) for c in fill]
    return df.select("media_id", "seq", "start_sec", "end_sec", "speaker_label", trimmed(F.coalesce("text", F.lit(""))).alias("text"), *have)


def duration_chunks(df: DataFrame, seconds: float = CHUNK_S) -> DataFrame:
    """Chunks of segments: one ends where the next segment would carry it past ``seconds``. Blank texts are left out."""
    rows = df.filter(F.length(trimmed(F.col("text"))) > 0).select("media_id", "start_sec", "seq", "end_sec", trimmed(F.col("text")).alias("text"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        new = r["end_sec"] - s["start"] > seconds
        return new, F.struct(F.when(s["start"].isNull() | new, r["start_sec"]).otherwise(s["start"]).alias("start"))

    out = fold_groups(rows, "media_id", ["start_sec", "seq"], {"end_sec": F.col("end_sec")}, F.struct(F.lit(None).cast("double").alias("start")), step, "chunk_index")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "seq", "text"))), lambda x: x["text"]), " ")
    return out.groupBy("media_id", "chunk_index").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", F.struct("start_sec", "seq")).alias("end_sec"), F.count("*").alias("n_rows"), text.alias("text"))


def combine(df: DataFrame) -> DataFrame:
    """One segment per (media_id, no), merged pair by pair in order.

    Texts are joined by a blank, confidence is the largest, metrics are weighted by durations, flags are or-ed, counts added.
    """
    rows = df.groupBy("media_id", "no").agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in df.columns if c not in ("media_id", "no", "seq"))))).alias("rows"))

    def add(a: Column, r: Column) -> Column:
        da, dr = a["end_sec"] - a["start_sec"], r["end_sec"] - r["start_sec"]
        wa = F.when(da + dr > 0, da / (da + dr)).otherwise(0.5)
        wr = F.when(da + dr > 0, dr / (da + dr)).otherwise(0.5)
        values = {
            "seq": a["seq"],
            "start_sec": a["start_sec"],
            "end_sec": r["end_sec"],
            "speaker_label": a["speaker_label"],
            "text": F.concat_ws(" ", a["text"], r["text"]),
            **{m: a[m] * wa + r[m] * wr for m in METRICS},
            **{f: a[f] | r[f] for f in FLAGS},
            "speaker_conf": F.greatest(a["speaker_conf"], r["speaker_conf"]),
            "original_count": a["original_count"] + r["original_count"],
        }
        return F.struct(*(v.alias(k) for k, v in values.items()))

    order = ["seq", "start_sec", "end_sec", "speaker_label", "text", *METRICS, *FLAGS, "speaker_conf", "original_count"]
    first = F.struct(*(F.col("rows")[0][c].alias(c) for c in order))
    merged = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), first, add)
    return rows.select("media_id", merged.alias("m")).select("media_id", "m.*")


def _merge_state() -> Column:
    return F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("chars"))


def _merge_uses() -> dict[str, Column]:
    return {"end_sec": F.col("end_sec"), "speaker_label": F.col("speaker_label"), "chars": F.length("text")}


def merge_short(df: DataFrame) -> DataFrame:
    """Neighbours of one speaker become one where they are short and close; the merged length counts from then on."""

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        n = r["chars"]
        near = s["label"].eqNullSafe(r["speaker_label"]) & (r["start_sec"] - s["end"] <= MAX_GAP) & (r["end_sec"] - s["start"] <= MAX_MERGE_S)
        small = (s["chars"] < TINY) | (n < TINY) | ((s["chars"] + n + 1 < TARGET_MAX) & ((s["chars"] < TARGET_MIN) | (n < TARGET_MIN)))
        join = F.coalesce(near & small, F.lit(False))
        return ~join, F.struct(
            F.when(join, s["start"]).otherwise(r["start_sec"]).alias("start"),
            r["end_sec"].alias("end"),
            r["speaker_label"].alias("label"),
            F.when(join, s["chars"] + n + 1).otherwise(n).alias("chars"),
        )

    return combine(fold_groups(df, "media_id", ["start_sec", "seq"], _merge_uses(), _merge_state(), step))


def split_long(df: DataFrame) -> DataFrame:
    """Segments of over 1.5 times the longest target are cut at sentences; time goes by characters, gapless from start to end."""
    pieces = F.split("text", r"[.!?]+\s+")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        longer = F.concat(a["cur"], s, F.lit(". "))
        cut = (F.length(longer) > TARGET_MAX) & (a["cur"] != "")
        return F.struct(F.when(cut, F.concat(s, F.lit(". "))).otherwise(longer).alias("cur"), F.when(cut, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"))

    cut = F.aggregate(pieces, start, add, lambda a: F.when(F.length(F.trim(a["cur"])) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    long = (F.length("text") > 1.5 * TARGET_MAX) & (F.size(pieces) > 1)
    parts = F.when(long, cut).otherwise(F.array("text"))
    out = df.withColumn("_parts", parts).withColumn("_total", F.greatest(F.lit(1), F.aggregate("_parts", F.lit(0), lambda n, p: n + F.length(p))))
    out = out.select("*", F.posexplode("_parts").alias("_k", "_part"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("_k")), F.lit(0), lambda n, p: n + F.length(p))
    span = F.col("end_sec") - F.col("start_sec")
    out = out.withColumn("_from", F.col("start_sec") + span * before / F.col("_total")).withColumn("_to", F.when(F.col("_k") == F.size("_parts") - 1, F.col("end_sec")).otherwise(F.col("start_sec") + span * (before + F.length("_part")) / F.col("_total")))
    out = out.withColumn("start_sec", F.col("_from")).withColumn("end_sec", F.col("_to")).withColumn("text", F.when(F.size("_parts") > 1, F.trim("_part")).otherwise(F.col("text")))
    by = Window.partitionBy("media_id").orderBy("seq", "_k")
    return out.withColumn("_seq", F.row_number().over(by) - 1).withColumn("seq", F.col("_seq").cast("int")).drop("_parts", "_total", "_k", "_part", "_from", "_to", "_seq")


def merge_very_short(df: DataFrame) -> DataFrame:
    """Segments under 50 characters join the next one (which then joins nothing), else the one before; same speaker, 60 s at most."""
    w = Window.partitionBy("media_id").orderBy("start_sec", "seq")
    rows = df.withColumn("_label", F.lead("speaker_label").over(w)).withColumn("_end", F.lead("end_sec").over(w))
    state = F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("taken"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        short = r["chars"] < VERY_SHORT
        ahead = F.coalesce(short & (r["_label"] == r["speaker_label"]) & (r["_end"] - r["start_sec"] <= MAX_MERGE_S), F.lit(False))
        back = F.coalesce(short & (s["label"] == r["speaker_label"]) & (r["end_sec"] - s["start"] <= MAX_MERGE_S), F.lit(False))
        new = ~s["taken"] & (ahead | ~back)
        return new, F.struct(F.when(new, r["start_sec"]).otherwise(s["start"]).alias("start"), r["speaker_label"].alias("label"), (~s["taken"] & ahead).alias("taken"))

    return combine(fold_groups(rows, "media_id", ["start_sec", "seq"], {**_merge_uses(), "_label": F.col("_label"), "_end": F.col("_end")}, state, step).drop("_label", "_end"))


def dedupe_text(df: DataFrame) -> DataFrame:
    """The first of segments with one text, whatever its case, per media item."""
    w = Window.partitionBy("media_id", F.lower(trimmed(F.col("text")))).orderBy("start_sec", "seq")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def optimise(df: DataFrame) -> DataFrame:
    """Merge, split, merge very short ones, dedupe, clean."""
    out = complete(df).transform(merge_short).transform(split_long).transform(merge_very_short).transform(dedupe_text)
    return out.withColumn("text", clean_segment(F.col("text")))


def adjacent_merge(df: DataFrame, gap: float = 0.3, longest: float = 30.0) -> DataFrame:
    """Greedy merge of neighbours of one speaker at most ``gap`` apart, up to ``longest`` seconds; adds ``no``."""

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        join = F.coalesce(s["label"].eqNullSafe(r["speaker_label"]) & (r["start_sec"] - s["end"] <= gap) & (r["end_sec"] - s["start"] <= longest), F.lit(False))
        return ~join, F.struct(F.when(join, s["start"]).otherwise(r["start_sec"]).alias("start"), r["end_sec"].alias("end"), r["speaker_label"].alias("label"), F.lit(0).alias("chars"))

    return fold_groups(df, "media_id", ["start_sec", "seq"], _merge_uses(), _merge_state(), step)


def hysteresis(df: DataFrame, score: str = "speaker_conf") -> DataFrame:
    """``state_label``: the primary speaker after two scores in a row of at least HIGH, back after two of at most LOW.

    The count isn't reset by a change of state, so one more score on the other side changes it back at once.
    """

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        x = F.coalesce(r[score], F.lit(0.0))
        hit = F.when(s["primary"], x <= LOW).otherwise(x >= HIGH)
        run = F.when(hit, s["run"] + 1).otherwise(0)
        primary = F.when(hit & (run >= RUNS), ~s["primary"]).otherwise(s["primary"])
        return F.when(primary, PRIMARY).otherwise(GUEST), F.struct(primary.alias("primary"), run.alias("run"))

    state = F.struct(F.lit(False).alias("primary"), F.lit(0).alias("run"))
    return fold_values(df, "media_id", ["start_sec", "seq"], {score: F.col(score)}, state, step, "string", "state_label")


def overlap_windows(df: DataFrame, width: float = 0.3) -> DataFrame:
    """Flagged segments longer than ``width`` are cut into windows of it; others stay."""
    cut = F.col("is_overlap") & (F.col("end_sec") - F.col("start_sec") > width)
    n = F.when(cut, F.ceil((F.col("end_sec") - F.col("start_sec")) / width).cast("int")).otherwise(1)
    out = df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"), cut.alias("_cut"))
    start = F.col("start_sec") + F.col("_k") * width
    return out.withColumn("_s", F.when(F.col("_cut"), start).otherwise(F.col("start_sec"))).withColumn("_e", F.when(F.col("_cut"), F.least(start + width, F.col("end_sec"))).otherwise(F.col("end_sec"))).withColumn("start_sec", F.col("_s")).withColumn("end_sec", F.col("_e")).drop("_k", "_cut", "_s", "_e")


def replace_spans(df: DataFrame, refined: DataFrame) -> DataFrame:
    """Segments (media_id, seq, text, avg_logprob, compression_ratio, re_asr, needs_refinement) after a second recognition of spans.

    ``refined`` holds the new segments (media_id, first_seq, last_seq, part, text, avg_logprob, compression_ratio). All segments of a span count as
    refined; its first one takes the joined text, the best log probability and the least compression, the others become empty and name it in
    ``merged_into``. Spans don't overlap.
    """
    spans = refined.groupBy("media_id", "first_seq", "last_seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ").alias("_text"),
        F.max("avg_logprob").alias("_logprob"),
        F.min("compression_ratio").alias("_compression"),
    )
    member = spans.withColumn("seq", F.explode(F.sequence("first_seq", "last_seq"))).drop("last_seq")
    j = df.join(member, ["media_id", "seq"], "left")
    first, inside = F.col("seq") == F.col("first_seq"), F.col("first_seq").isNotNull()
    return j.select(
        "media_id",
        "seq",
        F.when(first, F.col("_text")).when(inside, "").otherwise(F.col("text")).alias("text"),
        F.when(first, F.col("_logprob")).otherwise(F.col("avg_logprob")).alias("avg_logprob"),
        F.when(first, F.col("_compression")).otherwise(F.col("compression_ratio")).alias("compression_ratio"),
        (F.coalesce("re_asr", F.lit(False)) | inside).alias("re_asr"),
        (F.coalesce("needs_refinement", F.lit(False)) & ~inside).alias("needs_refinement"),
        F.when(inside & ~first, F.col("first_seq")).alias("merged_into"),
    )


def sliding_windows(df: DataFrame, loud: Column, seconds: float = 3.0, step: float = 1.5) -> DataFrame:
    """Windows of ``seconds`` that begin every ``step`` and fit into a row's time, one row each (window_start, window_end); rows that aren't ``loud`` have none.

    A row shorter than a window has none either.
    """
    n = F.floor((F.col("end_sec") - F.col("start_sec") - seconds) / step + 1e-9)
    rows = df.filter(F.coalesce(loud, F.lit(False)) & (n >= 0)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    begin = F.col("start_sec") + F.col("_i") * step
    return rows.withColumn("window_start", begin).withColumn("window_end", begin + seconds).drop("_i")


def refinement_pct(df: DataFrame, by: str) -> DataFrame:
    """Per key the rows, the refined ones and their per cent."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.coalesce("re_asr", F.lit(False))).alias("n_refined"))
    return out.withColumn("refined_pct", 100.0 * F.col("n_refined") / F.greatest(F.col("n"), F.lit(1)))
