"""Transcript outputs: SRT, VTT, paragraphs, word JSON, full JSON, summary; and the ledger of processed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions.time import cue_time
from lyrebird.operators.cluster import joined_text, paragraphs


def _numbered(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("start_sec", "seq")
    return segments.withColumn("_no", F.row_number().over(w))


def _file(rows: DataFrame, cue: Column, by: str, head: str = "", tail: str = "\n") -> DataFrame:
    """media_id and value: cues in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", cue.alias("c")))), lambda x: x["c"]), by)
    return rows.groupBy("media_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))


def srt(segments: DataFrame) -> DataFrame:
    times = F.concat(cue_time(F.col("start_sec")), F.lit(" --> "), cue_time(F.col("end_sec")))
    return _file(_numbered(segments), F.concat_ws("\n", F.col("_no").cast("string"), times, F.col("text")), "\n\n")


def vtt(segments: DataFrame, primary: str | None = None) -> DataFrame:
    """With the speaker as a voice tag; ``primary`` is set bold."""
    times = F.concat(cue_time(F.col("start_sec"), "."), F.lit(" --> "), cue_time(F.col("end_sec"), "."))
    text = F.when(F.col("speaker_label") == primary, F.concat(F.lit("<b>"), "text", F.lit("</b>"))).otherwise(F.col("text")) if primary else F.col("text")
    return _file(_numbered(segments), F.concat_ws("\n", times, F.concat(F.lit("<v "), "speaker_label", F.lit(">"), text)), "\n\n", "WEBVTT\n\n")


def speaker_text(segments: DataFrame) -> DataFrame:
    """Plain text: one paragraph per turn of speech."""
    p = paragraphs(segments, "media_id", "seq", "speaker_label").groupBy("media_id", F.col("cluster").alias("_no"), "speaker_label").agg(joined_text("text", "seq").alias("text"))
    return _file(p, F.concat("speaker_label", F.lit(": "), "text"), "\n\n")


def word_json(words: DataFrame) -> DataFrame:
    w = F.struct("start_sec", "end_sec", "word")
    return words.groupBy("media_id").agg(F.to_json(F.array_sort(F.collect_list(w))).alias("value"))


def full_json(segments: DataFrame) -> DataFrame:
    s = F.struct("start_sec", "seq", *(c for c in segments.columns if c not in ("media_id", "start_sec", "seq")))
    return segments.groupBy("media_id").agg(F.to_json(F.struct(F.col("media_id"), F.array_sort(F.collect_list(s)).alias("segments"))).alias("value"))


def summary(segments: DataFrame) -> DataFrame:
    """One text line per media item: segments, seconds, speakers."""
    agg = segments.groupBy("media_id").agg(F.count("*").alias("n"), F.round(F.max("end_sec") - F.min("start_sec"), 1).alias("s"), F.count_distinct("speaker_label").alias("k"))
    return agg.select("media_id", F.format_string("%d segments, %.1f s, %d speakers", "n", "s", "k").alias("value"))


FORMATS = {"srt": srt, "vtt": vtt, "txt": speaker_text, "json": full_json, "summary": summary}


def write_texts(files: DataFrame, path: str) -> None:
    """One folder per media item, with its text."""
    files.write.mode("overwrite").partitionBy("media_id").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_ledger(done: DataFrame, path: str) -> None:
    """Processed and failed ids: (key, status, at)."""
    done.select("key", "status", "at").write.mode("append").parquet(path)
