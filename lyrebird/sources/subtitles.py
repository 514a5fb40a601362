"""Readers of SRT and VTT subtitles: whole files as rows, split into cues inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.keys import video_id_of_file
from lyrebird.functions.text import collapse, is_non_verbal, trimmed
from lyrebird.functions.time import parse_cue_time
from lyrebird.operators.cluster import gap_clusters, merged
from lyrebird.sources.archives import read_members

_TIMES = r"([0-9:.,]+)\s*-->\s*([0-9:.,]+)"


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and value (the whole text) of the files whose names match."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def plain(c: Column) -> Column:
    """Cue text without tags, with its three character references decoded; the ampersand last."""
    c = F.regexp_replace(c, r"<[^>]*>", "")
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def cues(files: DataFrame, lenient: bool = False) -> DataFrame:
    """media_id, seq, start_sec, end_sec, text of SRT files (path, value).

    Strict: a block needs a number, a line of times and text. Lenient: the number may be missing.
    """
    blocks = files.select(video_id_of_file(F.col("path")).alias("media_id"), F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("seq", "block"))
    lines = F.filter(F.split(trimmed(F.col("block")), "\n"), lambda l: F.length(F.trim(l)) > 0)
    b = blocks.withColumn("lines", lines)
    at = F.when(F.get("lines", F.lit(0)).contains("-->"), 0).otherwise(1)
    if not lenient:
        b = b.filter((F.size("lines") >= 3) & F.get("lines", F.lit(0)).rlike(r"^\s*\d+\s*$"))
        at = F.lit(1)
    times = F.get("lines", at)
    out = b.select(
        "media_id",
        "seq",
        parse_cue_time(F.regexp_extract(times, _TIMES, 1)).alias("start_sec"),
        parse_cue_time(F.regexp_extract(times, _TIMES, 2)).alias("end_sec"),
        trimmed(collapse(plain(F.array_join(F.slice("lines", at + 2, F.greatest(F.lit(0), F.size("lines"))), " ")))).alias("text"),
    )
    return out.filter(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull() & (F.col("text") != ""))


def vtt_cues(files: DataFrame) -> DataFrame:
    """media_id, seq, start_sec, end_sec, text of VTT files: a cue's number is optional; texts of up to two characters and non-verbal ones go."""
    body = files.withColumn("value", F.regexp_replace("value", r"(?s)^﻿?WEBVTT[^\n]*\n", "\n"))
    return cues(body, lenient=True).filter((F.length("text") > 2) & ~is_non_verbal(F.col("text")))


def entries(cues: DataFrame) -> DataFrame:
    """Cues in the form start, duration, text."""
    return cues.select("media_id", "seq", F.col("start_sec").alias("start"), (F.col("end_sec") - F.col("start_sec")).alias("duration"), "text")


def merged_captions(rows: DataFrame, gap: float = 1.0) -> DataFrame:
    """Captions at most ``gap`` apart become one segment."""
    return merged(gap_clusters(rows, "media_id", "seq", gap), "media_id", "seq", by=" ")


def read_srt(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    return cues(whole_files(spark, path, "*.srt"), lenient)


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return vtt_cues(whole_files(spark, path, "*.vtt"))


def read_zipped_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of every .srt member of the ZIP archives of a folder; each member is a task of its own."""
    return cues(read_members(spark, path, ".srt").select(F.col("member").alias("path"), "value"))
