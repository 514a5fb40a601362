"""Readers of the base tables and the views that map them onto the engine's concepts.

The maps keep rows where they are: a document's place on its source's clock comes from its id, not from a window over
the source, as one source may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.schemas import GUEST, PRIMARY, UNKNOWN

#: Characters spoken per second on the synthetic clock.
RATE = 15.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text, start_sec, end_sec: documents as 45-second chunks on their source's clock, with a pause of ten minutes after every 200 ids."""
    start = F.floor(F.col("doc_id") / 20) * 45.0 + F.floor(F.col("doc_id") / 200) * 600.0
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text", start.alias("start_sec"), (start + 45.0).alias("end_sec"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed segments: media_id, seq, start_sec, end_sec, speaker_label, text and quality metrics."""
    n = F.length("text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n).over(before), F.lit(0)) / RATE
    label = F.when(F.col("role") == "user", GUEST).when(F.col("role") == "assistant", PRIMARY).otherwise(UNKNOWN)
    timed = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", label.alias("speaker_label"), start.alias("start_sec"))
    return timed.select(
        F.col("conv_id").alias("media_id"),
        F.col("turn").cast("int").alias("seq"),
        "start_sec",
        (F.col("start_sec") + n / RATE).alias("end_sec"),
        "speaker_label",
        "text",
        (-((n % 100) / 100.0)).alias("avg_logprob"),
        (1.0 + (F.col("turn") % 20) / 10.0).alias("compression_ratio"),
        ((F.col("turn") % 10) / 10.0).alias("no_speech_prob"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ingest log: media_id, status, updated_at, duration_s, metadata."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("media_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("value").alias("duration_s"), F.col("props").alias("metadata"))


#: DuckDB forms of the views above.
CHUNKS_SQL = "(SELECT doc_id, source, lang, n_chars, text, floor(doc_id / 20) * 45.0 + floor(doc_id / 200) * 600.0 AS start_sec, floor(doc_id / 20) * 45.0 + floor(doc_id / 200) * 600.0 + 45.0 AS end_sec FROM documents)"
SEGMENTS_SQL = """(SELECT conv_id AS media_id, CAST(turn AS INTEGER) AS seq, start_sec, start_sec + length(text) / 15.0 AS end_sec,
  CASE role WHEN 'user' THEN 'GUEST' WHEN 'assistant' THEN 'PRIMARY' ELSE 'Unknown' END AS speaker_label, text,
  -((length(text) % 100) / 100.0) AS avg_logprob, 1.0 + (turn % 20) / 10.0 AS compression_ratio, (turn % 10) / 10.0 AS no_speech_prob
  FROM (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 15.0 AS start_sec FROM conversations))"""
