"""Segments and speakers: chunking, merging, alignment, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.quality import needs_upgrade, transcript_issues, transcript_score
from lyrebird.load import SEGMENTS_SQL, segments, table
from lyrebird.operators import cluster, intervals, segments as seg, speakers
from lyrebird.plans.registry import query

#: Each event as a 40-second interval of its user's clock.
_SPANS_SQL = "(SELECT event_id, user_id AS media_id, epoch(ts) AS start_sec, epoch(ts) + 40.0 + value AS end_sec FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("media_id"), t.alias("start_sec"), (t + 40.0 + F.col("value")).alias("end_sec"))


@query(
    "chunk_fixed_duration",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, seq) AS rn FROM {SEGMENTS_SQL} WHERE length(trim(text)) > 0),
    w AS (SELECT media_id, rn, start_sec AS c0, 0 AS no FROM s WHERE rn = 1
      UNION ALL SELECT s.media_id, s.rn, CASE WHEN s.end_sec - w.c0 > 45 THEN s.start_sec ELSE w.c0 END, CASE WHEN s.end_sec - w.c0 > 45 THEN w.no + 1 ELSE w.no END
      FROM w JOIN s ON s.media_id = w.media_id AND s.rn = w.rn + 1)
    SELECT media_id, no AS chunk_index, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, count(*) AS n_rows, md5(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' ORDER BY rn)) AS text_md5 FROM w JOIN s USING (media_id, rn) GROUP BY media_id, no""",
)
def chunk_fixed_duration(spark: SparkSession, d: str) -> DataFrame:
    out = seg.duration_chunks(segments(spark, d))
    return out.select("media_id", "chunk_index", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "n_rows", F.md5("text").alias("text_md5"))


@query("segment_optimize_full")
def segment_optimize_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole optimiser over conversations."""
    return seg.optimise(segments(spark, d))


@query(
    "adjacent_merge",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, seq) AS rn FROM {SEGMENTS_SQL}),
    w AS (SELECT media_id, rn, start_sec AS c0, end_sec AS e0, speaker_label AS l, 0 AS no FROM s WHERE rn = 1
      UNION ALL SELECT s.media_id, s.rn,
        CASE WHEN s.speaker_label = w.l AND s.start_sec - w.e0 <= 0.3 AND s.end_sec - w.c0 <= 30 THEN w.c0 ELSE s.start_sec END, s.end_sec, s.speaker_label,
        CASE WHEN s.speaker_label = w.l AND s.start_sec - w.e0 <= 0.3 AND s.end_sec - w.c0 <= 30 THEN w.no ELSE w.no + 1 END
      FROM w JOIN s ON s.media_id = w.media_id AND s.rn = w.rn + 1)
    SELECT media_id, no, count(*) AS n_rows, md5(string_agg(text, ' ' ORDER BY rn)) AS text_md5 FROM w JOIN s USING (media_id, rn) GROUP BY media_id, no""",
)
def adjacent_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merged segments, with the digest of their joined texts."""
    merged = seg.adjacent_merge(segments(spark, d)).groupBy("media_id", "no")
    return merged.agg(F.count("*").alias("n_rows"), F.md5(cluster.joined_text("text", "seq")).alias("text_md5"))


@query(
    "hysteresis_label",
    f"""WITH RECURSIVE s AS (SELECT media_id, seq, (length(text) % 100) / 100.0 AS x, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, seq) AS rn FROM {SEGMENTS_SQL}),
    f AS (SELECT media_id, CAST(0 AS BIGINT) AS rn, false AS p, 0 AS run, CAST(NULL AS INTEGER) AS seq FROM s WHERE rn = 1
      UNION ALL SELECT media_id, rn, CASE WHEN hit AND r >= 2 THEN NOT p ELSE p END, r, seq FROM (
        SELECT s.media_id, s.rn, f.p, s.seq, CASE WHEN f.p THEN s.x <= 0.68 ELSE s.x >= 0.75 END AS hit,
          CASE WHEN CASE WHEN f.p THEN s.x <= 0.68 ELSE s.x >= 0.75 END THEN f.run + 1 ELSE 0 END AS r
        FROM f JOIN s ON s.media_id = f.media_id AND s.rn = f.rn + 1))
    SELECT media_id, seq, CASE WHEN p THEN 'PRIMARY' ELSE 'GUEST' END AS state_label FROM f WHERE rn > 0""",
)
def hysteresis_label(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("speaker_conf", (F.length("text") % 100) / 100.0)
    return seg.hysteresis(s).select("media_id", "seq", "state_label")


@query(
    "span_union_merge",
    f"""SELECT media_id, CAST(c AS BIGINT) AS cluster, round(min(start_sec), 3) AS start_sec, round(max(end_sec), 3) AS end_sec, count(*) AS n_rows FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_sec, event_id ROWS UNBOUNDED PRECEDING) AS c FROM (
        SELECT *, CASE WHEN start_sec - max(end_sec) OVER (PARTITION BY media_id ORDER BY start_sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS fresh FROM {_SPANS_SQL}))
    GROUP BY media_id, c""",
)
def span_union_merge(spark: SparkSession, d: str) -> DataFrame:
    u = cluster.span_unions(_spans(spark, d), "media_id", "event_id", 2.0)
    return u.groupBy("media_id", F.col("cluster").cast("long").alias("cluster")).agg(F.round(F.min("start_sec"), 3).alias("start_sec"), F.round(F.max("end_sec"), 3).alias("end_sec"), F.count("*").alias("n_rows"))


@query(
    "close_caption_merge",
    f"""SELECT media_id, CAST(c AS BIGINT) AS cluster, count(*) AS n_rows, md5(string_agg(text, ' ' ORDER BY start_sec, seq)) AS text_md5 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_sec, seq ROWS UNBOUNDED PRECEDING) AS c FROM (
        SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY media_id ORDER BY start_sec, seq) <= 1 THEN 0 ELSE 1 END AS fresh
        FROM (SELECT * REPLACE (start_sec + 2 * (seq // 3) AS start_sec, end_sec + 2 * (seq // 3) AS end_sec) FROM {SEGMENTS_SQL}))) GROUP BY media_id, c""",
)
def close_caption_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every segment, merged where gaps are short; two seconds more before each third segment make gaps."""
    shift = 2.0 * F.floor(F.col("seq") / 3)
    spaced = segments(spark, d).withColumns({"start_sec": F.col("start_sec") + shift, "end_sec": F.col("end_sec") + shift})
    out = cluster.merged(cluster.gap_clusters(spaced, "media_id", "seq", 1.0), "media_id", "seq", by=" ")
    return out.select("media_id", F.col("cluster").cast("long"), "n_rows", F.md5("text").alias("text_md5"))


@query(
    "speaker_paragraphs",
    f"""SELECT media_id, CAST(c AS BIGINT) AS cluster, speaker_label, md5(string_agg(text, ' ' ORDER BY seq)) AS text_md5 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM (
        SELECT *, CASE WHEN speaker_label = lag(speaker_label) OVER (PARTITION BY media_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM {SEGMENTS_SQL}))
    GROUP BY media_id, c, speaker_label""",
)
def speaker_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = cluster.paragraphs(segments(spark, d), "media_id", "seq", "speaker_label")
    return p.groupBy("media_id", F.col("cluster").cast("long").alias("cluster"), "speaker_label").agg(F.md5(cluster.joined_text("text", "seq")).alias("text_md5"))


_TURNS_SQL = f"(SELECT media_id, seq AS turn, greatest(0.0, start_sec + CASE WHEN seq % 2 = 0 THEN 0.4 ELSE -0.4 END) AS start_sec, end_sec + CASE WHEN seq % 3 = 0 THEN 0.4 ELSE -0.2 END AS end_sec, speaker_label AS label, 0.5 + (seq % 7) / 20.0 AS confidence FROM {SEGMENTS_SQL})"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    return segments(spark, d).select(
        "media_id",
        seq.alias("turn"),
        F.greatest(F.lit(0.0), F.col("start_sec") + F.when(seq % 2 == 0, 0.4).otherwise(-0.4)).alias("start_sec"),
        (F.col("end_sec") + F.when(seq % 3 == 0, 0.4).otherwise(-0.2)).alias("end_sec"),
        F.col("speaker_label").alias("label"),
        (0.5 + (seq % 7) / 20.0).alias("confidence"),
    )


@query(
    "interval_overlap_align",
    f"""SELECT media_id, seq, turn, label, n > 1 AS is_overlap FROM (
      SELECT s.media_id, s.seq, t.turn, t.label, count(*) OVER (PARTITION BY s.media_id, s.seq) AS n,
        row_number() OVER (PARTITION BY s.media_id, s.seq ORDER BY least(s.end_sec, t.end_sec) - greatest(s.start_sec, t.start_sec) DESC, t.turn) AS rn
      FROM {SEGMENTS_SQL} s JOIN {_TURNS_SQL} t ON s.media_id = t.media_id AND s.end_sec > t.start_sec AND s.start_sec < t.end_sec) WHERE rn = 1""",
)
def interval_overlap_align(spark: SparkSession, d: str) -> DataFrame:
    best = intervals.longest_overlap(segments(spark, d), _turns(spark, d), "media_id", "seq", "turn")
    return best.select("media_id", "seq", F.col("r_turn").alias("turn"), F.col("r_label").alias("label"), "is_overlap")


_WORDS_SQL = f"""(SELECT media_id, seq, i, w AS word, start_sec + (i - 1) * (end_sec - start_sec) / n AS start_sec, start_sec + i * (end_sec - start_sec) / n AS end_sec FROM (
  SELECT *, len(ws) AS n, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM (
    SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM {SEGMENTS_SQL})))"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words at equal shares of their segment's time."""
    from lyrebird.functions.text import words

    s = segments(spark, d).withColumn("ws", words(F.col("text"))).withColumn("n", F.size("ws"))
    e = s.select("media_id", "seq", "start_sec", "end_sec", "n", F.posexplode("ws").alias("p", "word"))
    i = F.col("p") + 1
    return e.select("media_id", "seq", i.alias("i"), "word", (F.col("start_sec") + (i - 1) * (F.col("end_sec") - F.col("start_sec")) / F.col("n")).alias("start_sec"), (F.col("start_sec") + i * (F.col("end_sec") - F.col("start_sec")) / F.col("n")).alias("end_sec"))


@query(
    "interval_contain_count",
    f"""SELECT w.media_id, t.turn, count(*) AS n_words FROM {_WORDS_SQL} w JOIN {_TURNS_SQL} t
    ON w.media_id = t.media_id AND w.start_sec >= t.start_sec AND w.end_sec <= t.end_sec GROUP BY w.media_id, t.turn""",
)
def interval_contain_count(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.contained(_words(spark, d), _turns(spark, d), "media_id")
    return pairs.groupBy("media_id", F.col("r_turn").alias("turn")).agg(F.count("*").alias("n_words"))


@query(
    "majority_speaker",
    f"""WITH v AS (SELECT w.media_id, w.seq, t.label, count(*) AS votes, avg(t.confidence) AS c, min(w.start_sec) AS f FROM {_WORDS_SQL} w JOIN {_TURNS_SQL} t
      ON w.media_id = t.media_id AND w.start_sec >= t.start_sec AND w.end_sec <= t.end_sec GROUP BY 1, 2, 3)
    SELECT media_id, seq, label, votes, round(c, 6) AS mean_confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY media_id, seq ORDER BY votes DESC, f, label) AS rn FROM v) WHERE rn = 1""",
)
def majority_speaker(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.contained(_words(spark, d), _turns(spark, d), "media_id").select("media_id", "seq", "start_sec", F.col("r_label").alias("label"), F.col("r_confidence").alias("confidence"))
    return speakers.majority_label(pairs, ["media_id", "seq"]).select("media_id", "seq", "label", "votes", F.round("mean_confidence", 6).alias("mean_confidence"))


@query(
    "overlap_flag",
    f"""SELECT a.media_id, a.turn, EXISTS (SELECT 1 FROM {_TURNS_SQL} b WHERE b.media_id = a.media_id AND b.turn <> a.turn
      AND least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec) > 0.3) AS is_overlap FROM {_TURNS_SQL} a""",
)
def overlap_flag(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping(_turns(spark, d), "media_id", "turn").select("media_id", "turn", "is_overlap")


@query(
    "speaker_margin",
    """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
    p AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label),
    s AS (SELECT vec_id, p.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings e, p),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id ORDER BY sim DESC) AS k FROM s)
    SELECT vec_id, CASE WHEN max(sim) * 1.02 >= 0.5 AND (max(CASE WHEN k = 2 THEN sim END) IS NULL OR max(sim) - max(CASE WHEN k = 2 THEN sim END) >= 0.05)
      THEN CAST(min(CASE WHEN k = 1 THEN CAST(label AS VARCHAR) END) AS VARCHAR) ELSE 'Unknown' END AS label, round(max(sim) * 1.02, 6) AS similarity FROM r GROUP BY vec_id""",
)
def speaker_margin(spark: SparkSession, d: str) -> DataFrame:
    """The label of every vector, against the centroids of all labels."""
    from lyrebird.functions.vector import centroids

    e = table(spark, d, "embeddings")
    profiles = centroids(e, "label", "embedding").select(F.col("label").cast("string").alias("name"), "centroid", F.lit(0.5).alias("threshold"))
    clusters = e.select(F.col("vec_id").alias("cluster"), F.lit(7.0).alias("seconds"), F.col("embedding").cast("array<double>").alias("centroid"))
    return speakers.attribute_clusters(clusters, profiles).select(F.col("cluster").alias("vec_id"), "label", F.round("similarity", 6).alias("similarity"))


@query(
    "speaker_stats_share",
    f"""SELECT speaker_label, count(*) AS n_segments, round(sum(end_sec - start_sec), 3) AS seconds, round(avg(end_sec - start_sec), 4) AS avg_seconds,
      round(100.0 * sum(end_sec - start_sec) / (SELECT sum(end_sec - start_sec) FROM {SEGMENTS_SQL}), 4) AS share_pct FROM {SEGMENTS_SQL} GROUP BY speaker_label""",
)
def speaker_stats_share(spark: SparkSession, d: str) -> DataFrame:
    s = speakers.speaker_stats(segments(spark, d))
    return s.select("speaker_label", "n_segments", F.round("seconds", 3).alias("seconds"), F.round("avg_seconds", 4).alias("avg_seconds"), F.round("share_pct", 4).alias("share_pct"))


@query("quality_score")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Score, issues and verdict of each conversation's whole transcript."""
    per = segments(spark, d).groupBy("media_id").agg(cluster.joined_text("text", "seq").alias("text"), F.avg(F.col("end_sec") - F.col("start_sec")).alias("avg_s"))
    issues = transcript_issues(F.col("text"), F.col("avg_s"))
    return per.select("media_id", issues.alias("issues")).select("media_id", "issues", transcript_score(F.col("issues")).alias("score"), needs_upgrade(F.col("issues")).alias("needs_upgrade"))


@query("srt_roundtrip")
def srt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as SRT text and parsed back: texts on one line, times in milliseconds."""
    from lyrebird.functions.text import collapse, trimmed
    from lyrebird.sources.sinks import srt
    from lyrebird.sources.subtitles import cues

    flat = segments(spark, d).withColumn("text", trimmed(collapse(F.col("text"))))
    return cues(srt(flat).select(F.format_string("media-%011d.srt", "media_id").alias("path"), "value"))
