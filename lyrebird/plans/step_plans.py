"""Single steps of the segment optimiser over turns cut into short pieces, tree summaries, and queries through the catalogue's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import catalogue, text, time
from lyrebird.functions.keys import video_id_of_file
from lyrebird.load import SEGMENTS_SQL, segments, table
from lyrebird.operators import monitor, segments as seg, summarise
from lyrebird.plans.registry import query

_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"

#: Turns of a conversation, ten minutes apart, as pieces of seven words at three words a second.
PIECES_SQL = f"""(SELECT conv_id AS media_id, CAST(turn * 1000 + b AS INTEGER) AS seq, turn * 600 + b * 7 / 3.0::DOUBLE AS start_sec,
  turn * 600 + b * 7 / 3.0::DOUBLE + len(w[b * 7 + 1 : b * 7 + 7]) / 3.0::DOUBLE AS end_sec, CASE role WHEN 'user' THEN 'GUEST' WHEN 'assistant' THEN 'PRIMARY' ELSE 'Unknown' END AS speaker_label,
  array_to_string(w[b * 7 + 1 : b * 7 + 7], ' ') AS text FROM (SELECT *, unnest(range(0, (len(w) + 6) // 7)) AS b FROM (SELECT *, {_WORDS} AS w FROM conversations)))"""


def pieces(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("role") == "user", "GUEST").when(F.col("role") == "assistant", "PRIMARY").otherwise("Unknown")
    b = table(spark, d, "conversations").select("conv_id", "turn", label.alias("speaker_label"), F.posexplode(text.word_blocks(F.col("text"), 7)).alias("b", "text"))
    start = F.col("turn") * 600 + F.col("b") * 7 / F.lit(3.0)
    return b.select(F.col("conv_id").alias("media_id"), (F.col("turn") * 1000 + F.col("b")).cast("int").alias("seq"), start.alias("start_sec"), (start + text.word_count(F.col("text")) / F.lit(3.0)).alias("end_sec"), "speaker_label", "text")


def _measured(df: DataFrame) -> DataFrame:
    return seg.complete(df.withColumn("avg_logprob", -((F.length("text") % 100) / 100.0)))


def _merged(df: DataFrame) -> DataFrame:
    return df.select("media_id", "seq", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "speaker_label", F.md5("text").alias("text_md5"), F.round("avg_logprob", 9).alias("avg_logprob"), "original_count")


def _fold_sql(first: str, step: str, new: str) -> str:
    """Pairwise merges in order: a row that isn't ``new`` is merged into the group of the row before it."""
    joined = lambda merged, alone: f"CASE WHEN {new} THEN {alone} ELSE {merged} END"
    w_old, w_new = "coalesce((w.e0 - w.c0) / nullif(w.e0 - w.c0 + s.end_sec - s.start_sec, 0), 0.5)", "coalesce((s.end_sec - s.start_sec) / nullif(w.e0 - w.c0 + s.end_sec - s.start_sec, 0), 0.5)"
    return f"""WITH RECURSIVE s AS (SELECT *, -((length(text) % 100) / 100.0::DOUBLE) AS lp, row_number() OVER o AS rn, lead(speaker_label) OVER o AS next_label, lead(end_sec) OVER o AS next_end
      FROM {PIECES_SQL} WINDOW o AS (PARTITION BY media_id ORDER BY start_sec, seq)),
    w AS (SELECT media_id, rn, 0 AS no, seq AS q0, start_sec AS c0, end_sec AS e0, speaker_label AS l0, text AS t0, lp AS lp0, 1 AS n0, {first} FROM s WHERE rn = 1
      UNION ALL SELECT s.media_id, s.rn, {joined('w.no', 'w.no + 1')}, {joined('w.q0', 's.seq')}, {joined('w.c0', 's.start_sec')}, s.end_sec, {joined('w.l0', 's.speaker_label')}, {joined("w.t0 || ' ' || s.text", 's.text')},
        {joined(f'w.lp0 * {w_old} + s.lp * {w_new}', 's.lp')}, {joined('w.n0 + 1', '1')}, {step} FROM w JOIN s ON s.media_id = w.media_id AND s.rn = w.rn + 1)
    SELECT media_id, q0 AS seq, round(c0, 6) AS start_sec, round(e0, 6) AS end_sec, l0 AS speaker_label, md5(t0) AS text_md5, round(lp0, 9) AS avg_logprob, n0 AS original_count
    FROM w QUALIFY row_number() OVER (PARTITION BY media_id, no ORDER BY rn DESC) = 1"""


_NEAR = "w.l0 IS NOT DISTINCT FROM s.speaker_label AND s.start_sec - w.e0 <= 3 AND s.end_sec - w.c0 <= 60"
_SMALL = "(length(w.t0) < 30 OR length(s.text) < 30 OR (length(w.t0) + length(s.text) + 1 < 1200 AND (length(w.t0) < 400 OR length(s.text) < 400)))"


@query("segment_merge_short", _fold_sql("0 AS unused", "0", f"NOT ({_NEAR} AND {_SMALL})"))
def segment_merge_short(spark: SparkSession, d: str) -> DataFrame:
    return _merged(seg.merge_short(_measured(pieces(spark, d))))


_AHEAD = "coalesce(length(s.text) < 50 AND s.next_label = s.speaker_label AND s.next_end - s.start_sec <= 60, false)"
_BACK = "coalesce(length(s.text) < 50 AND w.label = s.speaker_label AND s.end_sec - w.c0 <= 60, false)"


@query(
    "segment_merge_very_short",
    _fold_sql(f"speaker_label AS label, {_AHEAD.replace('s.', '')} AS taken", f"s.speaker_label, NOT w.taken AND {_AHEAD}", f"NOT w.taken AND ({_AHEAD} OR NOT {_BACK})"),
)
def segment_merge_very_short(spark: SparkSession, d: str) -> DataFrame:
    return _merged(seg.merge_very_short(_measured(pieces(spark, d))))


@query(
    "segment_split_long",
    """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) / 15.0::DOUBLE AS stop, regexp_split_to_array(text, '[.!?]+\\s+') AS p FROM documents),
    cut AS (SELECT * FROM d WHERE length(text) > 1800 AND len(p) > 1),
    s AS (SELECT doc_id, unnest(p) || '. ' AS s, unnest(range(1, len(p) + 1)) AS i FROM cut),
    w AS (SELECT doc_id, i, s AS cur, 0 AS no FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN length(w.cur || s.s) > 1200 THEN s.s ELSE w.cur || s.s END, CASE WHEN length(w.cur || s.s) > 1200 THEN w.no + 1 ELSE w.no END FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
    parts AS (SELECT doc_id, no, max_by(cur, i) AS cur FROM w GROUP BY doc_id, no),
    timed AS (SELECT *, sum(length(cur)) OVER (PARTITION BY doc_id) AS total, coalesce(sum(length(cur)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts WHERE length(trim(cur)) > 0)
    SELECT doc_id, CAST(no AS INTEGER) AS seq, round(stop * before / total, 6) AS start_sec, round(stop * (before + length(cur)) / total, 6) AS end_sec, md5(trim(cur)) AS text_md5 FROM timed JOIN cut USING (doc_id)
    UNION ALL SELECT doc_id, 0, 0.0::DOUBLE, round(stop, 6), md5(text) FROM d WHERE NOT (length(text) > 1800 AND len(p) > 1)""",
)
def segment_split_long(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one segment, cut at sentences where it is long."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.lit(0).alias("seq"), F.lit(0.0).alias("start_sec"), (F.length("text") / F.lit(15.0)).alias("end_sec"), F.lit("GUEST").alias("speaker_label"), "text")
    return seg.split_long(docs).select(F.col("media_id").alias("doc_id"), "seq", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), F.md5("text").alias("text_md5"))


@query(
    "segment_overlap_windows",
    f"""SELECT media_id, seq, round(CASE WHEN cut THEN start_sec + k * 0.3::DOUBLE ELSE start_sec END, 6) AS start_sec, round(CASE WHEN cut THEN least(start_sec + k * 0.3::DOUBLE + 0.3::DOUBLE, end_sec) ELSE end_sec END, 6) AS end_sec
    FROM (SELECT *, unnest(range(0, CASE WHEN cut THEN CAST(ceil((end_sec - start_sec) / 0.3::DOUBLE) AS BIGINT) ELSE 1 END)) AS k FROM (SELECT *, length(text) > 45 AND end_sec - start_sec > 0.3::DOUBLE AS cut FROM {PIECES_SQL}))""",
)
def segment_overlap_windows(spark: SparkSession, d: str) -> DataFrame:
    flagged = pieces(spark, d).withColumn("is_overlap", F.length("text") > 45)
    return seg.overlap_windows(flagged).select("media_id", "seq", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


_CLEAN = "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


@query("segment_clean", f"SELECT media_id, seq, CASE WHEN length(c) > 20 AND NOT regexp_matches(c, '[.!?:]$') THEN c || '.' ELSE c END AS text FROM (SELECT media_id, seq, {_CLEAN} AS c FROM {PIECES_SQL})")
def segment_clean(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).select("media_id", "seq", text.clean_segment(F.col("text")).alias("text"))


def _cue_sql(mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"


@query("cue_times", f"SELECT media_id, seq, {_cue_sql(',')} AS srt, {_cue_sql('.')} AS vtt, round(ms / 1000.0::DOUBLE, 3) AS back FROM (SELECT *, CAST(floor(start_sec * 1000 + 1e-6::DOUBLE) AS BIGINT) AS ms FROM {PIECES_SQL})")
def cue_times(spark: SparkSession, d: str) -> DataFrame:
    """Start times in the form of both kinds of subtitles, and read back."""
    t = F.col("start_sec")
    return pieces(spark, d).select("media_id", "seq", time.cue_time(t).alias("srt"), time.cue_time(t, ".").alias("vtt"), F.round(time.parse_cue_time(time.cue_time(t, ".")), 3).alias("back"))


@query(
    "processing_speed",
    "SELECT user_id, round(CASE WHEN audio > 0 THEN work / audio ELSE 0 END, 6) AS rtf, round(CASE WHEN work > 0 THEN audio / work ELSE 0 END, 6) AS throughput FROM (SELECT user_id, sum(value) AS work, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS audio FROM events GROUP BY user_id)",
)
def processing_speed(spark: SparkSession, d: str) -> DataFrame:
    """Real-time factor and throughput per user."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    per = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("work"), F.sum(k).alias("audio"))
    return per.select("user_id", F.round(monitor.real_time_factor(F.col("work"), F.col("audio")), 6).alias("rtf"), F.round(monitor.throughput(F.col("audio"), F.col("work")), 6).alias("throughput"))


@query(
    "summary_tree",
    f"""WITH RECURSIVE r AS (
      SELECT source, w, CAST(len(w) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS words_read, 0 AS n_rounds, CAST(NULL AS VARCHAR) AS summary
      FROM (SELECT source, flatten(list(w ORDER BY doc_id)) AS w FROM (SELECT source, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) GROUP BY source) WHERE len(w) > 0
      UNION ALL SELECT source, flatten(list_transform(range(0, len(w), 500), lambda i: list_concat(['PART', concat(i // 500 + 1, ':')], w[i + 1 : i + 60]))), n_words,
        n_calls + (len(w) + 499) // 500, words_read + len(w), n_rounds + 1, CASE WHEN len(w) <= 500 THEN array_to_string(w[1:60], ' ') END FROM r WHERE summary IS NULL)
    SELECT source, summary, n_words, n_calls, words_read, n_rounds FROM r WHERE summary IS NOT NULL""",
)
def summary_tree(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a source as one text, summarised in blocks of 500 words down to one call."""
    return summarise.tree_summaries(table(spark, d, "documents"), "source", ["doc_id"], "lead", 500, 60)


@query(
    "catalogue_blocks",
    f"SELECT conv_id, turn, CAST(b AS INTEGER) AS block, (turn * 75 // 60) || ':' || lpad(CAST(turn * 75 % 60 AS VARCHAR), 2, '0') AS at, CAST(len(w[b * 20 + 1 : b * 20 + 20]) AS INTEGER) AS n_words, md5(array_to_string(w[b * 20 + 1 : b * 20 + 20], ' ')) AS text_md5 FROM (SELECT *, unnest(range(0, (len(w) + 19) // 20)) AS b FROM (SELECT *, {_WORDS} AS w FROM conversations))",
)
def catalogue_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Scalar and table functions of the catalogue, in SQL."""
    catalogue.register(spark)
    return spark.sql("SELECT c.conv_id, c.turn, b.block, m_ss(c.turn * 75) AS at, word_count(b.text) AS n_words, md5(b.text) AS text_md5 FROM {turns} c, LATERAL word_blocks(c.text, 20) b", turns=table(spark, d, "conversations"))


@query(
    "catalogue_chunks",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, seq) AS rn FROM {SEGMENTS_SQL} WHERE length(trim(text)) > 0),
    w AS (SELECT media_id, rn, start_sec AS c0, 0 AS no FROM s WHERE rn = 1
      UNION ALL SELECT s.media_id, s.rn, CASE WHEN s.end_sec - w.c0 > 45 THEN s.start_sec ELSE w.c0 END, CASE WHEN s.end_sec - w.c0 > 45 THEN w.no + 1 ELSE w.no END FROM w JOIN s ON s.media_id = w.media_id AND s.rn = w.rn + 1)
    SELECT media_id, no AS chunk_index, count(*) AS n_rows, md5(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY rn)) AS text_md5 FROM w JOIN s USING (media_id, rn) GROUP BY media_id, no""",
)
def catalogue_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Duration chunks with their texts by a table function that walks each conversation's ordered partition."""
    catalogue.register(spark)
    s = segments(spark, d).select("media_id", "seq", "start_sec", "end_sec", "text")
    s.createOrReplaceTempView("lyrebird_catalogue_segments")
    return spark.sql("SELECT media_id, chunk_index, n_rows, md5(text) AS text_md5 FROM duration_chunks(TABLE(lyrebird_catalogue_segments) PARTITION BY media_id ORDER BY (start_sec, seq), 45D)")


@query(
    "file_ids",
    r"""SELECT page_id, CASE WHEN token <> '' THEN token ELSE regexp_replace(name, '\.[^.]*$', '') END AS media_id FROM (
      SELECT page_id, name, regexp_extract(name, '(?:^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)', 1) AS token FROM (SELECT page_id, split_part(url, '/', -1) AS name FROM pages))""",
)
def file_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id in the last part of each page's path, by the rule for file names."""
    return table(spark, d, "pages").select("page_id", video_id_of_file(F.col("url")).alias("media_id"))
