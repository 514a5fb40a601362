"""Scalar functions over texts, urls, labels and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import keys, quality, text, time
from lyrebird.load import SEGMENTS_SQL, segments, table
from lyrebird.plans.registry import query

_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_COLLAPSE = "regexp_replace({c}, '\\s+', ' ', 'g')"


def _clean(c: str) -> str:
    c = _COLLAPSE.format(c=c)
    c = rf"regexp_replace(regexp_replace({c}, '\[[^\]\n]*\]', '', 'g'), '\([^)\n]*\)', '', 'g')"
    c = rf"regexp_replace({c}, '\s+([.!?])', '\1', 'g')"
    return _TRIM.format(c=rf"regexp_replace({c}, '([.!?])\s*([A-Z])', '\1 \2', 'g')")


@query("text_clean", f"SELECT doc_id, md5(upper(substr(c, 1, 1)) || substr(c, 2)) AS h FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_transcript(F.col("text"))).alias("h"))


_NQ = _COLLAPSE.format(c=_TRIM.format(c="lower(text)"))


@query("query_normalize_hash", f"SELECT conv_id, turn, sha256({_NQ} || CASE WHEN turn < conv_id THEN turn || ',' || conv_id WHEN turn = conv_id THEN turn || ',' || conv_id ELSE conv_id || ',' || turn END || 'm1') AS cache_key FROM conversations")
def query_normalize_hash(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.array("conv_id", "turn")), lambda x: x.cast("string"))
    key = F.sha2(F.concat(text.normalise_query(F.col("text")), F.array_join(ids, ","), F.lit("m1")), 256)
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("cache_key"))


@query("content_hash", "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')) AS content_hash, md5(CAST(o_orderkey AS VARCHAR)) AS id_hash FROM orders")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", keys.content_hash(k, F.col("o_orderdate")).alias("content_hash"), keys.content_hash(k).alias("id_hash"))


@query("chunk_hash", f"SELECT media_id, seq, substr(sha256(media_id || ':' || printf('%.3f', start_sec) || ':' || printf('%.3f', end_sec) || ':' || text), 1, 16) AS h FROM {SEGMENTS_SQL}")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of every segment."""
    s = segments(spark, d)
    return s.select("media_id", "seq", keys.chunk_hash(F.col("media_id").cast("string"), F.col("start_sec"), F.col("end_sec"), F.col("text")).alias("h"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query("word_count_tokens", f"SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n_words, CAST(floor(len({_WORDS}) * 1.33) AS BIGINT) AS n_tokens FROM documents")
def word_count_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.word_count(t).alias("n_words"), text.token_estimate(t).alias("n_tokens"))


@query("word_block_split", f"SELECT doc_id, CAST(b AS INTEGER) AS block, len(regexp_split_to_array(array_to_string(list_slice(w, b * 100 + 1, b * 100 + 100), ' '), ' ')) AS n_words FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 100)) AS b FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0)")
def word_block_split(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select("doc_id", F.posexplode(text.word_blocks(F.col("text"), 100)).alias("block", "words"))
    return b.select("doc_id", "block", F.size(F.split("words", " ")).cast("long").alias("n_words"))


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


@query(
    "timestamp_format",
    f"""SELECT media_id, seq, (s // 60) || ':' || {_two('s % 60')} AS m_ss,
      CASE WHEN s >= 3600 THEN (s // 3600) || ':' || {_two('(s // 60) % 60')} || ':' || {_two('s % 60')} ELSE (s // 60) || ':' || {_two('s % 60')} END AS h_mm_ss,
      {_two('s // 3600')} || ':' || {_two('(s // 60) % 60')} || ':' || {_two('s % 60')} AS hh_mm_ss FROM (SELECT media_id, seq, CAST(floor(start_sec) AS BIGINT) AS s FROM {SEGMENTS_SQL})""",
)
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("start_sec")
    return segments(spark, d).select("media_id", "seq", time.m_ss(s).alias("m_ss"), time.h_mm_ss(s).alias("h_mm_ss"), time.hh_mm_ss(s).alias("hh_mm_ss"))


@query(
    "url_parts",
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
    split_part(url || '&t=9s', '&t=', 1) AS base FROM pages""",
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.lower(F.parse_url(u, F.lit("HOST"))).alias("host"), F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"), keys.base_url(F.concat(u, F.lit("&t=9s"))).alias("base"))


@query("deep_link", f"SELECT media_id, seq, CASE WHEN media_id % 2 = 0 AND start_sec <> 0 THEN 'https://x/watch?v=' || media_id || '&t=' || CAST(floor(start_sec) AS BIGINT) || 's' ELSE 'https://x/watch?v=' || media_id END AS link FROM {SEGMENTS_SQL}")
def deep_link(spark: SparkSession, d: str) -> DataFrame:
    url, kind = F.concat(F.lit("https://x/watch?v="), F.col("media_id").cast("string")), F.when(F.col("media_id") % 2 == 0, "youtube").otherwise("zoom")
    return segments(spark, d).select("media_id", "seq", keys.deep_link(url, F.col("start_sec"), kind).alias("link"))


@query("preview_truncate", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM documents")
def preview_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 300).alias("preview"))


@query("term_highlight", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g'), '(?i)(tion)', '<mark>\\1</mark>', 'g')) AS h FROM documents")
def term_highlight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.highlight(F.col("text"), "the of tion")).alias("h"))


@query("terminology_fix", "SELECT doc_id, md5(replace(replace(text, 'tion', 'TION'), 'TIONs', 'tions')) AS h FROM documents")
def terminology_fix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.fix_terms(F.col("text"), [("tion", "TION"), ("TIONs", "tions")])).alias("h"))


_RAW_LABEL = "CASE turn % 6 WHEN 0 THEN 'ch' WHEN 1 THEN 'HOST' WHEN 2 THEN 'G1' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE role END"


@query(
    "label_normalize",
    f"""SELECT raw, CASE WHEN upper(trim(raw)) IN ('CH', 'HOST', 'PRIMARY') THEN 'PRIMARY' WHEN upper(trim(raw)) IN ('G1', 'G2', 'GUEST') THEN 'GUEST' WHEN coalesce(trim(raw), '') = '' THEN 'GUEST' ELSE raw END AS normal, count(*) AS n
    FROM (SELECT {_RAW_LABEL} AS raw FROM conversations) GROUP BY 1, 2""",
)
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "conversations").select(F.expr(_RAW_LABEL).alias("raw"))
    return out.groupBy("raw", keys.normal_label(F.col("raw")).alias("normal")).agg(F.count("*").alias("n"))


_TYPED = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'youtube' WHEN 3 THEN 'zoom' ELSE 'local_file' END AS kind,
  CASE page_id % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=a' WHEN 1 THEN 'https://zoom.us/rec/1' ELSE url END AS u, CASE page_id % 7 WHEN 0 THEN 'zoom_1' WHEN 1 THEN 'youtube_1' WHEN 2 THEN NULL ELSE 'x' END AS sid FROM pages"""


@query(
    "source_type_repair",
    f"""SELECT page_id, CASE WHEN k2 IS NULL OR k2 = '' THEN 'youtube' ELSE k2 END AS kind FROM (
      SELECT *, CASE WHEN k1 <> 'zoom' AND (sid LIKE '%zoom%' OR u LIKE '%zoom%') THEN 'zoom' ELSE k1 END AS k2 FROM (
        SELECT *, CASE WHEN kind <> 'youtube' AND (sid LIKE '%youtube%' OR u LIKE '%youtube.com%') THEN 'youtube' ELSE kind END AS k1 FROM ({_TYPED})))""",
)
def source_type_repair(spark: SparkSession, d: str) -> DataFrame:
    typed = spark.sql(_TYPED.replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))
    return typed.select("page_id", keys.repaired_source_type(F.col("kind"), F.col("u"), F.col("sid")).alias("kind"))


@query(
    "quality_label",
    f"""SELECT media_id, seq, CASE WHEN speaker_label = 'PRIMARY' AND (avg_logprob < -0.55 OR compression_ratio > 2.4) THEN 'low_quality'
      WHEN speaker_label = 'GUEST' AND (avg_logprob < -0.8 OR compression_ratio > 2.6) THEN 'low_quality' ELSE 'good_quality' END AS label,
      avg_logprob <= -0.35 OR compression_ratio >= 2.4 OR no_speech_prob >= 0.8 AS refine FROM {SEGMENTS_SQL}""",
)
def quality_label(spark: SparkSession, d: str) -> DataFrame:
    lp, cr = F.col("avg_logprob"), F.col("compression_ratio")
    return segments(spark, d).select("media_id", "seq", quality.quality_label(F.col("speaker_label"), lp, cr).alias("label"), quality.needs_refinement(lp, cr, F.col("no_speech_prob")).alias("refine"))


@query("group_concat_ordered", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def group_concat_ordered(spark: SparkSession, d: str) -> DataFrame:
    from lyrebird.operators.cluster import joined_text

    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(joined_text("text", "turn")).alias("h"))


@query("duration_filters", "SELECT event_id, value >= 120 OR value = 0 AS not_short, value <= 50 OR value = 0 AS not_long, least(1.0, greatest(0.0, value / 100.0)) AS clamped FROM events")
def duration_filters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", quality.not_short(v).alias("not_short"), quality.not_longer(v, 50).alias("not_long"), quality.clamp(v / 100.0).alias("clamped"))


@query("preset_routing", "SELECT event_id, CASE WHEN value <= 20 THEN 'short' WHEN event_id % 2 = 0 THEN 'interview' ELSE 'monologue_long' END AS preset FROM events")
def preset_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", quality.preset(F.col("value"), F.col("event_id") % 2 == 0).alias("preset"))
