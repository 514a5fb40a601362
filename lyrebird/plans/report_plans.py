"""Status pages, work lists, and the smaller operators of speakers, segments, titles and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import keys, quality, text
from lyrebird.functions.vector import centroids, cosine, sampled_max
from lyrebird.load import CHUNKS_SQL, SEGMENTS_SQL, chunks, segments, table
from lyrebird.operators import monitor, search, segments as seg, speakers, store, views
from lyrebird.operators.bounds import broadcast_if_small, small
from lyrebird.operators.scan import ranked
from lyrebird.plans.monitor_plans import _STATE, _state
from lyrebird.plans.registry import query

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
_SOURCES = "(SELECT o_orderkey AS id, o_totalprice AS duration_s, o_orderdate AS created_at, CASE WHEN o_custkey % 3 = 0 THEN 'zoom' ELSE 'youtube' END AS source_type FROM orders)"
_PARTS = """(SELECT l_orderkey AS source_id, l_returnflag || l_linestatus AS text, CASE WHEN l_linenumber < 6 THEN l_returnflag END AS speaker_label,
  CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS embedding, l_shipdate AS created_at, l_linenumber FROM lineitem)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Orders as media sources."""
    kind = F.when(F.col("o_custkey") % 3 == 0, "zoom").otherwise("youtube")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("duration_s"), F.col("o_orderdate").alias("created_at"), kind.alias("source_type"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Line items as their segments."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_id"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.when(n < 6, F.col("l_returnflag")).alias("speaker_label"),
        F.when(n % 2 == 1, F.col("l_quantity")).alias("embedding"),
        F.col("l_shipdate").alias("created_at"),
        n,
    )


@query(
    "status_page",
    f"""SELECT *, round(coalesce(CAST(n_segments AS DOUBLE) / nullif(n_with_segments, 0), 0.0), 4) AS segments_each, round(coalesce(CAST(n_embedded AS DOUBLE) / nullif(n_segments, 0), 0.0), 4) AS embedded_share FROM
    (SELECT count(*) AS n_sources, round(avg(duration_s) / 60, 4) AS avg_minutes, round(sum(duration_s) / 3600, 4) AS total_hours, count(*) FILTER (WHERE created_at > {AS_OF} - INTERVAL 1 HOUR) AS recent_sources FROM {_SOURCES}),
    (SELECT count(*) AS n_segments, count(DISTINCT source_id) AS n_with_segments, count(DISTINCT CASE WHEN created_at > {AS_OF} - INTERVAL 1 HOUR THEN source_id END) AS recent_items,
      count(*) FILTER (WHERE speaker_label IS NULL) AS n_null_labels, count(embedding) AS n_embedded FROM {_PARTS}),
    (SELECT count(*) AS n_repeated FROM (SELECT 1 FROM {_PARTS} GROUP BY source_id, text HAVING count(*) > 1))""",
)
def status_page(spark: SparkSession, d: str) -> DataFrame:
    """Overview, recency, repeated texts and coverage in one row."""
    return views.status_page(_sources(spark, d), _parts(spark, d), F.expr(AS_OF))


@query("latest_sources", f"SELECT id, s.created_at, count(text) AS n_segments FROM (SELECT * FROM {_SOURCES} ORDER BY created_at DESC NULLS LAST, id LIMIT 5) s LEFT JOIN {_PARTS} p ON p.source_id = s.id GROUP BY 1, 2")
def latest_sources(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_sources(_sources(spark, d), _parts(spark, d).select("source_id", "text"))


@query(
    "ingestion_stats",
    f"""SELECT 'total' AS section, 'items' AS name, count(*) AS n FROM events UNION ALL SELECT 'total', 'sources', count(*) FROM {_SOURCES} WHERE source_type = 'youtube' UNION ALL SELECT 'total', 'chunks', count(*) FROM documents
    UNION ALL SELECT 'status', status, count(*) FROM {_STATE} GROUP BY 2
    UNION ALL (SELECT 'error', last_error, count(*) AS n FROM {_STATE} WHERE status = 'error' AND last_error IS NOT NULL GROUP BY 2 ORDER BY n DESC, last_error LIMIT 5)""",
)
def ingestion_stats(spark: SparkSession, d: str) -> DataFrame:
    return views.ingestion_stats(_state(spark, d), _sources(spark, d), table(spark, d, "documents"))


@query(
    "quality_metrics",
    f"""SELECT count(*) AS n_segments, round(avg(avg_logprob), 6) AS avg_logprob_mean, round(avg(compression_ratio), 6) AS compression_ratio_mean, round(avg(no_speech_prob), 6) AS no_speech_prob_mean,
    count(*) FILTER (WHERE avg_logprob <= -0.35 OR compression_ratio >= 2.4) AS n_low_conf, count(*) FILTER (WHERE speaker_label = 'Unknown') AS n_unknown,
    round(100.0 * count(*) FILTER (WHERE avg_logprob <= -0.35 OR compression_ratio >= 2.4) / count(*), 6) AS low_conf_pct FROM {SEGMENTS_SQL}""",
)
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of the recognition metrics and the share of low confidence."""
    m = speakers.quality_means(segments(spark, d))
    return m.select("n_segments", *(F.round(c, 6).alias(c) for c in ("avg_logprob_mean", "compression_ratio_mean", "no_speech_prob_mean")), "n_low_conf", "n_unknown", F.round("low_conf_pct", 6).alias("low_conf_pct"))


_CONF = "CASE WHEN seq % 5 > 0 THEN 1 - no_speech_prob END"


@query(
    "speaker_confidence",
    f"""SELECT speaker_label, count(*) AS n_segments, min({_CONF}) AS min_conf, max({_CONF}) AS max_conf, round(avg({_CONF}), 6) AS avg_conf, count(*) FILTER (WHERE seq % 3 = 0) AS n_refined,
    round(100.0 * sum(end_sec - start_sec) / (SELECT sum(end_sec - start_sec) FROM {SEGMENTS_SQL}), 4) AS share_pct FROM {SEGMENTS_SQL} GROUP BY 1""",
)
def speaker_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Share of time, confidence and refined segments of each speaker."""
    s = segments(spark, d).withColumns({"speaker_conf": F.expr(_CONF), "re_asr": F.col("seq") % 3 == 0})
    return speakers.speaker_stats(s).select("speaker_label", "n_segments", "min_conf", "max_conf", F.round("avg_conf", 6).alias("avg_conf"), "n_refined", F.round("share_pct", 4).alias("share_pct"))


@query("refinement_share", f"SELECT media_id, count(*) AS n, count(*) FILTER (WHERE seq % 3 = 0) AS n_refined, round(100.0 * count(*) FILTER (WHERE seq % 3 = 0) / greatest(count(*), 1), 6) AS refined_pct FROM {SEGMENTS_SQL} GROUP BY 1")
def refinement_share(spark: SparkSession, d: str) -> DataFrame:
    out = seg.refinement_pct(segments(spark, d).withColumn("re_asr", F.col("seq") % 3 == 0), "media_id")
    return out.withColumn("refined_pct", F.round("refined_pct", 6))


_CENTROIDS = """c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2), p AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label)"""


@query(
    "similarity_share",
    f"""WITH {_CENTROIDS}, s AS (SELECT e.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings e JOIN p ON e.label = p.label)
    SELECT label, count(s) AS n, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(max(s), 6) AS most, round(100.0 * count(*) FILTER (WHERE s >= 0.15) / count(s), 6) AS above_pct FROM s GROUP BY label""",
)
def similarity_share(spark: SparkSession, d: str) -> DataFrame:
    """How similar a profile's vectors are to its centroid, and the share of them over a threshold."""
    e = table(spark, d, "embeddings")
    p = F.broadcast(small(centroids(e, "label", "embedding"), "label centroids"))
    s = e.join(p, "label").select("label", cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))
    out = speakers.threshold_share(s, "label", threshold=0.15)
    return out.select("label", "n", *(F.round(c, 6).alias(c) for c in ("least", "mean", "most", "above_pct")))


@query(
    "progress_eta",
    """SELECT user_id AS media_id, round(done / nullif(minutes, 0), 8) AS rate, round((total - done) / nullif(done / nullif(minutes, 0), 0), 4) AS eta_minutes FROM (
    SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS done, count(*) AS total, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS minutes FROM events GROUP BY 1)""",
)
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """Rate so far and time left of each item's work."""
    t = F.unix_micros(F.col("updated_at").cast("timestamp"))
    per = _state(spark, d).groupBy("media_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"), ((F.max(t) - F.min(t)) / 6e7).alias("minutes"))
    rate, eta = monitor.progress(F.col("done"), F.col("total"), F.col("minutes"))
    return per.select("media_id", F.round(rate, 8).alias("rate"), F.round(eta, 4).alias("eta_minutes"))


@query("limit_unprocessed", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 3) ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """The limit counts items that aren't processed yet."""
    done = table(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.next_unprocessed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), done, "o_orderkey", 25, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey")


@query(
    "recent_unprocessed",
    """SELECT event_id FROM (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END AS status, CASE event_id % 3 WHEN 0 THEN 'local_gpu' WHEN 1 THEN 'cloud_api' END AS m FROM events)
    WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND status <> 'done' AND (m IS NULL OR m <> 'local_gpu') ORDER BY ts DESC, event_id LIMIT 50""",
)
def recent_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    method = F.when(F.col("event_id") % 3 == 0, "local_gpu").when(F.col("event_id") % 3 == 1, "cloud_api")
    state = _state(spark, d).withColumnRenamed("updated_at", "created_at").withColumn("processing_method", method)
    return store.recent_unprocessed(state, F.expr("TIMESTAMP '2024-01-30'"), 7, "local_gpu", 50, "event_id").select("event_id")


@query("json_equality", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_extract_string(props, '$.k') = '42' ORDER BY ts DESC, event_id")
def json_equality(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose metadata holds a value, as text, newest first."""
    k = F.get_json_object("metadata", "$.k")
    return _state(spark, d).filter(k == "42").orderBy(F.desc("updated_at"), "event_id").select("event_id", k.alias("k"))


@query("interview_titles", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'interview|conversation|chat|talk|guest|podcast|discussion|debate')")
def interview_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(quality.interview(F.col("text"))).select("doc_id")


_MESSAGE = "CASE event_id % 4 WHEN 0 THEN 'ERROR: Membership required' WHEN 1 THEN 'Join this channel to get access to members-only content' WHEN 2 THEN 'HTTP 404' END"


@query("members_only_errors", f"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(coalesce({_MESSAGE}, '')), 'join this channel to get access to members-only content|membership required|premium content|available to members only|subscribers only|exclusive content')) AS n_members FROM events")
def members_only_errors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(quality.members_only_error(F.expr(_MESSAGE))).alias("n_members"))


@query("update_join", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey WHEN o_custkey % 5 > 0 THEN o_custkey END AS owner FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def update_join(spark: SparkSession, d: str) -> DataFrame:
    """Null references are filled from the parent, where there is one."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("owner"))
    return store.fill_from(rows, table(spark, d, "orders").filter("o_custkey % 5 > 0"), "l_orderkey", "o_orderkey", "owner", "o_custkey")


@query("unlabelled_parents", f"SELECT id, duration_s, count(*) AS n_rows FROM {_SOURCES} JOIN (SELECT source_id, CASE WHEN l_linenumber = 4 THEN speaker_label END AS speaker_label FROM {_PARTS}) ON source_id = id GROUP BY 1, 2 HAVING count(speaker_label) = 0 ORDER BY duration_s DESC, id")
def unlabelled_parents(spark: SparkSession, d: str) -> DataFrame:
    """Sources that have segments, none with a label, the longest first."""
    rows = _parts(spark, d).select(F.col("source_id").alias("id"), F.when(F.col("l_linenumber") == 4, F.col("speaker_label")).alias("speaker_label"))
    return store.without_labels(_sources(spark, d).select("id", "duration_s"), rows, "id", "speaker_label").orderBy(F.desc("duration_s"), "id")


@query("url_like", "SELECT page_id FROM pages WHERE url LIKE '%net/%' AND url LIKE '%1%'")
def url_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(F.contains("url", F.lit("net/")) & F.contains("url", F.lit("1"))).select("page_id")


@query("similarity_text", "SELECT event_id, printf('%.1f', round(abs(value / 128 * 100), 1)) AS pct FROM events")
def similarity_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", quality.percent_text(F.col("value") / 128).alias("pct"))


@query(
    "speaker_map",
    f"""WITH s AS (SELECT media_id, speaker_label AS k, sum(end_sec - start_sec) AS v FROM {SEGMENTS_SQL} GROUP BY 1, 2), t AS (SELECT *, sum(v) OVER (PARTITION BY media_id) AS t FROM s)
    SELECT media_id, string_agg(k || '=' || CAST(round(CASE WHEN t > 0 THEN 100.0 * v / t ELSE 0 END) AS BIGINT), ',' ORDER BY k) AS shares, max(CASE WHEN k = 'GUEST' THEN round(CASE WHEN t > 0 THEN 100.0 * v / t ELSE 0 END, 4) END) AS guest_pct,
    first(k ORDER BY v DESC, k) AS main_speaker FROM t GROUP BY media_id""",
)
def speaker_map(spark: SparkSession, d: str) -> DataFrame:
    """Each item's map of speakers, as text, one of its entries, and the main speaker."""
    m = speakers.speaker_map(segments(spark, d), "media_id")
    entries = F.transform(F.map_entries("shares"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]).cast("long").cast("string")))
    return m.select("media_id", F.array_join(entries, ",").alias("shares"), F.round(F.try_element_at("shares", F.lit("GUEST")), 4).alias("guest_pct"), "main_speaker")


@query("audio_windows", f"SELECT media_id, seq, CAST(count(*) AS BIGINT) AS n, round(min(b), 6) AS first_start, round(max(b) + 3, 6) AS last_end FROM (SELECT media_id, seq, start_sec + 1.5 * unnest(generate_series(0, CAST(floor((end_sec - start_sec - 3) / 1.5 + 1e-9) AS BIGINT))) AS b FROM {SEGMENTS_SQL} WHERE no_speech_prob < 0.5 AND end_sec - start_sec - 3 >= -1.5e-9) GROUP BY 1, 2")
def audio_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of three seconds over the segments that aren't silent."""
    w = seg.sliding_windows(segments(spark, d), F.col("no_speech_prob") < 0.5)
    return w.groupBy("media_id", "seq").agg(F.count("*").alias("n"), F.round(F.min("window_start"), 6).alias("first_start"), F.round(F.max("window_end"), 6).alias("last_end"))


@query(
    "span_refinement",
    f"""WITH s AS (SELECT *, seq - seq % 4 AS f FROM {SEGMENTS_SQL}), r AS (SELECT media_id, f, string_agg(text || '!', ' ' ORDER BY seq) AS t, max(avg_logprob / 2) AS lp, min(compression_ratio / 2) AS cr FROM s WHERE f % 8 = 0 AND seq % 4 < 2 GROUP BY 1, 2)
    SELECT s.media_id, seq, md5(CASE WHEN r.f IS NULL OR seq % 4 > 1 THEN text WHEN seq = s.f THEN t ELSE '' END) AS text_md5, round(CASE WHEN seq = r.f THEN lp ELSE avg_logprob END, 6) AS avg_logprob,
      round(CASE WHEN seq = r.f THEN cr ELSE compression_ratio END, 6) AS compression_ratio, r.f IS NOT NULL AND seq % 4 < 2 AS re_asr, avg_logprob < -0.5 AND NOT (r.f IS NOT NULL AND seq % 4 < 2) AS needs_refinement, CASE WHEN r.f IS NOT NULL AND seq % 4 = 1 THEN r.f END AS merged_into
    FROM s LEFT JOIN r ON s.media_id = r.media_id AND s.f = r.f""",
)
def span_refinement(spark: SparkSession, d: str) -> DataFrame:
    """The first two segments of every other four are recognised again and replaced."""
    s = segments(spark, d).withColumns({"re_asr": F.lit(False), "needs_refinement": F.col("avg_logprob") < -0.5})
    first = F.col("seq") - F.col("seq") % 4
    again = s.filter((first % 8 == 0) & (F.col("seq") % 4 < 2)).select("media_id", first.alias("first_seq"), F.col("seq").alias("part"), F.concat("text", F.lit("!")).alias("text"), (F.col("avg_logprob") / 2).alias("avg_logprob"), (F.col("compression_ratio") / 2).alias("compression_ratio"))
    last = again.groupBy("media_id", "first_seq").agg(F.max("part").alias("last_seq"))
    out = seg.replace_spans(s, again.join(last, ["media_id", "first_seq"]))
    return out.select("media_id", "seq", F.md5("text").alias("text_md5"), F.round("avg_logprob", 6).alias("avg_logprob"), F.round("compression_ratio", 6).alias("compression_ratio"), "re_asr", "needs_refinement", "merged_into")


@query(
    "search_scored_text",
    f"""SELECT doc_id, similarity FROM (SELECT doc_id, text, source, CASE WHEN doc_id % 10 = 0 THEN 'none' ELSE CAST(doc_id AS VARCHAR) END AS similarity FROM {CHUNKS_SQL}) WHERE source ILIKE '%tion%' OR text ILIKE '%tion%'
    ORDER BY TRY_CAST(similarity AS DOUBLE) DESC NULLS LAST, doc_id""",
)
def search_scored_text(spark: SparkSession, d: str) -> DataFrame:
    """Hits in title or text, by a score that is stored as text: numbers in their own order."""
    c = chunks(spark, d).withColumn("similarity", F.when(F.col("doc_id") % 10 == 0, "none").otherwise(F.col("doc_id").cast("string")))
    return search.in_title_or_text(c, "tion", "source").select("doc_id", "similarity")


_METHOD = "CASE event_id % 6 WHEN 0 THEN 'youtube' WHEN 1 THEN 'captions' WHEN 2 THEN 'yt_dlp' WHEN 3 THEN 'manual' WHEN 4 THEN 'large-v3' END"


@query("provenance_map", f"SELECT m, CASE WHEN m IN ('youtube', 'captions') THEN 'yt_caption' WHEN m = 'yt_dlp' THEN 'yt_dlp' WHEN m = 'manual' THEN 'owner' ELSE 'whisper' END AS provenance, count(*) AS n FROM (SELECT {_METHOD} AS m FROM events) GROUP BY 1, 2")
def provenance_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.expr(_METHOD)
    return table(spark, d, "events").groupBy(m.alias("m"), keys.provenance_of(m).alias("provenance")).agg(F.count("*").alias("n"))


_CITED = "substr(text, 1, 20) || ' [' || source || '@' || doc_id || ':07] and [x] or [' || lang || '@1:30].'"


@query("inline_citations", f"SELECT doc_id, array_to_string(regexp_extract_all(t, '\\[([^@\\[\\]]+@\\d+:\\d+)\\]', 1), ',') AS cited FROM (SELECT doc_id, {_CITED} AS t FROM documents)")
def inline_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.inline_citations(F.expr(_CITED)), ",").alias("cited"))


@query("unknown_to_guest", "SELECT conv_id, turn, CASE WHEN coalesce(trim(l), '') = '' THEN 'GUEST' ELSE l END AS label FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'Bob' END AS l FROM conversations)")
def unknown_to_guest(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'Bob' END")
    return table(spark, d, "conversations").select("conv_id", "turn", keys.normal_label(raw).alias("label"))


@query(
    "overlap_strict",
    f"""SELECT media_id, seq, CASE WHEN seq % 3 > 1 AND 1 - no_speech_prob < 0.62 + 0.03 THEN 'Unknown' ELSE speaker_label END AS label FROM {SEGMENTS_SQL}""",
)
def overlap_strict(spark: SparkSession, d: str) -> DataFrame:
    """Where several turns overlap, the threshold is stricter."""
    s = segments(spark, d)
    return s.select("media_id", "seq", speakers.strict_label(F.col("speaker_label"), 1 - F.col("no_speech_prob"), F.col("seq") % 3, 0.62).alias("label"))


@query(
    "monologue_check",
    f"""WITH {_CENTROIDS}, s AS (SELECT e.label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s, row_number() OVER (PARTITION BY e.label ORDER BY vec_id) AS rn FROM embeddings e JOIN p ON e.label = p.label)
    SELECT label, avg(s) >= greatest(0.2 * 0.9, 0.2 - 0.03) AS from_centroid, avg(s) >= greatest(0.2 * 0.8, 0.2 - 0.05) AS from_samples FROM s WHERE rn <= 5 GROUP BY label""",
)
def monologue_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first five vectors of each label are one speaker's."""
    from pyspark.sql.window import Window

    e = table(spark, d, "embeddings")
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("rn <= 5")
    p = F.broadcast(small(centroids(e, "label", "embedding"), "label centroids"))
    s = first.join(p, "label").select("label", "rn", cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    per = s.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]).alias("sims"))
    check = lambda c: speakers.is_monologue(F.col("sims"), F.lit(0.2), F.lit(c))
    return per.select("label", check(True).alias("from_centroid"), check(False).alias("from_samples"))


@query(
    "profile_max_similarity",
    """WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY i) AS rn FROM r WHERE i % greatest(1, n // 10) = 0)
    SELECT e.vec_id, k.label, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))), 6) AS s FROM embeddings e, k WHERE k.rn <= 10 GROUP BY 1, 2""",
)
def profile_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against ten sampled vectors of every profile; ids alone are put in order, and the sampled ones fetch their vectors."""
    e = table(spark, d, "embeddings")
    placed = ranked(e.select("label", "vec_id"), ["label", "vec_id"], "place")
    each = placed.groupBy("label").agg(F.min("place").alias("first"), F.greatest(F.lit(1), F.expr("count(*) div 10")).alias("step"))
    numbered = placed.join(broadcast_if_small(each), "label").withColumn("i", F.col("place") - F.col("first"))
    chosen = numbered.filter((F.col("i") % F.col("step") == 0) & (F.col("i") < 10 * F.col("step"))).select("label", "vec_id", "i")
    some = e.join(broadcast_if_small(chosen), ["label", "vec_id"])
    profiles = some.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "embedding"))), lambda x: x["embedding"]).alias("profile"))
    return e.select("vec_id", "embedding").join(F.broadcast(small(profiles, "profiles")), F.lit(True)).select("vec_id", "label", F.round(sampled_max(F.col("embedding"), F.col("profile")), 6).alias("s"))
