"""Composite queries: search pages, retrieval for answers, views, gates, listings."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions import quality, text
from lyrebird.functions.time import m_ss
from lyrebird.load import CHUNKS_SQL, SEGMENTS_SQL, chunks, run_log, segments, table
from lyrebird.operators import cluster, embed, search, store, vector_index, vector_search, views
from lyrebird.plans.registry import query
from lyrebird.storage import shared_folder

#: Rows that one task sorts into the folders of a stored table, about.
ROWS_A_FILE_TASK = 2_000_000


@query(
    "search_page",
    f"""WITH hits AS (SELECT *, CASE WHEN contains(text, 'tion') THEN 1 WHEN regexp_matches(text, '(?i)\\btion\\b') THEN 2 ELSE 3 END AS mc FROM {CHUNKS_SQL} WHERE text ILIKE '%tion%'),
    top AS (SELECT * FROM hits ORDER BY mc, n_chars DESC, doc_id LIMIT 200),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY start_sec, doc_id ROWS UNBOUNDED PRECEDING) AS c FROM (
      SELECT *, CASE WHEN abs(start_sec - lag(end_sec) OVER (PARTITION BY source ORDER BY start_sec, doc_id)) <= 120 THEN 0 ELSE 1 END AS fresh FROM top))
    SELECT source, count(DISTINCT c) AS n_clips, count(*) AS n_rows, max(n_chars) AS best FROM g GROUP BY source""",
)
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """Search, cut, cluster by gaps, group by source."""
    hits = search.keyword(chunks(spark, d), "tion")
    top = search.ranked(hits, F.asc("match_class"), F.desc("n_chars"), limit=200, tie="doc_id")
    g = cluster.gap_clusters(top, "source", "doc_id", 120, absolute=True)
    return g.groupBy("source").agg(F.count_distinct("cluster").alias("n_clips"), F.count("*").alias("n_rows"), F.max("n_chars").alias("best"))


@query(
    "answer_retrieval",
    f"""WITH hits AS (SELECT *, least(1.0, abs(n_chars / 8000.0) * (1.0 + (CASE WHEN doc_id % 3 = 0 THEN 0.10 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.05 ELSE 0.0 END))) AS boosted FROM {CHUNKS_SQL} WHERE text ILIKE '%en%'),
    top AS (SELECT * FROM hits ORDER BY boosted DESC, doc_id LIMIT 80),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY start_sec, doc_id ROWS UNBOUNDED PRECEDING) AS c FROM (
      SELECT *, CASE WHEN abs(start_sec - lag(end_sec) OVER (PARTITION BY source ORDER BY start_sec, doc_id)) <= 120 THEN 0 ELSE 1 END AS fresh FROM top))
    SELECT source, doc_id, round(boosted, 6) AS boosted FROM (SELECT *, row_number() OVER (PARTITION BY source, c ORDER BY boosted DESC, doc_id) AS rn FROM g) WHERE rn = 1""",
)
def answer_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Search, boost by recency and kind, cut, cluster, keep each cluster's best."""
    from lyrebird.functions.time import recency_boosted

    c = chunks(spark, d).filter(search.contains(F.col("text"), "en"))
    when = F.when(F.col("doc_id") % 3 == 0, F.expr("TIMESTAMP '2023-06-01'"))
    kind = F.when(F.col("lang") == "en", "youtube").otherwise("zoom")
    c = c.withColumn("boosted", recency_boosted(F.col("n_chars") / 8000.0, when, kind, F.expr("TIMESTAMP '2024-01-31'")))
    top = search.ranked(c, F.desc("boosted"), limit=80, tie="doc_id")
    g = cluster.gap_clusters(top, "source", "doc_id", 120, absolute=True)
    return cluster.best_of(g, "source", "boosted", "doc_id").select("source", "doc_id", F.round("boosted", 6).alias("boosted"))


@query(
    "rag_vector_context",
    """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 11),
    s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT v FROM q) AS DOUBLE[])) AS sim FROM embeddings WHERE vec_id <> 11 ORDER BY sim DESC, vec_id LIMIT 8)
    SELECT label, count(*) AS n, round(avg(sim), 6) AS mean, string_agg(vec_id || '@' || (vec_id * 45 // 60) || ':' || lpad(CAST(vec_id * 45 % 60 AS VARCHAR), 2, '0'), ',' ORDER BY vec_id) AS citations FROM s GROUP BY label""",
)
def rag_vector_context(spark: SparkSession, d: str) -> DataFrame:
    """Vector top k with citations of the form id@m:ss."""
    e = table(spark, d, "embeddings")
    top = vector_search.top_k(e.filter("vec_id <> 11"), vector_search.vector_of(e, 11), 8)
    cite = F.concat(F.col("vec_id").cast("string"), F.lit("@"), m_ss(F.col("vec_id") * 45))
    return top.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", cite.alias("c")))), lambda x: x["c"]), ",").alias("citations"))


@query(
    "segments_with_metadata",
    f"""SELECT media_id, seq, round(end_sec - start_sec, 6) AS duration, CASE speaker_label WHEN 'PRIMARY' THEN 'Primary speaker' WHEN 'GUEST' THEN 'Guest' ELSE speaker_label END AS speaker_display_name,
    CASE WHEN speaker_label = 'PRIMARY' AND (avg_logprob < -0.55 OR compression_ratio > 2.4) OR speaker_label = 'GUEST' AND (avg_logprob < -0.8 OR compression_ratio > 2.6) THEN 'low_quality' ELSE 'good_quality' END AS quality FROM {SEGMENTS_SQL}""",
)
def segments_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    return views.segments_with_metadata(segments(spark, d)).select("media_id", "seq", F.round("duration", 6).alias("duration"), "speaker_display_name", "quality")


@query(
    "processing_quality_analysis",
    "SELECT event_type AS method, count(*) AS n_items, count(*) FILTER (WHERE value > 10) AS n_ok, round(100.0 * count(*) FILTER (WHERE value > 10) / count(*), 2) AS success_rate, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_value FROM events GROUP BY 1",
)
def processing_quality_analysis(spark: SparkSession, d: str) -> DataFrame:
    log = run_log(spark, d).withColumnRenamed("status", "method")
    return views.processing_quality_analysis(log, F.col("duration_s") > 10, "$.k").withColumn("avg_value", F.round("avg_value", 6))


@query("cleanup_removed_count", "SELECT count(*) AS n_removed FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def cleanup_removed_count(spark: SparkSession, d: str) -> DataFrame:
    return views.cleanup_expired(run_log(spark, d), "updated_at", F.expr("TIMESTAMP '2024-01-15'"))[1]


@query(
    "chunk_coverage",
    f"""SELECT c.media_id, count(s.seq) AS n_segments, round(coalesce(sum(s.end_sec - s.start_sec), 0) / nullif(max(dur), 0), 6) AS coverage
    FROM (SELECT media_id, max(end_sec) + 10 AS dur FROM {SEGMENTS_SQL} GROUP BY 1) c LEFT JOIN {SEGMENTS_SQL} s ON s.media_id = c.media_id GROUP BY 1""",
)
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    durations = s.groupBy("media_id").agg((F.max("end_sec") + 10).alias("duration_s"))
    return views.coverage(s, durations).select("media_id", "n_segments", F.round("coverage", 6).alias("coverage"))


@query("storage_gate", f"SELECT media_id, seq, CAST(CASE WHEN speaker_label = 'PRIMARY' THEN length(text) END AS INTEGER) AS kept FROM {SEGMENTS_SQL}")
def storage_gate(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("media_id", "seq", views.gated_embedding(F.col("speaker_label"), F.length("text")).alias("kept"))


@query("listing_filters", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'members only|members exclusive|exclusive to members|member exclusive|patreon exclusive|subscriber exclusive|premium content|early access') AND doc_id % 9 <> 4 AND NOT regexp_matches(lower(text), '\\[(music|applause|laughter|silence)\\]') AND length(trim(text)) > 3")
def listing_filters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    availability = F.when(F.col("doc_id") % 9 == 4, "unlisted").when(F.col("doc_id") % 9 == 5, "private")
    gone = quality.members_only(availability, t) | text.is_non_verbal(t)
    return table(spark, d, "documents").filter(~gone & (F.length(F.trim(t)) > 3)).select("doc_id")


@query("provider_fallback", f"SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'manual' END, CASE WHEN doc_id % 2 = 0 THEN 'captions' END, 'recognised') AS provider FROM {CHUNKS_SQL}")
def provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Ordered providers: the first that has a transcript wins."""
    docs = table(spark, d, "documents").select("doc_id")
    offers = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("p"), F.lit("manual").alias("provider")).unionByName(docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("p"), F.lit("captions").alias("provider"))).unionByName(docs.select("doc_id", F.lit(3).alias("p"), F.lit("recognised").alias("provider")))
    return offers.groupBy("doc_id").agg(F.min_by("provider", "p").alias("provider"))


@query("best_row_per_group", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def best_row_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("embed_missing")
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose vector is missing get the hashing one; the others keep theirs."""
    s = table(spark, d, "conversations").select("conv_id", "turn", "text")
    have = embed.embed(s).withColumn("embedding", F.when(F.col("turn") % 2 == 0, F.col("embedding")))
    return embed.embed_missing(have, ["conv_id", "turn"]).select("conv_id", "turn", F.size("embedding").alias("dim"))


@query("ann_cells")
def ann_cells(spark: SparkSession, d: str) -> DataFrame:
    """Top ten by cosine among the rows of the four k-means cells nearest to the query."""
    e = table(spark, d, "embeddings")
    q = vector_search.vector_of(e, 5)
    centres = vector_search.fit_cells(e, 16, 3)
    return vector_search.probe(vector_search.assign_cells(e, centres), centres, q, 10, 4).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "ivf_full_probe",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 5)
    SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 25""",
)
def ivf_full_probe(spark: SparkSession, d: str) -> DataFrame:
    """A search of all lists of a stored index, half of whose rows were added later, is exact."""
    e = table(spark, d, "embeddings")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lists = vector_index.build(e.filter("vec_id % 2 = 0"), path)
    vector_index.add(e.filter("vec_id % 2 <> 0"), path)
    return vector_index.search(spark, path, vector_search.vector_of(e, 5), 25, lists).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("ivf_search_many")
def ivf_search_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar rows of every twentieth vector, in the sixteen lists nearest to it."""
    e = table(spark, d, "embeddings")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(e, path)
    return vector_index.search_many(spark, path, e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, 16).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("stored_children", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_orderkey % 7 = 0 AND l_linenumber <= 3 THEN l_quantity + 1 ELSE l_quantity END, 2) AS l_quantity FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_linenumber > 3 AND EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_linenumber <= 3))")
def stored_children(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order replace its stored ones, by buckets of orders."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = f"{shared_folder(spark)}/children-{uuid.uuid4().hex}"
    store.write_children(rows, path, "l_orderkey", 16)
    store.replace_stored(rows.filter("l_orderkey % 7 = 0 and l_linenumber <= 3").withColumn("l_quantity", F.col("l_quantity") + 1), path, "l_orderkey", 16)
    return store.read_children(spark, path).withColumn("l_quantity", F.round("l_quantity", 2))


@query("stored_sizes", "SELECT parent_bucket, count(*) AS n_rows, count_if(l_quantity > 40) AS dead_rows FROM (SELECT l_orderkey % 8 AS parent_bucket, l_quantity FROM lineitem) GROUP BY 1")
def stored_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and dead rows of each folder of a stored table, from its files, after small files were packed."""
    path = f"{shared_folder(spark)}/sizes-{uuid.uuid4().hex}"
    lines = table(spark, d, "lineitem").withColumn("parent_bucket", F.col("l_orderkey") % 8)
    # dealt by a hash, as rows dealt in turn are sorted first; a task's rows stay as many however large the table is
    parts = max(4, math.ceil(lines.count() / ROWS_A_FILE_TASK))
    lines.repartition(parts, "l_orderkey", "l_linenumber").write.partitionBy("parent_bucket").parquet(path)
    views.compact(spark, path, 64 << 20)
    stats = views.file_stats(spark, path, F.col("l_quantity") > 40)
    per = stats.withColumn("parent_bucket", F.regexp_extract("folder", r"parent_bucket=(\d+)$", 1).cast("long")).groupBy("parent_bucket")
    return per.agg(F.sum("n_rows").alias("n_rows"), F.sum("dead_rows").alias("dead_rows"))


@query("llm_blocks", f"SELECT doc_id, CAST(ceil(len(w) / 500) AS BIGINT) AS n_blocks, len(w) * 1.33 > 400 AS chunked FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def llm_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of words for a map-reduce summary, and whether a text needs them."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.word_blocks(t, 500)).cast("long").alias("n_blocks"), (text.word_count(t) * 1.33 > 400).alias("chunked"))
