"""Search, clustering, ranking and answer queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.quality import confidence_band
from lyrebird.functions.time import recency_boosted
from lyrebird.functions.vector import cosine
from lyrebird.load import CHUNKS_SQL, chunks, table
from lyrebird.operators import answer, cluster, rerank, search, vector_search
from lyrebird.operators.bounds import small
from lyrebird.plans.registry import query

AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"

_PER_SOURCE = "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS source_chars FROM documents GROUP BY source"


def _per_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("source_chars"))


_CLASS = r"CASE WHEN contains(text, '{t}') THEN 1 WHEN regexp_matches(text, '(?i)\b{t}\b') THEN 2 ELSE 3 END"


@query(
    "search_keyword",
    f"""SELECT doc_id, d.source, n_chars, n_docs, source_chars, {_CLASS.format(t="the")} AS match_class
    FROM documents d JOIN ({_PER_SOURCE}) s ON d.source = s.source WHERE text ILIKE '%the%'
    ORDER BY match_class, n_chars DESC, doc_id LIMIT 30""",
)
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents that contain a term, with their source's totals, in match-class order."""
    docs = table(spark, d, "documents")
    # the cut comes before the join: only its rows meet the totals
    order = (F.col("match_class").asc(), F.desc("n_chars"))
    top = search.ranked(search.keyword(docs.filter("source IS NOT NULL"), "the").select("doc_id", "source", "n_chars", "match_class"), *order, limit=30, tie="doc_id")
    hits = F.broadcast(top).join(_per_source(docs), "source")
    return hits.orderBy(*order, "doc_id").select("doc_id", "source", "n_chars", "n_docs", "source_chars", "match_class")


@query("search_title_or_text", "SELECT doc_id, source FROM documents WHERE source ILIKE '%src1%' OR text ILIKE '%idiot%' ORDER BY doc_id LIMIT 100")
def search_title_or_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.filter(search.contains(F.col("source"), "src1") | search.contains(F.col("text"), "idiot")).orderBy("doc_id").limit(100).select("doc_id", "source")


@query("search_source_filter", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND text ILIKE '%100\\%%' ESCAPE '\\' OR source = 'src3' AND text ILIKE '%ing%' ORDER BY n_chars DESC, doc_id LIMIT 50")
def search_source_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = search.of_type(table(spark, d, "documents"), "src3")
    hits = docs.filter(search.contains(F.col("text"), "100%") | search.contains(F.col("text"), "ing"))
    return search.ranked(hits, F.desc("n_chars"), limit=50, tie="doc_id").select("doc_id", "n_chars")


@query("search_year_filter", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) = 1996 ORDER BY o_orderkey")
def search_year_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.of_year(table(spark, d, "orders"), 1996, "o_orderdate").select("o_orderkey", F.year("o_orderdate").alias("y"))


_PROV = "CASE lang WHEN 'en' THEN 'owner' WHEN 'fr' THEN 'yt_caption' WHEN 'de' THEN 'yt_dlp' END"
_PUBLISHED = "CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '2020-01-01' + (doc_id % 1000) * INTERVAL 1 DAY END"


def _published() -> Column:
    return F.when(F.col("doc_id") % 7 > 0, F.expr("TIMESTAMP '2020-01-01' + make_dt_interval(CAST(doc_id % 1000 AS INT))"))


def _provenance() -> Column:
    return F.when(F.col("lang") == "en", "owner").when(F.col("lang") == "fr", "yt_caption").when(F.col("lang") == "de", "yt_dlp")


@query(
    "search_provenance_order",
    f"""SELECT doc_id, prov FROM (SELECT *, coalesce({_PROV}, 'yt_caption') AS prov, {_PUBLISHED} AS published FROM {CHUNKS_SQL} WHERE text ILIKE '%en%' OR source ILIKE '%src1%')
    ORDER BY CASE WHEN text ILIKE '%en%' THEN 1 WHEN source ILIKE '%src1%' THEN 2 ELSE 3 END,
      CASE prov WHEN 'owner' THEN 1 WHEN 'yt_caption' THEN 2 WHEN 'yt_dlp' THEN 3 WHEN 'whisper' THEN 4 ELSE 5 END, published DESC NULLS LAST, start_sec, doc_id LIMIT 40""",
)
def search_provenance_order(spark: SparkSession, d: str) -> DataFrame:
    """Hits in the text before hits in the title, then by provenance, the newest first, then by time."""
    in_text, in_title = search.contains(F.col("text"), "en"), search.contains(F.col("source"), "src1")
    hits = chunks(spark, d).filter(in_text | in_title).withColumn("prov", F.coalesce(_provenance(), F.lit("yt_caption"))).withColumn("published", _published())
    order = (F.when(in_text, 1).when(in_title, 2).otherwise(3).asc(), search.provenance_rank(F.col("prov")).asc(), F.desc_nulls_last("published"), F.asc("start_sec"))
    return search.ranked(hits, *order, limit=40, tie="doc_id").select("doc_id", "prov")


@query(
    "answer_order",
    f"""SELECT doc_id, owner FROM (SELECT *, coalesce({_PROV}, 'yt_caption') = 'owner' AS owner, {_PUBLISHED} AS published FROM {CHUNKS_SQL} WHERE text ILIKE '%en%' OR source ILIKE '%src1%')
    ORDER BY CASE WHEN text ILIKE '%en%' THEN 1 ELSE 2 END, owner DESC, published DESC NULLS LAST, start_sec, doc_id LIMIT 40""",
)
def answer_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of an answer's fallback search: hits in the text, then the owner's, then the newest."""
    in_text, in_title = search.contains(F.col("text"), "en"), search.contains(F.col("source"), "src1")
    hits = chunks(spark, d).filter(in_text | in_title).withColumn("owner", F.coalesce(_provenance(), F.lit("yt_caption")) == "owner").withColumn("published", _published())
    return search.ranked(hits, F.when(in_text, 1).otherwise(2).asc(), F.desc("owner"), F.desc_nulls_last("published"), F.asc("start_sec"), limit=40, tie="doc_id").select("doc_id", "owner")


@query("search_word_match_class", f"SELECT {_CLASS.format(t='and')} AS match_class, count(*) AS n FROM documents WHERE text ILIKE '%and%' GROUP BY 1")
def search_word_match_class(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(table(spark, d, "documents"), "and").groupBy("match_class").agg(F.count("*").alias("n"))


_GAPS = f"""g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY start_sec, doc_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (
  SELECT *, CASE WHEN abs(start_sec - lag(end_sec) OVER (PARTITION BY source ORDER BY start_sec, doc_id)) <= 120 THEN 0 ELSE 1 END AS fresh
  FROM {CHUNKS_SQL} WHERE text ILIKE '%tion%'))"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    hits = chunks(spark, d).filter(search.contains(F.col("text"), "tion"))
    return cluster.gap_clusters(hits, "source", "doc_id", 120, absolute=True)


@query(
    "cluster_gap_merge",
    f"""WITH {_GAPS} SELECT source, CAST(cluster AS BIGINT) AS cluster, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n_rows,
    md5(string_agg(text, ' ... ' ORDER BY start_sec, doc_id)) AS text_md5 FROM g GROUP BY source, cluster""",
)
def cluster_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    out = cluster.merged(_clustered(spark, d), "source", "doc_id")
    return out.select("source", F.col("cluster").cast("long"), "start_sec", "end_sec", "n_rows", F.md5("text").alias("text_md5"))


@query(
    "cluster_gap_best",
    f"""WITH {_GAPS} SELECT source, CAST(cluster AS BIGINT) AS cluster, doc_id, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY source, cluster ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM g) WHERE rn = 1""",
)
def cluster_gap_best(spark: SparkSession, d: str) -> DataFrame:
    return cluster.best_of(_clustered(spark, d), "source", "n_chars", "doc_id").select("source", F.col("cluster").cast("long"), "doc_id", "n_chars")


@query(
    "group_by_source_clips",
    """SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n_clips, max(n_chars) OVER (PARTITION BY source) AS best
    FROM documents WHERE text ILIKE '%tion%' ORDER BY best DESC, source, doc_id""",
)
def group_by_source_clips(spark: SparkSession, d: str) -> DataFrame:
    """The clips of each source, one row each, the source with the best clip first; sources are counted before the join, and no list is gathered."""
    hits = table(spark, d, "documents").filter(search.contains(F.col("text"), "tion")).select("source", "doc_id", "n_chars")
    per = hits.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n_clips"), F.max("n_chars").alias("best"))
    return hits.join(per, F.col("source").eqNullSafe(F.col("_source"))).select("source", "doc_id", "n_clips", "best").orderBy(F.desc("best"), "source", "doc_id")


@query("year_facet", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders ORDER BY y DESC")
def year_facet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().orderBy(F.desc("y"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query("vector_topk_cosine", f"SELECT vec_id, round({_COS.format(a='embedding', b=_Q)}, 6) AS score FROM embeddings ORDER BY {_COS.format(a='embedding', b=_Q)} DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector_search.top_k(e, vector_search.vector_of(e, 7), 20).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "vector_scalar_subquery",
    f"""SELECT vec_id, label, round({_COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 3)')}, 6) AS score FROM embeddings
    ORDER BY {_COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 3)')} DESC, vec_id LIMIT 25""",
)
def vector_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.top_k_like(table(spark, d, "embeddings"), 3, 25).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_topk_l2", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), vec_id LIMIT 20")
def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector_search.top_k(e, vector_search.vector_of(e, 7), 20, measure="l2").select("vec_id", F.round("score", 6).alias("score"))


_CENTROIDS = """cells AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY label, i),
cent AS (SELECT label, list(x ORDER BY i) AS centroid FROM cells GROUP BY label)"""


@query("vector_label_centroid", f"WITH {_CENTROIDS} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM cells")
def vector_label_centroid(spark: SparkSession, d: str) -> DataFrame:
    from lyrebird.functions.vector import centroids

    return centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "vector_best_centroid",
    f"""WITH {_CENTROIDS} SELECT vec_id, label, best_label, round(similarity, 6) AS similarity FROM (
    SELECT vec_id, e.label, c.label AS best_label, {_COS.format(a='embedding', b='centroid')} AS similarity,
      row_number() OVER (PARTITION BY vec_id ORDER BY {_COS.format(a='embedding', b='centroid')} DESC, c.label) AS rn
    FROM embeddings e, cent c) WHERE rn = 1""",
)
def vector_best_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's best profile; profiles are one row per label and broadcast as one packed row."""
    from lyrebird.functions.vector import centroids

    e = table(spark, d, "embeddings")
    profiles = small(centroids(e, "label", "embedding"), "label centroids")
    packed = F.broadcast(profiles.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_p")))
    best = F.array_min(F.transform("_p", lambda p: F.struct((-cosine(F.col("embedding"), p["centroid"])).alias("s"), p["label"].alias("l"))))
    return e.join(packed, F.lit(True)).select("vec_id", "label", best.alias("b")).select("vec_id", "label", F.col("b.l").alias("best_label"), F.round(-F.col("b.s"), 6).alias("similarity"))


@query(
    "vector_pairwise_threshold",
    f"""SELECT label, count(*) AS n_pairs, round(avg(s), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0.7 ELSE greatest(0.5, avg(s) - 3 * stddev_pop(s)) END, 6) AS threshold
    FROM (SELECT a.label, {_COS.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
      ) GROUP BY label""",
)
def vector_pairwise_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Threshold per profile from the similarities of all pairs of its vectors."""
    from lyrebird.operators.speakers import pair_similarities, threshold_of

    s = pair_similarities(table(spark, d, "embeddings"), "label", "embedding")
    threshold = threshold_of(F.col("n_pairs"), F.col("mean"), F.col("deviation"))
    return s.select("label", "n_pairs", F.round("mean", 6).alias("mean"), F.round(threshold, 6).alias("threshold"))


@query(
    "recency_boost_rank",
    f"""SELECT o_orderkey, round(least(1.0, abs(o_totalprice / 600000.0) * (1.0 + (CASE WHEN y <= 1 THEN 0.10 WHEN y <= 2 THEN 0.05 ELSE 0.0 END
      + CASE WHEN o_orderkey % 2 = 0 THEN 0.05 ELSE 0.0 END))), 6) AS boosted FROM (
      SELECT *, (epoch({AS_OF}) - epoch(o_orderdate)) / (365 * 86400.0) AS y FROM orders)
    ORDER BY boosted DESC, o_orderkey LIMIT 50""",
)
def recency_boost_rank(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "youtube").otherwise("zoom")
    boosted = recency_boosted(F.col("o_totalprice") / 600000.0, F.col("o_orderdate"), kind, F.expr(AS_OF))
    return table(spark, d, "orders").select("o_orderkey", F.round(boosted, 6).alias("boosted")).orderBy(F.desc("boosted"), "o_orderkey").limit(50)


@query(
    "confidence_band",
    """SELECT label, count(*) AS n, CASE WHEN avg(abs(embedding[1])) * 8 > 0.85 AND count(*) >= 5 THEN 'high'
      WHEN avg(abs(embedding[1])) * 8 > 0.75 AND count(*) >= 3 THEN 'medium' ELSE 'low' END AS band FROM embeddings GROUP BY label""",
)
def confidence_band_query(spark: SparkSession, d: str) -> DataFrame:
    agg = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("embedding")[0].cast("double"))).alias("m"))
    return agg.select("label", "n", confidence_band(F.col("m") * 8, F.col("n")).alias("band"))


@query(
    "prompt_package",
    f"""SELECT source, string_agg(line, chr(10) || chr(10) ORDER BY n) AS prompt, string_agg(cite, ',' ORDER BY n) AS citations FROM (
      SELECT source, n, source || '@' || t AS cite, n || '. [' || lang || ' - ' || source || ' @ ' || t || ']: ' || text AS line FROM (
        SELECT *, CAST(floor(start_sec) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(start_sec) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS t,
          row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM {CHUNKS_SQL}) WHERE n <= 3) GROUP BY source""",
)
def prompt_package(spark: SparkSession, d: str) -> DataFrame:
    """Numbered snippets and citations of each source's three longest chunks."""
    return answer.prompt_package(chunks(spark, d), "source", F.desc("n_chars"), "doc_id", 3, title="lang").withColumn("citations", F.array_join("citations", ","))


@query(
    "rerank_lexical",
    """SELECT doc_id, round(1 / (1 + exp(-(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), ['the', 'thing', 'of', 'and'])) / 4.0 * 8 - 4))), 6) AS rerank_score
    FROM documents WHERE text ILIKE '%the%' ORDER BY rerank_score DESC, doc_id LIMIT 20""",
)
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    hits = search.keyword(table(spark, d, "documents"), "the")
    return answer.rerank(hits, "the thing of and", 20, "doc_id").select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def _opening_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each later turn beside the first text of its conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"), F.min("turn").alias("first"))
    return c.join(first, "conv_id").filter("turn > first").drop("first")


@query(
    "rerank_batches",
    """WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda x: x <> '') AS w, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
    s AS (SELECT b.conv_id, b.turn, 8.0::DOUBLE * len(list_intersect(a.w, b.w)) / greatest(1, len(a.w)) - 4 AS x FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = a.first AND b.turn > b.first)
    SELECT conv_id, turn, rank, round(1 / (1 + exp(-x)), 6) AS rerank_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY 1 / (1 + exp(-x)) DESC, turn) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
)
def rerank_batches(spark: SparkSession, d: str) -> DataFrame:
    """The three later turns of each conversation that share most words with its opening, scored in batches."""
    best = rerank.rerank_each(_opening_pairs(spark, d), "conv_id", "turn", 3, lambda: rerank.overlap)
    return best.select("conv_id", "turn", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("rerank_model")
def rerank_model(spark: SparkSession, d: str) -> DataFrame:
    """The same by a fitted model: a turn belongs to the opening of its own conversation, the turn of the next conversation doesn't."""
    pairs = _opening_pairs(spark, d)
    other = pairs.select((F.col("conv_id") - 1).alias("conv_id"), "turn", "text").join(pairs.select("conv_id", "query").distinct(), "conv_id")
    labelled = pairs.select("query", "text", F.lit(1).alias("label")).unionByName(other.select("query", "text", F.lit(0).alias("label")))
    load = rerank.pair_model(rerank.fit_pairs(labelled))
    return rerank.rerank_each(pairs, "conv_id", "turn", 3, load).select("conv_id", "turn", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "answer_confidence",
    f"""WITH ch AS (SELECT source AS answer_id, source AS video_id, doc_id, start_sec, least(1.0, n_chars / 4000.0) AS similarity, doc_id % 3 = 0 AS recent FROM {CHUNKS_SQL}),
    ci AS (SELECT source AS answer_id, source AS video_id, CASE WHEN doc_id % 4 = 0 THEN start_sec + 1 ELSE start_sec END AS t FROM {CHUNKS_SQL} WHERE doc_id % 5 < 3),
    a AS (SELECT answer_id, avg(similarity) AS s, count(*) AS n, count(*) FILTER (WHERE similarity > 0.7) AS h, bool_or(recent) AS r FROM ch GROUP BY 1),
    c AS (SELECT answer_id, count(*) AS cited, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ch WHERE ch.answer_id = ci.answer_id AND floor(ch.start_sec) = floor(ci.t))) AS good FROM ci GROUP BY 1),
    k AS (SELECT a.answer_id, n, h, r, CASE WHEN cited > 0 THEN good / cited ELSE 0 END AS cov, 0.9 * CASE WHEN cited > 0 THEN good / cited ELSE 0 END * least(1.0, 2 * s) AS v FROM a LEFT JOIN c USING (answer_id)),
    k2 AS (SELECT *, CASE WHEN n >= 5 AND cov >= 0.8 THEN least(1.0, v * 1.15) ELSE v END AS v2 FROM k),
    k3 AS (SELECT *, CASE WHEN h >= 3 THEN least(1.0, v2 * 1.1) ELSE v2 END AS v3 FROM k2)
    SELECT answer_id, round(least(1.0, CASE WHEN r THEN v3 * 1.1 ELSE v3 END), 2) AS confidence FROM k3""",
)
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    from lyrebird.functions.time import m_ss

    c = chunks(spark, d).withColumn("answer_id", F.col("source")).withColumn("video_id", F.col("source"))
    when = F.when(F.col("doc_id") % 3 == 0, F.expr("TIMESTAMP '2023-06-01'"))
    rows = c.select("answer_id", "video_id", "start_sec", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("similarity"), when.alias("published_at"))
    t = F.when(F.col("doc_id") % 4 == 0, F.col("start_sec") + 1).otherwise(F.col("start_sec"))
    cites = c.filter("doc_id % 5 < 3").select("answer_id", "video_id", m_ss(t).alias("timestamp"))
    return answer.answer_confidence(rows, cites, c.select("answer_id", F.lit(0.9).alias("llm_confidence")).distinct(), F.expr("TIMESTAMP '2024-01-31'"))
