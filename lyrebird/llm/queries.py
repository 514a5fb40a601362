"""The contract queries over the training-data operators: op1 to op13, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    from lyrebird.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from lyrebird.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 with row counts at most one apart."""
    from lyrebird.llm.ring import shard_rows

    out = shard_rows(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the corpus's verdict on the wider kinds."""
    from lyrebird.llm.secrets import digest, scan_corpus

    return digest(scan_corpus(table(spark, sf_dir, "documents")))


#: The contract's rules: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest fitting rule for every page's url."""
    from lyrebird.llm.urlfilter import judge_urls

    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles reach a Jaccard similarity of 0.9."""
    from lyrebird.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, p=90, q=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the subword-bag model."""
    from lyrebird.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archive back."""
    from lyrebird.llm.warc import read_archive, write_archive

    return read_archive(*write_archive(table(spark, sf_dir, "pages"), "html", 1000))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside occurrences of 13-word benchmark windows, and the items with windows that stand there in another order or spread over 2 words more."""
    from lyrebird.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13, slack=2)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every vector whose id is divisible by 100."""
    from lyrebird.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order of them, for every source."""
    from lyrebird.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes of every document."""
    from lyrebird.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of 40 centroids over the integer vectors."""
    from lyrebird.llm.centroids import clusters

    return clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


_QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_main_text": op2_html_main_text,
    "op3_ring_sharding": op3_ring_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_warc_archive": op8_warc_archive,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_entropy_mixing": op12_entropy_mixing,
    "op13_centroid_clustering": op13_centroid_clustering,
}
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5_SQL = """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT u.page_id, u.host, u.path, max_by(r.host || r.path, len(r.host || r.path)) AS rule,
  coalesce(max_by(r.verdict, len(r.host || r.path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY u.page_id, u.host, u.path
"""

_OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS d FROM p),
w AS (SELECT d, n, max(page_id) AS top FROM h WHERE n >= 1000 GROUP BY d, n)
SELECT h.page_id, h.n AS payload_bytes, h.d AS payload_digest,
  CASE WHEN w.top IS NOT NULL AND w.top <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.top <> h.page_id THEN w.top END AS refers_to
FROM h LEFT JOIN w ON h.d = w.d AND h.n = w.n
"""

_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT rid, width, i, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT rid, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, widths WHERE len(w) >= width)),
hits AS (SELECT dw.rid, dw.width, dw.i, dw.win, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
per AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + width - 1)) AS p FROM hits) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid),
wt AS (
  SELECT win, width, term, count(*) AS need FROM (SELECT win, width, unnest(string_split(win, ' ')) AS term FROM (SELECT DISTINCT win, width FROM bw)) GROUP BY win, width, term),
wn AS (SELECT win, width, count(*) AS terms FROM wt GROUP BY win, width),
dt AS (
  SELECT rid, term, list(pos ORDER BY pos) AS at FROM (SELECT rid, unnest(w) AS term, unnest(generate_series(1, len(w))) AS pos FROM d)
  WHERE term IN (SELECT term FROM wt) GROUP BY rid, term),
cand AS (
  SELECT dt.rid, wt.win, wt.width, list(dt.at) AS lists, list(wt.need) AS needs
  FROM dt JOIN wt ON dt.term = wt.term AND len(dt.at) >= wt.need
  GROUP BY dt.rid, wt.win, wt.width HAVING count(*) = (SELECT terms FROM wn WHERE wn.win = wt.win AND wn.width = wt.width)),
ends AS (
  SELECT rid, win, width, s, list_max(list_transform(list_zip(lists, needs), lambda x: coalesce(list_filter(x[1], lambda p: p >= s)[x[2]], 1000000000))) AS e
  FROM (SELECT rid, win, width, lists, needs, unnest(flatten(lists)) AS s FROM cand)),
near AS (SELECT rid, win, width, max(s) AS s, e FROM ends GROUP BY rid, win, width, e HAVING e - max(s) < width + 2),
nears AS (
  SELECT near.rid, count(DISTINCT bw.item_id) AS n_near FROM near JOIN bw ON bw.win = near.win AND bw.width = near.width
  WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.rid = near.rid AND hits.win = near.win AND hits.width = near.width AND hits.i = near.s AND near.e - near.s + 1 = near.width)
  GROUP BY near.rid)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN per ON d.rid = per.rid LEFT JOIN its ON d.rid = its.rid LEFT JOIN nears ON d.rid = nears.rid
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
m AS (
  SELECT part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    CASE WHEN doc_id IN (FROM good) THEN 1 ELSE 0 END AS good, CASE WHEN doc_id IN (FROM toxic) THEN 1 ELSE 0 END AS toxic
  FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(f, bit)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round assigns by all distances and floors the means, in whole numbers."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.vec_id, v.x, c.c, {distance} AS d FROM v, c{r} c) GROUP BY vec_id)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i)::BIGINT[] AS x FROM"
                f" (SELECT c, i, sum(u)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best.c AS c, unnest(x) AS u, unnest(generate_series(1, 64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best.c"""


_ORACLES: dict[str, str] = {
    "op5_url_filter": _OP5_SQL,
    "op8_warc_archive": _OP8_SQL,
    "op9_benchmark_decontamination": _OP9_SQL,
    "op11_filter_interaction_audit": _OP11_SQL,
    "op13_centroid_clustering": _op13_sql(),
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
