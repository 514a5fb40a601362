"""Upserts, dedupe, queues and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.keys import pair_digest
from lyrebird.load import run_log, table
from lyrebird.operators import store
from lyrebird.operators.bounds import broadcast_if_small
from lyrebird.plans.registry import query

_NORM = "lower(trim(text))"


@query("dedupe_first_text", f"SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    return store.dedupe_first(docs, ["h"], "doc_id").select("doc_id", "n_chars")


@query("duplicate_groups", f"SELECT md5({_NORM}) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY {_NORM} HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("h"))
    return t.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    "duplicate_audit",
    f"""SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_surplus, max(n) AS largest
    FROM (SELECT count(*) AS n FROM documents GROUP BY {_NORM} HAVING count(*) > 1)""",
)
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    g = duplicate_groups(spark, d)
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_surplus"), F.max("n").alias("largest"))


@query("distinct_pair_count", "SELECT count(*) AS n_pairs FROM (SELECT DISTINCT source, text FROM documents)")
def distinct_pair_count(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs, those with a null too; digests are shuffled, not texts."""
    return table(spark, d, "documents").agg(F.count_distinct(pair_digest("source", "text")).alias("n_pairs"))


_CUST = "customer"
_IN = "(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name || ' new' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)"
_OLD = "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, _CUST).select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 != 0, F.concat("c_name", F.lit(" new"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return c.filter("c_custkey % 2 = 0"), new


@query("upsert_coalesce", f"SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) AS c_acctbal FROM {_OLD} o FULL JOIN {_IN} n USING (c_custkey)")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_old_and_new(spark, d), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "upsert_overwrite",
    f"""SELECT c_custkey, CASE WHEN n.c_acctbal IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) AS c_acctbal
    FROM {_OLD} o FULL JOIN {_IN} n USING (c_custkey)""",
)
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_old_and_new(spark, d), ["c_custkey"], keep_old_on_null=False).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("upsert_metadata_only", f"SELECT c_custkey, coalesce(o.c_name, n.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) AS c_acctbal FROM {_OLD} o FULL JOIN {_IN} n USING (c_custkey)")
def upsert_metadata_only(spark: SparkSession, d: str) -> DataFrame:
    """Existing rows take only the listed column."""
    return store.upsert(*_old_and_new(spark, d), ["c_custkey"], only=("c_acctbal",)).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("replace_children", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber > 2 AND EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber <= 2))")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders divisible by 5 are replaced by versions of at most two lines; no stale line stays."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return store.replace_children(rows, rows.filter("l_orderkey % 5 = 0 and l_linenumber <= 2"), "l_orderkey")


@query("latest_state", "SELECT user_id AS media_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(run_log(spark, d), ["media_id"], F.desc("updated_at"), F.desc("event_id")).select("media_id", "status", "event_id")


@query("ttl_cleanup", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31'")
def ttl_cleanup(spark: SparkSession, d: str) -> DataFrame:
    log = run_log(spark, d).withColumn("expires_at", F.col("updated_at") + F.expr("INTERVAL 7 DAYS"))
    return store.unexpired(log, "expires_at", F.expr("TIMESTAMP '2024-01-31'")).select("event_id")


@query("batch_numbering", "SELECT doc_id, source, md5(text) AS text_md5, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_no FROM documents")
def batch_numbering(spark: SparkSession, d: str) -> DataFrame:
    return store.batches(table(spark, d, "documents"), "doc_id", 64).select("doc_id", "source", F.md5("text").alias("text_md5"), "batch_no")


@query("anti_unprocessed", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return store.unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(
    "pending_queue_retry",
    """SELECT event_id, status FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'done' END AS status, event_id % 5 AS retries FROM events)
    WHERE status = 'pending' OR (status = 'error' AND retries < 3) ORDER BY CASE status WHEN 'pending' THEN 0 ELSE 1 END, event_id LIMIT 3000""",
)
def pending_queue_retry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.expr("CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'done' END AS status"), (F.col("event_id") % 5).alias("retries"))
    return store.pending_queue(e, 3000, "event_id").select("event_id", "status")


@query(
    "conditional_update",
    """SELECT e.event_id, CASE WHEN e.event_id % 3 = 0 THEN 'error' ELSE event_type END AS status, CASE WHEN e.event_id % 6 = 0 THEN 'timeout' END AS last_error,
    CASE WHEN e.event_id % 9 = 0 THEN 1 ELSE 0 END AS retries FROM events e""",
)
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(0).alias("retries"))
    change = state.filter("event_id % 3 = 0").select("event_id", F.lit("error").alias("status"), F.when(F.col("event_id") % 6 == 0, "timeout").alias("error"), (F.col("event_id") % 9 == 0).alias("count"))
    return store.conditional_update(state, change, "event_id").select("event_id", "status", "last_error", "retries")


_COSTS = "(SELECT event_id, user_id AS media_id, props AS metadata, ts, CAST(round(CAST(round(value, 2) AS DECIMAL(18, 2)) * 100) AS BIGINT) AS cost FROM events)"


@query(
    "running_cost_cap",
    f"""SELECT event_id, media_id, metadata FROM (SELECT *, coalesce(sum(cost) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {_COSTS})
    WHERE spent < (SELECT sum(cost) // 2 FROM {_COSTS})""",
)
def running_cost_cap(spark: SparkSession, d: str) -> DataFrame:
    """A whole run stops once it has spent half of what all of it would cost; costs are whole hundredths, so that sums are exact."""
    log = run_log(spark, d).withColumn("cost", F.round(F.round("duration_s", 2) * 100).cast("long"))
    cap = log.agg(F.expr("sum(cost) div 2")).first()[0] or 0
    return store.within_budget(log, ["updated_at", "event_id"], "cost", cap).select("event_id", "media_id", "metadata")


@query(
    "integrity_checks",
    """SELECT (SELECT count(*) FROM labels) AS n_children, (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS n_null_parents,
    (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 7 <> 0)) AS n_orphans,
    (SELECT count(*) FROM (SELECT quality, toxic FROM labels GROUP BY 1, 2 HAVING count(*) > 1)) AS n_duplicate_groups""",
)
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    return store.integrity(table(spark, d, "documents").filter("doc_id % 7 <> 0"), table(spark, d, "labels"), "doc_id", "doc_id", ["quality", "toxic"])


@query("coverage_nonnull", "SELECT count(*) AS n_docs, count(quality) AS n_quality, count(toxic) AS n_toxic, round(100.0 * count(quality) / count(*), 4) AS pct FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_nonnull(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_quality"), F.count("toxic").alias("n_toxic"), F.round(100.0 * F.count("quality") / F.count("*"), 4).alias("pct"))


@query("orphan_check", "SELECT count(*) AS n_orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(live, "l_orderkey", "left_anti").agg(F.count("*").alias("n_orphans"))


@query("latest_with_child_count", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 5) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def latest_with_child_count(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey")
    return top.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"))


@query("correlated_source_stats", "SELECT n_name, round(avg((SELECT count(*) FROM orders WHERE o_custkey = c_custkey)), 6) AS avg_orders FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def correlated_source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean of per-parent counts: children are counted once, parents without any keep 0."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    nation = broadcast_if_small(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(per, "c_custkey", "left").join(nation, "c_nationkey")
    return c.groupBy("n_name").agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("avg_orders"))


@query("exists_any", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
def exists_any(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(rich, "n_nationkey", "left_semi").select("n_name")
