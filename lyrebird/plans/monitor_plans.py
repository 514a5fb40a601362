"""Monitoring and data-quality reports over the run log and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.load import run_log, table
from lyrebird.operators import monitor
from lyrebird.plans.registry import query

AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"


@query("status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return run_log(spark, d).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query("top_errors", "SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' OR event_type = 'click' GROUP BY 1 ORDER BY n DESC, message LIMIT 5")
def top_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = run_log(spark, d).filter(F.col("status").isin("error", "click"))
    return bad.groupBy(F.col("metadata").alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(5)


@query("recent_window", f"SELECT event_id FROM events WHERE ts > {AS_OF} - INTERVAL 3 HOUR")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    return monitor.recent(run_log(spark, d), "updated_at", F.expr(AS_OF), "3 HOURS").select("event_id")


@query(
    "health_check",
    f"""SELECT n_total, n_items, n_recent, n_recent_errors, coalesce(round(100.0 * n_recent_errors / nullif(n_recent, 0), 2), 0.0) AS error_pct,
      coalesce(round(100.0 * n_recent_errors / nullif(n_recent, 0), 2), 0.0) > 20 AS alert FROM (
      SELECT count(*) AS n_total, count(DISTINCT user_id) AS n_items, count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 24 HOUR) AS n_recent,
        count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 24 HOUR AND event_type = 'click') AS n_recent_errors FROM events)""",
)
def health_check(spark: SparkSession, d: str) -> DataFrame:
    return monitor.health(run_log(spark, d), F.expr(AS_OF), "click")


def _state(spark: SparkSession, d: str) -> DataFrame:
    """Events as the ingest state: purchases are done, and chunk counts and transcript flags come from the metadata and the id."""
    k = F.get_json_object("metadata", "$.k").try_cast("long")
    status = F.when(F.col("status") == "purchase", "done").otherwise(F.col("status"))
    more = {"status": status, "chunk_count": k, "last_error": F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("code "), (k % 10).cast("string"))), "has_captions": F.col("event_id") % 3 == 0, "has_recognised": F.col("event_id") % 3 > 0}
    return run_log(spark, d).withColumns(more)


_STATE = """(SELECT event_id, ts, user_id, value, CASE event_type WHEN 'purchase' THEN 'done' ELSE event_type END AS status, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk_count,
  CASE WHEN event_id % 4 > 0 THEN 'code ' || (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) END AS last_error, event_id % 3 = 0 AS has_captions, event_id % 3 > 0 AS has_recognised FROM events)"""

_RATES = f"""SELECT n_items, n_chunks, round(h, 2) AS hours, round(n_items / nullif(h, 0), 2) AS per_hour, round(n_chunks / nullif(h, 0), 2) AS chunks_per_hour FROM (
  SELECT count(*) AS n_items, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS n_chunks, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM {_STATE} WHERE status = 'done')"""


@query("processing_rates", _RATES)
def processing_rates(spark: SparkSession, d: str) -> DataFrame:
    """Items and chunks an hour, from the first to the last item that is done."""
    return monitor.processing_rates(_state(spark, d))


_QUOTA = f"""SELECT n_items, CAST(round(n_items * 42.0) AS BIGINT) AS units, round(CAST(n_items * 42.0 * 100 / 10000 AS DOUBLE), 1) AS quota_pct, n_items * 42.0 * 100 / 10000 > 80 AS alert
  FROM (SELECT count(*) AS n_items FROM events WHERE ts > {AS_OF} - INTERVAL 24 HOUR)"""
_REPORT = f"""r AS ({_RATES}), q AS ({_QUOTA}),
l AS (SELECT count(*) AS items, coalesce(sum(chunk_count), 0) AS chunks FROM {_STATE} WHERE status = 'done' AND ts > {AS_OF} - INTERVAL 24 HOUR),
s AS (SELECT round(100.0 * count(*) FILTER (WHERE has_captions) / count(*), 1) AS captions_pct, round(100.0 * count(*) FILTER (WHERE has_recognised) / count(*), 1) AS recognised_pct FROM {_STATE} WHERE status = 'done'),
t AS (SELECT min(value) AS least_s, max(value) AS most_s, round(avg(value), 1) AS mean_s, round(quantile_cont(value, 0.5), 1) AS median_s FROM {_STATE} WHERE status = 'done'),
report AS (
  SELECT 'status' AS section, status AS name, CAST(count(*) AS DOUBLE) AS value FROM {_STATE} GROUP BY 2
  UNION ALL (SELECT 'errors', last_error, CAST(count(*) AS DOUBLE) AS n FROM {_STATE} WHERE status = 'error' AND last_error IS NOT NULL GROUP BY 2 ORDER BY n DESC, last_error LIMIT 5)
  UNION ALL SELECT 'rates', x.name, x.value FROM (SELECT unnest([{{'name': 'n_items', 'value': CAST(n_items AS DOUBLE)}}, {{'name': 'n_chunks', 'value': CAST(n_chunks AS DOUBLE)}}, {{'name': 'hours', 'value': hours}}, {{'name': 'per_hour', 'value': per_hour}}, {{'name': 'chunks_per_hour', 'value': chunks_per_hour}}]) AS x FROM r)
  UNION ALL SELECT 'last_day', x.name, x.value FROM (SELECT unnest([{{'name': 'items', 'value': CAST(items AS DOUBLE)}}, {{'name': 'chunks', 'value': CAST(chunks AS DOUBLE)}}]) AS x FROM l)
  UNION ALL SELECT 'sources', x.name, x.value FROM (SELECT unnest([{{'name': 'captions_pct', 'value': CAST(captions_pct AS DOUBLE)}}, {{'name': 'recognised_pct', 'value': CAST(recognised_pct AS DOUBLE)}}]) AS x FROM s)
  UNION ALL SELECT 'durations', x.name, x.value FROM (SELECT unnest([{{'name': 'least_s', 'value': least_s}}, {{'name': 'most_s', 'value': most_s}}, {{'name': 'mean_s', 'value': mean_s}}, {{'name': 'median_s', 'value': median_s}}]) AS x FROM t)
  UNION ALL SELECT 'quota', x.name, x.value FROM (SELECT unnest([{{'name': 'n_items', 'value': CAST(n_items AS DOUBLE)}}, {{'name': 'units', 'value': CAST(units AS DOUBLE)}}, {{'name': 'quota_pct', 'value': quota_pct}}]) AS x FROM q))"""


@query("metrics_report", f"WITH {_REPORT} SELECT * FROM report")
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the monitoring report, one row each."""
    return monitor.metrics_report(_state(spark, d), F.expr(AS_OF))


@query(
    "alert_rules",
    f"""WITH {_REPORT}, v AS (SELECT max(CASE WHEN section = 'quota' AND name = 'quota_pct' THEN value END) AS quota,
      100.0 * coalesce(max(CASE WHEN section = 'status' AND name = 'error' THEN value END), 0) / sum(CASE WHEN section = 'status' THEN value END) AS errors FROM report)
    SELECT 'warning' AS level, 'api quota' AS subject, round(quota, 1) AS pct FROM v WHERE quota > 80 UNION ALL SELECT 'warning', 'error rate', round(errors, 1) FROM v WHERE errors > 20""",
)
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that the report breaks."""
    return monitor.alerts(monitor.metrics_report(_state(spark, d), F.expr(AS_OF)))


@query("duration_stats_median", "SELECT event_type AS status, round(min(value), 4) AS least, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(max(value), 4) AS most FROM events GROUP BY 1")
def duration_stats_median(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("duration_s")
    return run_log(spark, d).groupBy("status").agg(F.round(F.min(v), 4).alias("least"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.round(F.max(v), 4).alias("most"))


@query("transcript_source_pct", "SELECT round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS caption_pct, round(100.0 * sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) / count(*), 4) AS recognised_pct FROM documents")
def transcript_source_pct(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return table(spark, d, "documents").agg(F.round(100.0 * F.count_if(F.col("lang") == "en") / n, 4).alias("caption_pct"), F.round(100.0 * F.sum(F.when(F.col("lang") != "en", 1).otherwise(0)) / n, 4).alias("recognised_pct"))


@query("success_rate", "SELECT user_id AS media_id, count(*) AS n, count(CASE WHEN event_type <> 'click' THEN 1 END) AS ok, round(100.0 * count(CASE WHEN event_type <> 'click' THEN 1 END) / nullif(count(*), 0), 2) AS rate FROM events GROUP BY 1")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    ok = F.count_if(F.col("status") != "click")
    return run_log(spark, d).groupBy("media_id").agg(F.count("*").alias("n"), ok.alias("ok"), monitor.rate_pct(ok, F.count("*")).alias("rate"))


_K = "json_extract_string(props, '$.k')"


@query("json_avg", f"SELECT event_type AS status, round(avg(TRY_CAST({_K} AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1")
def json_avg(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("metadata", "$.k").try_cast("double")
    return run_log(spark, d).groupBy("status").agg(F.round(F.avg(k), 6).alias("mean_k"))


@query("json_text_compare", f"SELECT event_id FROM events WHERE {_K} > '50'")
def json_text_compare(spark: SparkSession, d: str) -> DataFrame:
    """Text order, as '9' > '50'; kept beside the numeric form."""
    return run_log(spark, d).filter(F.get_json_object("metadata", "$.k") > "50").select("event_id")


@query("json_numeric_compare", f"SELECT event_id FROM events WHERE TRY_CAST({_K} AS DOUBLE) > 50")
def json_numeric_compare(spark: SparkSession, d: str) -> DataFrame:
    return run_log(spark, d).filter(F.get_json_object("metadata", "$.k").try_cast("double") > 50).select("event_id")


@query("json_group", f"SELECT {_K} AS k, count(*) AS n FROM events GROUP BY 1")
def json_group(spark: SparkSession, d: str) -> DataFrame:
    return run_log(spark, d).groupBy(F.get_json_object("metadata", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("cost_by_day", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type AS method, count(*) AS n, round(sum(value / 60 * 0.006), 4) AS cost FROM events GROUP BY 1, 2")
def cost_by_day(spark: SparkSession, d: str) -> DataFrame:
    cost = monitor.cost_of(F.col("duration_s") / 60)
    return run_log(spark, d).groupBy(F.date_trunc("day", "updated_at").cast("timestamp_ntz").alias("day"), F.col("status").alias("method")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 4).alias("cost"))


@query("cost_by_month", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def cost_by_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "throughput_ratio",
    "SELECT user_id AS media_id, round(sum(value) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 8) AS ratio FROM events GROUP BY 1",
)
def throughput_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("updated_at").cast("timestamp")) / 1e6
    return run_log(spark, d).groupBy("media_id").agg(F.round(F.try_divide(F.sum("duration_s"), F.max(t) - F.min(t)), 8).alias("ratio"))


@query("quota_estimate", _QUOTA)
def quota_estimate(spark: SparkSession, d: str) -> DataFrame:
    """API units of the last day's items."""
    return monitor.quota(run_log(spark, d), F.expr(AS_OF))


_BOUNDS = (50, 100, 500, 1000, 1500)
_NAMES = ("0-50", "50-100", "100-500", "500-1000", "1000-1500", "1500+")
_BUCKET = "CASE " + " ".join(f"WHEN length(text) < {b} THEN '{n}'" for b, n in zip(_BOUNDS, _NAMES)) + f" ELSE '{_NAMES[-1]}' END"


@query("length_histogram_share", f"SELECT {_BUCKET} AS bucket, count(*) AS n, round(CAST(100.0 * count(*) / sum(count(*)) OVER () AS DOUBLE), 1) AS share FROM conversations GROUP BY 1 ORDER BY min(length(text))")
def length_histogram_share(spark: SparkSession, d: str) -> DataFrame:
    n, bucket = F.length("text"), F
    for most, name in zip(_BOUNDS, _NAMES, strict=False):
        bucket = bucket.when(n < most, name)
    per = table(spark, d, "conversations").groupBy(bucket.otherwise(_NAMES[-1]).alias("bucket")).agg(F.count("*").alias("n"), F.min(n).alias("least"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("t"))), F.lit(True)).orderBy("least").select("bucket", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("share"))


@query(
    "length_audit",
    """SELECT *, CASE WHEN 100.0 * under_100 / n > 70 THEN 'high' WHEN 100.0 * under_100 / n > 50 THEN 'medium' ELSE 'low' END AS impact FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE length(text) < 50) AS under_50, count(*) FILTER (WHERE length(text) < 100) AS under_100, count(*) FILTER (WHERE length(text) >= 150) AS from_150, round(avg(length(text)), 4) AS avg_chars FROM conversations)""",
)
def length_audit(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    out = table(spark, d, "conversations").agg(F.count("*").alias("n"), F.count_if(n < 50).alias("under_50"), F.count_if(n < 100).alias("under_100"), F.count_if(n >= 150).alias("from_150"), F.round(F.avg(n), 4).alias("avg_chars"))
    return out.withColumn("impact", monitor.impact(100.0 * F.col("under_100") / F.col("n")))


@query("shortest_longest", "(SELECT 'short' AS kind, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 10) UNION ALL (SELECT 'long', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)")
def shortest_longest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    pick = lambda kind, order: docs.orderBy(order, "doc_id").limit(10).select(F.lit(kind).alias("kind"), "doc_id", "n_chars")
    return pick("short", F.asc("n_chars")).unionByName(pick("long", F.desc("n_chars")))


@query("delta_between_polls", "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1)")
def delta_between_polls(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day and their change; the window runs over one row a day."""
    from pyspark.sql.window import Window

    per = run_log(spark, d).groupBy(F.date_trunc("day", "updated_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return per.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("day")))


@query("nested_group_count", "SELECT n_lines, count(*) AS n_orders FROM (SELECT count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) GROUP BY n_lines")
def nested_group_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).groupBy("n_lines").agg(F.count("*").alias("n_orders"))


@query(
    "recommend_mode",
    """WITH cases AS (SELECT unnest([3, 8, 40]) AS most),
    x AS (SELECT most, (SELECT count(*) FROM events WHERE event_id < most) AS n_items, (SELECT avg(coalesce(value, 1800)) FROM (SELECT event_id, value FROM events WHERE event_id < most ORDER BY event_id LIMIT 10)) * 60 AS avg_s FROM cases)
    SELECT n_items, round(avg_s, 4) AS avg_s, round(avg_s * n_items / 3600, 6) AS hours, round(avg_s * n_items / 3600 * 60 * 0.006, 6) AS cost, round(avg_s * n_items / 3600 / 8, 6) AS gpu_hours,
      CASE WHEN n_items <= 5 THEN 'cloud_api' WHEN avg_s * n_items / 3600 * 60 * 0.006 > 10 THEN 'local_gpu' WHEN n_items > 10 THEN 'local_gpu' ELSE 'cloud_api' END AS mode FROM x
    UNION ALL SELECT n_items, round(avg_s, 4), round(avg_s * n_items / 3600, 6), round(avg_s * n_items / 3600 * 60 * 0.006, 6), round(avg_s * n_items / 3600 / 8, 6),
      CASE WHEN avg_s * n_items / 3600 * 60 * 0.006 > 10 THEN 'local_gpu' ELSE 'cloud_api' END FROM (SELECT count(*) AS n_items, (SELECT avg(value) FROM (SELECT value FROM events ORDER BY event_id LIMIT 10)) * 60 AS avg_s FROM events)""",
)
def recommend_mode(spark: SparkSession, d: str) -> DataFrame:
    """Processing mode for the whole log and, as smaller batches, for its first 3, 8 and 40 items; durations are taken as minutes."""
    log = run_log(spark, d).select("event_id", (F.col("duration_s") * 60).alias("duration_s"))
    batches = [log.filter(F.col("event_id") < n) for n in (3, 8, 40)] + [log]
    out = None
    for b in batches:
        row = monitor.recommend_mode(b, "event_id").select("n_items", *(F.round(c, digits).alias(c) for c, digits in (("avg_s", 4), ("hours", 6), ("cost", 6), ("gpu_hours", 6))), "mode")
        out = row if out is None else out.unionByName(row)
    return out
