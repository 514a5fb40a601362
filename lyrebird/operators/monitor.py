"""Status, rate and quality reports over a run log (media_id, status, updated_at, duration_s, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the processing modes.
LOCAL, CLOUD = "local_gpu", "cloud_api"
ERROR_ALERT_PCT, QUOTA_ALERT_PCT, DAILY_QUOTA = 20.0, 80.0, 10_000


def recent(df: DataFrame, column: str, as_of: Column, interval: str) -> DataFrame:
    """Rows later than ``interval`` before as_of, strictly."""
    return df.filter(F.col(column) > as_of - F.expr(f"INTERVAL {interval}"))


def rate_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in per cent, null for an empty whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def health(log: DataFrame, as_of: Column, error: str = "error") -> DataFrame:
    """One row: n_total, n_items, n_recent and n_recent_errors of the last 24 hours, error_pct over that window, and whether it alerts."""
    late = F.col("updated_at") > as_of - F.expr("INTERVAL 24 HOURS")
    out = log.agg(F.count("*").alias("n_total"), F.count_distinct("media_id").alias("n_items"), F.count_if(late).alias("n_recent"), F.count_if(late & (F.col("status") == error)).alias("n_recent_errors"))
    out = out.withColumn("error_pct", F.coalesce(rate_pct(F.col("n_recent_errors"), F.col("n_recent")), F.lit(0.0)))
    return out.withColumn("alert", F.col("error_pct") > ERROR_ALERT_PCT)


def quota_estimate(n_items: Column) -> Column:
    """Units of an API quota: a listing and a detail call per item, captions at 50 for four of five."""
    return (n_items + n_items + F.lit(0.8) * 50 * n_items).cast("double")


def real_time_factor(work_s: Column, audio_s: Column) -> Column:
    return F.when(audio_s > 0, work_s / audio_s).otherwise(0.0)


def throughput(audio_s: Column, wall_s: Column) -> Column:
    """Hours of audio an hour; 0 where no time passed."""
    return F.when(wall_s > 0, audio_s / wall_s).otherwise(0.0)


def recommend_mode(items: DataFrame, tie: str, default_s: float = 1800.0, sample: int = 10, most_cost: float = 10.0, workers: int = 8, gpu: bool = True, key: bool = True, local_backlog: bool = True) -> DataFrame:
    """One row: n_items, avg_s of the first items, hours and cost estimated from it, gpu_hours and the processing mode.

    Up to five items go to the cloud, work that costs over ``most_cost`` stays local; then cloud without a GPU, local without a key, local
    for a backlog of over ten, else cloud. The cost follows the rate of ``cost_of``.
    """
    first = items.orderBy(tie).limit(sample).agg(F.avg(F.coalesce("duration_s", F.lit(default_s))).alias("avg_s"))
    out = items.agg(F.count("*").alias("n_items")).join(F.broadcast(first), F.lit(True))
    out = out.withColumn("hours", F.coalesce(F.col("avg_s"), F.lit(default_s)) * F.col("n_items") / 3600.0)
    out = out.withColumn("cost", cost_of(F.col("hours") * 60)).withColumn("gpu_hours", F.col("hours") / max(workers, 1))
    mode = F.when(F.col("n_items") <= 5, CLOUD).when(F.col("cost") > most_cost, LOCAL).when(F.lit(not gpu), CLOUD).when(F.lit(not key), LOCAL)
    return out.withColumn("mode", mode.when(F.lit(local_backlog) & (F.col("n_items") > 10), LOCAL).otherwise(CLOUD))


def processing_rates(log: DataFrame, done: str = "done") -> DataFrame:
    """One row over the items that are done: their number and chunks (``chunk_count``), the hours from first to last, and both per hour; null where no time passed."""
    t = F.unix_micros(F.col("updated_at").cast("timestamp")) / 3.6e9
    out = log.filter(F.col("status") == done).agg(F.count("*").alias("n_items"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_chunks"), (F.max(t) - F.min(t)).alias("hours"))
    return out.select("n_items", "n_chunks", F.round("hours", 2).alias("hours"), *(F.round(F.try_divide(F.col(c), F.nullif("hours", F.lit(0.0))), 2).alias(name) for c, name in (("n_items", "per_hour"), ("n_chunks", "chunks_per_hour"))))


def quota(log: DataFrame, as_of: Column) -> DataFrame:
    """One row over the items of the last 24 hours: n_items, estimated units, per cent of the daily quota, and whether it alerts."""
    pct = 100.0 * F.col("units") / DAILY_QUOTA
    out = recent(log, "updated_at", as_of, "24 HOURS").agg(F.count("*").alias("n_items")).withColumn("units", quota_estimate(F.col("n_items")))
    return out.select("n_items", F.round("units").cast("long").alias("units"), F.round(pct, 1).alias("quota_pct"), (pct > QUOTA_ALERT_PCT).alias("alert"))


def impact(pct_short: Column) -> Column:
    """How much short texts hurt search, by their share in per cent."""
    return F.when(pct_short > 70, "high").when(pct_short > 50, "medium").otherwise("low")


def metrics_report(log: DataFrame, as_of: Column, done: str = "done", error: str = "error") -> DataFrame:
    """(section, name, value): status counts, processing rates, the last day, the five most frequent errors, transcript sources in per cent,
    durations of what is done, and the API quota. The log has status, updated_at, chunk_count, last_error, has_captions, has_recognised and duration_s.
    """
    finished = log.filter(F.col("status") == done)
    late = recent(finished, "updated_at", as_of, "24 HOURS").agg(F.count("*").alias("items"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
    share = lambda c: rate_pct(F.count_if(F.col(c)), F.count("*"), 1)
    sources = finished.agg(share("has_captions").alias("captions_pct"), share("has_recognised").alias("recognised_pct"))
    s = F.col("duration_s")
    durations = finished.agg(F.min(s).alias("least_s"), F.max(s).alias("most_s"), F.round(F.avg(s), 1).alias("mean_s"), F.round(F.median(s), 1).alias("median_s"))
    errors = log.filter((F.col("status") == error) & F.col("last_error").isNotNull()).groupBy(F.col("last_error").alias("name")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "name").limit(5)
    counts = log.groupBy(F.col("status").alias("name")).agg(F.count("*").cast("double").alias("value"))
    parts = [_long("rates", processing_rates(log, done)), _long("last_day", late), _long("sources", sources), _long("durations", durations), _long("quota", quota(log, as_of).drop("alert"))]
    out = counts.select(F.lit("status").alias("section"), "name", "value").unionByName(errors.select(F.lit("errors").alias("section"), "name", "value"))
    for p in parts:
        out = out.unionByName(p)
    return out


def _long(section: str, row: DataFrame) -> DataFrame:
    """(section, name, value) of a one-row frame of numbers."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns)))
    return row.select(pairs.alias("x")).select(F.lit(section).alias("section"), "x.name", "x.value")


def alerts(report: DataFrame) -> DataFrame:
    """(level, subject, pct) of the rules that a metrics report breaks: over 80 % of the quota, over 20 % of all items in error."""
    value = lambda section, name: F.max(F.when((F.col("section") == section) & (F.col("name") == name), F.col("value")))
    total = F.sum(F.when(F.col("section") == "status", F.col("value")))
    row = report.agg(value("quota", "quota_pct").alias("quota"), (100.0 * F.coalesce(value("status", "error"), F.lit(0.0)) / F.nullif(total, F.lit(0.0))).alias("errors"))
    rules = F.array(*(F.struct(F.lit("warning").alias("level"), F.lit(subject).alias("subject"), F.round(c, 1).alias("pct"), F.coalesce(c > most, F.lit(False)).alias("broken")) for subject, c, most in (("api quota", F.col("quota"), QUOTA_ALERT_PCT), ("error rate", F.col("errors"), ERROR_ALERT_PCT))))
    return row.select(F.explode(rules).alias("r")).select("r.*").filter("broken").drop("broken")


def progress(done: Column, total: Column, minutes: Column) -> tuple[Column, Column]:
    """Items a minute, and the minutes that the rest takes at that rate; null before any time has passed or anything is done."""
    rate = F.try_divide(done.cast("double"), F.nullif(minutes.cast("double"), F.lit(0.0)))
    return rate, F.try_divide(F.greatest(total - done, F.lit(0)).cast("double"), F.nullif(rate, F.lit(0.0)))


def cost_of(minutes: Column, per_minute: float = 0.006) -> Column:
    return minutes * per_minute
