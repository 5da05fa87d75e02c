"""Telemetry rollups: summaries, cumulative counters, histograms, rolling sums."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read


def pricing_summary(spark, sf_dir):
    """Grouped sums and averages of a fact table."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("sum_qty"), F.round(F.avg(F.col("l_extendedprice").cast("double")), 4).alias("avg_price"), F.count(F.lit(1)).alias("n_rows"))
    )


def request_summary(spark, sf_dir):
    """Totals of all requests, with conditional counts (nulls count as 0)."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    return read(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.round(F.sum(value), 2).alias("total_value"),
        F.round(F.avg(value), 6).alias("avg_value"),
        F.count_if(F.col("event_type") == "click").alias("n_clicks"),
        F.countDistinct("user_id").alias("n_users"),
    )


def daily_rollup(spark, sf_dir):
    """Cumulative counters: the largest of each user and day, summed by day."""
    per_user = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max(F.col("value").cast("double")).alias("top"))
    return per_user.groupBy("day").agg(F.round(F.sum("top"), 2).alias("total"), F.count(F.lit(1)).alias("n_users"))


def hourly_rollup(spark, sf_dir):
    """The last 48 hours by hour."""
    events = read(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("latest"))  # one row
    recent = events.join(F.broadcast(latest), F.col("ts") >= F.col("latest") - F.expr("interval 48 hours"))
    return recent.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


def top_instances(spark, sf_dir):
    """The 20 users with the largest sum of daily maxima."""
    per_day = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.col("value").cast("double")).alias("top"))
    return per_day.groupBy("user_id").agg(F.round(F.sum("top"), 2).alias("total")).orderBy(F.desc("total"), "user_id").limit(20)


def type_breakdown(spark, sf_dir):
    """Counts by type, null as '?'."""
    return read(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("?")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def savings_deltas(spark, sf_dir):
    """Non-negative steps of each user's series, summed by ISO week."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.col("value").cast("double")
    steps = read(spark, sf_dir, "events").select(F.date_trunc("week", "ts").alias("week"), F.greatest(value - F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.lit(0.0)).alias("step"))
    return steps.groupBy("week").agg(F.round(F.sum("step"), 2).alias("saved"), F.count(F.lit(1)).alias("n"))


def session_totals(spark, sf_dir):
    """Sessions of a user end after 60 minutes without events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr("interval 60 minutes")
    numbered = read(spark, sf_dir, "events").withColumn("new", F.when(gap, 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def throughput_percentiles(spark, sf_dir):
    """Linearly interpolated percentiles by type."""
    value = F.col("value").cast("double")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile(value, 0.5), 4).alias("p50"), F.round(F.percentile(value, 0.95), 4).alias("p95"))


def rolling_spend(spark, sf_dir):
    """Trailing hour of a user's value before each event, and whether it is over its limit."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, -1)
    spent = F.round(F.coalesce(F.sum(F.col("value").cast("double")).over(w), F.lit(0.0)), 2)
    return read(spark, sf_dir, "events").select("event_id", spent.alias("spent")).withColumn("over_limit", F.col("spent") > 100)


def ratio_histogram(spark, sf_dir):
    """Fixed buckets of width 10 from 0 to 100."""
    bucket = F.greatest(F.lit(0), F.least(F.lit(10), F.floor(F.col("value").cast("double") / 10))).cast("long")
    return read(spark, sf_dir, "events").where("value is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_FUNCTIONS = (pricing_summary, request_summary, daily_rollup, hourly_rollup, top_instances, type_breakdown, savings_deltas, session_totals, throughput_percentiles, rolling_spend, ratio_histogram)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity::DOUBLE), 2) AS sum_qty, round(avg(l_extendedprice::DOUBLE), 4) AS avg_price, count(*) AS n_rows FROM lineitem GROUP BY ALL",
    "request_summary": "SELECT count(*) AS n_requests, round(sum(coalesce(value, 0)::DOUBLE), 2) AS total_value, round(avg(coalesce(value, 0)::DOUBLE), 6) AS avg_value, count(*) FILTER (event_type = 'click') AS n_clicks, count(DISTINCT user_id) AS n_users FROM events",
    "daily_rollup": "WITH u AS (SELECT ts::DATE AS day, user_id, max(value::DOUBLE) AS top FROM events GROUP BY ALL) SELECT day, round(sum(top), 2) AS total, count(*) AS n_users FROM u GROUP BY day",
    "hourly_rollup": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY 1",
    "top_instances": "WITH u AS (SELECT ts::DATE AS day, user_id, max(value::DOUBLE) AS top FROM events GROUP BY ALL) SELECT user_id, round(sum(top), 2) AS total FROM u GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20",
    "type_breakdown": "SELECT coalesce(event_type, '?') AS event_type, count(*) AS n FROM events GROUP BY 1",
    "savings_deltas": "WITH s AS (SELECT date_trunc('week', ts) AS week, greatest(value::DOUBLE - coalesce(lag(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 0) AS step FROM events) SELECT week::TIMESTAMP AS week, round(sum(step), 2) AS saved, count(*) AS n FROM s GROUP BY 1",
    "session_totals": "WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL",
    "throughput_percentiles": "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 4) AS p95 FROM events GROUP BY 1",
    "rolling_spend": "SELECT event_id, round(coalesce(sum(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), 0), 2) AS spent, round(coalesce(sum(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), 0), 2) > 100 AS over_limit FROM events",
    "ratio_histogram": "SELECT greatest(0, least(10, floor(value::DOUBLE / 10)))::BIGINT AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
}
