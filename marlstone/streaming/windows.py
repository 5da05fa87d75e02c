"""Window aggregations that run alike on a stream and on a table, and their queries on the events table.

On a stream, events that come later than the watermark are left out; a table has none. Savings never count below 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()


def late_after(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Number and sum of values in windows side by side."""
    g = late_after(events, delay).groupBy(F.window("ts", size), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, size: str, step: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Number of events in windows of `size` that begin every `step`."""
    g = late_after(events, delay).groupBy(F.window("ts", size, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Sessions that end after `gap` without an event."""
    g = late_after(events, delay).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return g.select(F.col("session_window.start").alias("start"), *by, "n", "last")


def first_of(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream, keys are forgotten once the watermark has passed them."""
    return late_after(events, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def st1_tumbling(spark, sf_dir):
    """Events by type in six hours."""
    return tumbling(read(spark, sf_dir, "events"), "6 hours", ["event_type"])


@query("SELECT start, count(*) AS n FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 90 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), INTERVAL 30 MINUTE)) AS start FROM events) GROUP BY 1")
def st2_sliding(spark, sf_dir):
    """Events of two hours, every half hour."""
    return sliding(read(spark, sf_dir, "events"), "2 hours", "30 minutes", [])


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, s")
def st3_sessions(spark, sf_dir):
    """Sessions of each user, which an hour without events ends."""
    return sessions(read(spark, sf_dir, "events"), "60 minutes", ["user_id"])


QUERIES, ORACLES = query.queries, query.oracles
