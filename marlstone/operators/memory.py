"""Scoped rows and entity graph: latest versions, neighbours, decay."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read


def latest_versions(spark, sf_dir):
    """The current row of each key: the newest event of a user and type."""
    newest = F.max(F.struct("ts", "event_id"))
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(newest.alias("top")).select("user_id", "event_type", F.col("top.event_id").alias("event_id"))


def scope_counts(spark, sf_dir):
    """Entities by nation and region."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")  # fixed lists of 25 and 5 rows
    joined = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


_FUNCTIONS = (latest_versions, scope_counts)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "latest_versions": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "scope_counts": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}
