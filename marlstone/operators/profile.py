"""Array statistics: field profiles, outliers, change points."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read


def field_profile(spark, sf_dir):
    """Count, range, mean and unbiased deviation of a numeric field in each array (an order's lines)."""
    x = F.col("l_extendedprice").cast("double")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(x).alias("n"), F.countDistinct(x).alias("n_unique"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 3).alias("deviation")
    )


def outlier_rows(spark, sf_dir):
    """Rows more than two deviations from the mean of their type."""
    x = F.col("value").cast("double")
    stats = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"))
    return read(spark, sf_dir, "events").join(stats, "event_type").where(F.abs(x - F.col("mean")) > 2 * F.col("deviation")).select("event_id", "event_type")


def monotone_fields(spark, sf_dir):
    """Share of rising steps of each user's series."""
    x = F.col("value").cast("double")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select("user_id", (x > F.lag(x).over(w)).alias("up"))
    return steps.groupBy("user_id").agg(F.count("up").alias("n_steps"), F.count_if("up").alias("n_rising"))


def exact_duplicates(spark, sf_dir):
    """Documents grouped by a hash of the whole text; the first id stays."""
    docs = read(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("digest"), "doc_id")
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


_FUNCTIONS = (field_profile, outlier_rows, monotone_fields, exact_duplicates)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "field_profile": "SELECT l_orderkey, count(l_extendedprice) AS n, count(DISTINCT l_extendedprice) AS n_unique, min(l_extendedprice::DOUBLE) AS low, max(l_extendedprice::DOUBLE) AS high, round(avg(l_extendedprice::DOUBLE), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice::DOUBLE), 0), 3) AS deviation FROM lineitem GROUP BY 1",
    "outlier_rows": "WITH s AS (SELECT event_type, avg(value::DOUBLE) AS m, stddev_samp(value::DOUBLE) AS d FROM events GROUP BY 1) SELECT event_id, event_type FROM events JOIN s USING (event_type) WHERE abs(value::DOUBLE - m) > 2 * d",
    "monotone_fields": "WITH s AS (SELECT user_id, value::DOUBLE > lag(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up FROM events) SELECT user_id, count(up) AS n_steps, count(*) FILTER (up) AS n_rising FROM s GROUP BY 1",
    "exact_duplicates": "SELECT left(sha256(text), 16) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
}
