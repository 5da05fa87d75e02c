"""Arrays as grouped rows: change points, entropy, number summaries, kept rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read


def change_points(spark, sf_dir):
    """Places of a user's series (10 events or more) where the mean of the next 5 leaves that of the last 5 by over 2 deviations."""
    x = F.col("value").cast("double")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = read(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.avg(x).over(by_time.rowsBetween(-5, -1)).alias("before"), F.avg(x).over(by_time.rowsBetween(0, 4)).alias("after"),
        F.row_number().over(by_time).alias("k"), F.count(F.lit(1)).over(whole).alias("n"), F.stddev_samp(x).over(whole).alias("deviation"),
    )
    return marked.where("n >= 10 and k > 5 and k <= n - 4 and abs(after - before) > 2 * deviation").select("user_id", "event_id")


def type_entropy(spark, sf_dir):
    """Shannon entropy of each user's event types over log2 of the smaller of types and events; 0 for fewer than two."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("user_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    bits = F.log2("n") - F.col("s") / F.col("n")
    return per.select("user_id", F.when(F.col("d") < 2, 0.0).otherwise(F.round(bits / F.log2(F.least("d", "n")), 6)).alias("entropy"))


def number_summary(spark, sf_dir):
    """Median and quartiles of each order's prices."""
    x = F.col("l_extendedprice").cast("double")
    quart = lambda p, name: F.round(F.percentile(x, p), 4).alias(name)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(x).alias("low"), F.max(x).alias("high"), quart(0.25, "p25"), quart(0.5, "median"), quart(0.75, "p75"))


def constant_fields(spark, sf_dir):
    """Fields that hold one value in all lines of an order."""
    same = lambda c: (F.min(c) == F.max(c)).alias(f"{c}_constant")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(same("l_returnflag"), same("l_linestatus"), same("l_quantity"))


def first_last_rows(spark, sf_dir):
    """Of an order's lines the first 30 % and the last 15 %, one of each at least (halves go to even)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    share = lambda p: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(p), 0).cast("int"))
    return rows.where((F.col("k") <= share(0.3)) | (F.col("k") > F.col("n") - share(0.15))).select("l_orderkey", "l_linenumber")


def length_outliers(spark, sf_dir):
    """Documents whose length is over 2 deviations from the mean of all."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").cast("double").alias("n"))
    stats = docs.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("deviation"))  # one row
    return docs.join(F.broadcast(stats), F.abs(docs.n - stats.mean) > 2 * stats.deviation).select("doc_id")


def nested_field(spark, sf_dir):
    """Sum of a field inside JSON text, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).cast("long").alias("total"), F.count(k).alias("n"))


_FUNCTIONS = (change_points, type_entropy, number_summary, constant_fields, first_last_rows, length_outliers, nested_field)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "change_points": "WITH m AS (SELECT user_id, event_id, avg(value::DOUBLE) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value::DOUBLE) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, row_number() OVER o AS k, count(*) OVER (PARTITION BY user_id) AS n, stddev_samp(value::DOUBLE) OVER (PARTITION BY user_id) AS d FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id FROM m WHERE n >= 10 AND k > 5 AND k <= n - 4 AND abs(a - b) > 2 * d",
    "type_entropy": "WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, sum(c)::DOUBLE AS n, count(*) AS d, sum(c * log2(c)) AS s FROM c GROUP BY 1) SELECT user_id, CASE WHEN d < 2 THEN 0 ELSE round((log2(n) - s / n) / log2(least(d, n)), 6) END::DOUBLE AS entropy FROM p",
    "number_summary": "SELECT l_orderkey, min(l_extendedprice::DOUBLE) AS low, max(l_extendedprice::DOUBLE) AS high, round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.75), 4) AS p75 FROM lineitem GROUP BY 1",
    "constant_fields": "SELECT l_orderkey, min(l_returnflag) = max(l_returnflag) AS l_returnflag_constant, min(l_linestatus) = max(l_linestatus) AS l_linestatus_constant, min(l_quantity) = max(l_quantity) AS l_quantity_constant FROM lineitem GROUP BY 1",
    "first_last_rows": "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE k <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) OR k > n - greatest(1, round_even(n * 0.15::DOUBLE, 0))",
    "length_outliers": "WITH s AS (SELECT avg(length(text)::DOUBLE) AS m, stddev_samp(length(text)::DOUBLE) AS d FROM documents) SELECT doc_id FROM documents, s WHERE abs(length(text) - m) > 2 * d",
    "nested_field": "SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY 1",
}
