"""Joins over time, versions and arms: recovery, stale reads, validity, stratified differences, overlaps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read

_AT = "2024-01-15 00:00:00"
_NOW = "2024-02-01 00:00:00"


def recoveries(spark, sf_dir):
    """For each purchase the latest error among the user's 5 events before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    error = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w)
    return read(spark, sf_dir, "events").select("event_id", "event_type", error.alias("error_id")).where("event_type = 'purchase' and error_id is not null").select("event_id", "error_id")


def stale_reads(spark, sf_dir):
    """Views that a later purchase of the same user makes stale: only the latest purchase of each user is joined."""
    events = read(spark, sf_dir, "events")
    latest = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("latest"))
    return events.where("event_type = 'view'").join(latest, "user_id").where("latest > ts").select("event_id")


def _versions(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"), F.lag("event_id").over(w).alias("supersedes"))


def version_history(spark, sf_dir):
    """Each row closes its predecessor of the same user and type."""
    return _versions(spark, sf_dir)


def valid_at(spark, sf_dir):
    """Rows valid at one point in time."""
    at = F.lit(_AT).cast("timestamp_ntz")
    return _versions(spark, sf_dir).where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))).select("event_id")


def unlabelled(spark, sf_dir):
    """Documents without a label."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def priced_brands(spark, sf_dir):
    """Quantity at list price by brand."""
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("qty"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("price"))
    return sold.join(part, sold.l_partkey == part.p_partkey).groupBy("p_brand").agg(F.round(F.sum(F.col("qty") * F.col("price")), 2).alias("cost"))


def arm_difference(spark, sf_dir):
    """Difference of two arms (odd and even users) over the types in both, with its variance."""
    x, odd = F.col("value").cast("double"), F.col("user_id") % 2 == 1
    t, c = F.when(odd, x), F.when(~odd, x)
    strata = read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(t).alias("nt"), F.count(c).alias("nc"), F.avg(t).alias("mt"), F.avg(c).alias("mc"), F.var_samp(t).alias("vt"), F.var_samp(c).alias("vc")
    )
    both = strata.where("nt > 1 and nc > 1")
    return both.agg(F.round(F.sum(F.expr("nt * (mc - mt)")), 4).alias("saved"), F.round(F.sum(F.expr("nt * nt * (vc / nc + vt / nt)")), 2).alias("variance"), F.count(F.lit(1)).alias("n_strata"))


def label_effect(spark, sf_dir):
    """Lengths of documents by label: means, standard error of their difference, effect size."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("n")).join(labels, "doc_id")
    a, b = F.when(F.col("quality") == 0, F.col("n")), F.when(F.col("quality") == 1, F.col("n"))
    stats = rows.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    return stats.select(
        F.round("ma", 4).alias("mean_0"), F.round("mb", 4).alias("mean_1"), F.round(F.expr("sqrt(va / na + vb / nb)"), 4).alias("error"), F.round(F.expr("(mb - ma) / sqrt((va + vb) / 2)"), 6).alias("effect")
    )


def turn_overlap(spark, sf_dir):
    """F1 of the word multisets of each turn and the turn before it."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")
    counts = read(spark, sf_dir, "conversations").select("conv_id", "turn", words).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("conv_id", "turn").agg(F.sum("c").alias("n"))
    before = counts.select("conv_id", (F.col("turn") + 1).alias("turn"), "word", F.col("c").alias("b"))
    shared = counts.join(before, ["conv_id", "turn", "word"]).groupBy("conv_id", "turn").agg(F.sum(F.least("c", "b")).alias("s"))
    earlier = sizes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("m"))
    return shared.join(sizes, ["conv_id", "turn"]).join(earlier, ["conv_id", "turn"]).select("conv_id", "turn", F.round(2 * F.col("s") / (F.col("n") + F.col("m")), 6).alias("f1"))


def recency_scores(spark, sf_dir):
    """Values decayed by their age in days over 30, from a fixed moment."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(_NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0)
    return read(spark, sf_dir, "events").select("event_id", F.round(F.col("value").cast("double") * F.exp(-age / 30), 4).alias("score"))


def best_confidence(spark, sf_dir):
    """The row of largest value for each user and type; the newest id among equals."""
    top = F.max(F.struct(F.col("value").cast("double").alias("v"), "event_id"))
    return read(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type").agg(top.alias("t")).select("user_id", "event_type", F.col("t.event_id").alias("event_id"))


_FUNCTIONS = (recoveries, stale_reads, version_history, valid_at, unlabelled, priced_brands, arm_difference, label_effect, turn_overlap, recency_scores, best_confidence)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_V = "(SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_until, lag(event_id) OVER w AS supersedes FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"
ORACLES = {
    "recoveries": "SELECT event_id, error_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS error_id FROM events) WHERE event_type = 'purchase' AND error_id IS NOT NULL",
    "stale_reads": "SELECT event_id FROM events v WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > v.ts)",
    "version_history": f"SELECT * FROM {_V}",
    "valid_at": f"SELECT event_id FROM {_V} WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{_AT}')",
    "unlabelled": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "priced_brands": "SELECT p_brand, round(sum(l_quantity::DOUBLE * p_retailprice::DOUBLE), 2) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "arm_difference": "WITH s AS (SELECT event_type, count(value) FILTER (user_id % 2 = 1) AS nt, count(value) FILTER (user_id % 2 <> 1) AS nc, avg(value::DOUBLE) FILTER (user_id % 2 = 1) AS mt, avg(value::DOUBLE) FILTER (user_id % 2 <> 1) AS mc, var_samp(value::DOUBLE) FILTER (user_id % 2 = 1) AS vt, var_samp(value::DOUBLE) FILTER (user_id % 2 <> 1) AS vc FROM events GROUP BY 1) SELECT round(sum(nt * (mc - mt)), 4) AS saved, round(sum(nt::DOUBLE * nt * (vc / nc + vt / nt)), 2) AS variance, count(*) AS n_strata FROM s WHERE nt > 1 AND nc > 1",
    "label_effect": "WITH s AS (SELECT avg(n) FILTER (quality = 0) AS ma, avg(n) FILTER (quality = 1) AS mb, var_samp(n) FILTER (quality = 0) AS va, var_samp(n) FILTER (quality = 1) AS vb, count(n) FILTER (quality = 0) AS na, count(n) FILTER (quality = 1) AS nb FROM (SELECT length(text)::DOUBLE AS n, quality FROM documents JOIN labels USING (doc_id))) SELECT round(ma, 4) AS mean_0, round(mb, 4) AS mean_1, round(sqrt(va / na + vb / nb), 4) AS error, round((mb - ma) / sqrt((va + vb) / 2), 6) AS effect FROM s",
    "turn_overlap": "WITH c AS (SELECT conv_id, turn, word, count(*) AS c FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM conversations) GROUP BY ALL), z AS (SELECT conv_id, turn, sum(c) AS n FROM c GROUP BY ALL), s AS (SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.word = b.word GROUP BY ALL) SELECT s.conv_id, s.turn, round(2 * s.s / (x.n + y.n)::DOUBLE, 6) AS f1 FROM s JOIN z x ON s.conv_id = x.conv_id AND s.turn = x.turn JOIN z y ON s.conv_id = y.conv_id AND s.turn = y.turn + 1",
    "recency_scores": f"SELECT event_id, round(value::DOUBLE * exp(-greatest(0, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 30), 4) AS score FROM events",
    "best_confidence": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value::DOUBLE DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1",
}
