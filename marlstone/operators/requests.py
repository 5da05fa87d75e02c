"""Telemetry of requests: rollups, cost, throughput, budgets, learned statistics, experiments.

Statistics that merge (counts, sums, sums of squares, extremes) are aggregated in parts; quantiles are exact and found in
two passes, first a histogram, then only the rows of the buckets that hold a wanted rank.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

#: Dollars for a million tokens: input, cached input, output.
PRICES = {"gpt-large": (2.5, 1.25, 10.0), "sonnet-mid": (3.0, 0.3, 15.0), "gemini-pro": (1.25, 0.31, 5.0), "haiku-small": (0.8, 0.08, 4.0)}
FAMILIES = ("opus", "sonnet", "haiku", "gpt", "gemini")
# Input buckets by their upper bounds.
BUCKETS = (("xs", 2_000), ("s", 8_000), ("m", 32_000), ("l", 128_000))


# --- scalar functions ------------------------------------------------------------------------------------------------


def model_family(model: Column, families=FAMILIES) -> Column:
    out = F.lit("other")
    for f in reversed(families):
        out = F.when(F.lower(model).contains(f), f).otherwise(out)
    return out


def input_bucket(n: Column) -> Column:
    out = F.lit("xl")
    for name, bound in reversed(BUCKETS):
        out = F.when(n < bound, name).otherwise(out)
    return out


def stratum(model: Column, turn: Column, n: Column, tools: Column) -> Column:
    """family|turn|bucket|tools, from the most to the least specific part."""
    return F.concat_ws("|", model_family(model), turn, input_bucket(n), F.when(tools, "tools").otherwise("notools"))


def arm(key: Column, holdout: float) -> Column:
    """treatment or control, by a hash of the key: stable and uniform."""
    if holdout <= 0 or holdout >= 1:
        return F.lit("treatment" if holdout <= 0 else "control")
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("arm:"), key), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(u < holdout, "control").otherwise("treatment")


def price(model: Column, part: int) -> Column:
    out = F.lit(None).cast("double")
    for name, p in PRICES.items():
        out = F.when(model == name, p[part]).otherwise(out)
    return out


def cost(model: Column, fresh: Column, cached: Column, out: Column) -> Column:
    """Dollars of a request; null if its model has no price."""
    return (fresh * price(model, 0) + cached * price(model, 1) + out * price(model, 2)) / 1e6


def wilson_free_ci(saved: Column, base: Column, var: Column) -> tuple[Column, Column, Column]:
    """(share in %, low, high) of a saving with its normal 95 % interval; 0 without a baseline."""
    pct = lambda x: F.when(base > 0, x / base * 100).otherwise(0.0)
    return pct(saved), pct(saved - 1.96 * F.sqrt(var)), pct(saved + 1.96 * F.sqrt(var))


# --- operators -------------------------------------------------------------------------------------------------------


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, sum and sum of squares: add up over any parts."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def variance(n: Column, s: Column, q: Column) -> Column:
    return F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))


def quantiles(rows: DataFrame, by: str, value: str, shares: list[float], buckets: int = 1024) -> DataFrame:
    """(by, share, quantile), exact and linearly interpolated.

    Each value falls into one of `buckets` equal ranges; only rows of ranges that hold a wanted rank are sorted.
    """
    x = F.col(value).cast("double")
    rows = rows.where(x.isNotNull()).select(F.col(by).alias("by"), x.alias("x"))
    bounds = rows.groupBy("by").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    width = F.greatest((F.col("high") - F.col("low")) / buckets, F.lit(1e-300))
    cell = F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(buckets - 1)).cast("int")
    # One row for each value of `by`; it is joined by Spark's own choice of strategy.
    placed = rows.join(bounds, "by").withColumn("cell", cell)
    counts = placed.groupBy("by", "cell").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    w = Window.partitionBy("by").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for s in shares]))
    wanted = upto.select("by", "cell", "before", "upto", at.alias("w")).select("by", "cell", "before", "upto", "w.share", "w.at")
    wanted = wanted.where((F.floor("at") < F.col("upto")) & (F.ceil("at") >= F.col("before")))
    some = placed.select("by", "cell", "x").join(wanted.select("by", "cell", "before").distinct(), ["by", "cell"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("by", "cell").orderBy("x")) - 1
    ranked = some.select("by", "cell", "x", rank.alias("rank"))
    hits = wanted.join(ranked, ["by", "cell"]).where((F.col("rank") == F.floor("at")) | (F.col("rank") == F.ceil("at")))
    weight = F.when(F.col("rank") == F.floor("at"), 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    return hits.groupBy(F.col("by").alias(by), "share").agg(F.sum(F.col("x") * weight).alias("quantile"))


def deltas(rows: DataFrame, by: list[str], order: list[str], total: str) -> DataFrame:
    """Adds `delta`: the growth of a cumulative counter since the row before, never negative."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("delta", F.greatest(F.col(total) - F.lag(total, 1, 0).over(w), F.lit(0)))


def trailing_sums(rows: DataFrame, by: str, at: str, values: list[str], seconds: list[int]) -> DataFrame:
    """(by, at, <value>_<seconds>): for each instant (microseconds) of a group, the sums of the rows of the seconds before it.

    Rows of the same instant do not count. A sum is that of all rows before the instant less that of all rows before its
    window; these are added up by minute, and within a minute by instant, so that a row costs the same in any window.
    Sums of whole numbers are exact. Rows without an instant see each other, as in the frames of SQL.
    """
    unknown = rows.where(F.col(at).isNull()).groupBy(F.col(by), F.col(at)).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}_{s}") for v in values for s in seconds])
    ticks = rows.where(F.col(at).isNotNull()).groupBy(F.col(by).alias("by"), F.col(at).alias("at")).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    mark = lambda s: F.struct(F.lit(s).alias("back"), (F.col("at") - s * 1_000_000).alias("t"), *[(F.col(v) if s == 0 else F.col(v) * 0).alias(v) for v in values])
    marks = ticks.select("by", "at", F.explode(F.array(*[mark(s) for s in (0, *seconds)])).alias("m")).select("by", "at", "m.*").withColumn("minute", F.floor(F.col("t") / 60_000_000))
    upto = Window.partitionBy("by").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    starts = marks.groupBy("by", "minute").agg(*[F.sum(v).alias(v) for v in values]).select(F.col("by").alias("_by"), F.col("minute").alias("_minute"), *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_{v}") for v in values])
    within = Window.partitionBy("by", "minute").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    before = marks.select("by", "at", "back", "minute", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(v) for v in values])
    before = before.join(starts, F.col("by").eqNullSafe(F.col("_by")) & (F.col("minute") == F.col("_minute")))
    whole = lambda v, s: F.sum(F.when(F.col("back") == s, F.col(v) + F.col(f"_{v}")))
    known = before.groupBy(F.col("by").alias(by), F.col("at").alias(at)).agg(*[(whole(v, 0) - whole(v, s)).alias(f"{v}_{s}") for v in values for s in seconds])
    return known.unionByName(unknown)


def spend_guard(rows: DataFrame, by: str, limits: dict[str, float]) -> DataFrame:
    """Adds the trailing sums before each request over a minute, an hour and a day, and the first limit that it breaks."""
    rows = rows.withColumns({"_at": F.unix_micros(F.col("ts").cast("timestamp")), "_one": F.lit(1)})
    sums = trailing_sums(rows, by, "_at", ["_one", "tokens", "cost"], [60, 3600, 86400]).select(
        F.col(by).alias("_by"), F.col("_at").alias("_tick"), F.col("_one_60").alias("minute_requests"), F.col("tokens_60").alias("minute_tokens"),
        F.col("cost_60").alias("minute_cost"), F.col("cost_3600").alias("hour_cost"), F.col("cost_86400").alias("day_cost"),
    )
    names = [c for c in sums.columns if not c.startswith("_")]
    rows = rows.join(sums, F.col(by).eqNullSafe(F.col("_by")) & F.col("_at").eqNullSafe(F.col("_tick")), "left").drop("_by", "_tick", "_one")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    c, t = F.col("cost"), F.col("tokens")
    tests = [
        ("tokens_per_request", t > limits["tokens_per_request"]), ("cost_per_request", c > limits["cost_per_request"]),
        ("requests_per_minute", F.col("minute_requests") >= limits["requests_per_minute"]), ("tokens_per_minute", F.col("minute_tokens") + t > limits["tokens_per_minute"]),
        ("cost_per_minute", F.col("minute_cost") + c > limits["cost_per_minute"]), ("cost_per_hour", F.col("hour_cost") + c > limits["cost_per_hour"]),
        ("cost_per_day", F.col("day_cost") + c > limits["cost_per_day"]),
    ]
    reason = F.lit("")
    for name, broken in reversed(tests):
        reason = F.when(broken, name).otherwise(reason)
    return rows.withColumn("reason", reason).drop("_at")


# --- the requests of the test tables ---------------------------------------------------------------------------------

_MODELS = {"view": "gpt-large", "click": "sonnet-mid", "error": "gemini-pro", "signup": "haiku-small", "purchase": "other-llm"}


def requests(spark, sf_dir) -> DataFrame:
    """Events as requests."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    model = F.lit(None).cast("string")
    for kind, name in _MODELS.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(i.alias("id"), "ts", F.col("user_id").alias("instance"), model.alias("model"), (k * 400 + 100).alias("tokens_before"), F.floor(F.col("value") * 10).cast("long").alias("tokens_out"), ((i % 50) * 20).alias("total_ms"), F.when(i % 3 == 0, "audit").otherwise("optimize").alias("mode"), ((i % 7) * 50).alias("cached"))
    return rows.withColumn("tokens_after", F.col("tokens_before") - F.floor(F.col("tokens_before") * (F.col("id") % 5) / 10).cast("long"))


_R = "r AS (SELECT *, tokens_before - CAST(floor(tokens_before * (id % 5) / 10) AS BIGINT) AS tokens_after FROM (SELECT event_id AS id, ts, user_id AS instance, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MODELS.items()) + " END AS model, try_cast(json_extract_string(props, '$.k') AS BIGINT) * 400 + 100 AS tokens_before, CAST(floor(value * 10) AS BIGINT) AS tokens_out, (event_id % 50) * 20 AS total_ms, CASE WHEN event_id % 3 = 0 THEN 'audit' ELSE 'optimize' END AS mode, (event_id % 7) * 50 AS cached FROM events))"
_CUM = f"c AS (SELECT *, sum(tokens_before - tokens_after) OVER (PARTITION BY instance ORDER BY ts, id)::BIGINT AS total FROM r)"


def _cumulative(spark, sf_dir):
    return requests(spark, sf_dir).withColumn("total", F.sum(F.col("tokens_before") - F.col("tokens_after")).over(Window.partitionBy("instance").orderBy("ts", "id")))


def _price_sql(part):
    return "CASE model " + " ".join(f"WHEN '{m}' THEN {p[part]}" for m, p in PRICES.items()) + " END"


_COST = f"((tokens_before - cached) * {_price_sql(0)} + cached * {_price_sql(1)} + tokens_out * {_price_sql(2)}) / 1e6"


@query(f"WITH {_R}, {_CUM} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, sum(m)::BIGINT AS saved, count(*) AS instances FROM (SELECT date_trunc('hour', ts) AS ts, instance, max(total) AS m FROM c WHERE ts >= (SELECT max(ts) FROM c) - INTERVAL 48 HOUR GROUP BY ALL) GROUP BY 1")
def g3_hourly_rollup(spark, sf_dir):
    """The last 48 hours: for each hour the greatest counter of each instance, summed."""
    rows = _cumulative(spark, sf_dir)
    last = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    bound = F.lit(last).cast("timestamp_ntz") - F.expr("interval 48 hours")
    per = rows.where(F.col("ts") >= bound).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "instance").agg(F.max("total").alias("m"))
    return per.groupBy("hour").agg(F.sum("m").alias("saved"), F.count(F.lit(1)).alias("instances"))


@query(f"WITH {_R}, {_CUM}, d AS (SELECT CAST(ts AS DATE) AS day, instance, max(total) AS m FROM c GROUP BY ALL) SELECT sum(m)::BIGINT AS saved, count(DISTINCT day) AS days, count(DISTINCT instance) AS instances, round(avg(m), 4) AS mean FROM d")
def g4_grand_totals(spark, sf_dir):
    """Totals of the daily rollup."""
    d = _cumulative(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "instance").agg(F.max("total").alias("m"))
    return d.agg(F.sum("m").alias("saved"), F.countDistinct("day").alias("days"), F.countDistinct("instance").alias("instances"), F.round(F.avg("m"), 4).alias("mean"))


@query(f"WITH {_R}, {_CUM}, i AS (SELECT *, 'instance-' || instance || '-host' AS name, CASE instance % 3 WHEN 0 THEN 'Linux 6.1' WHEN 1 THEN 'Darwin 23' ELSE NULL END AS os FROM c), d AS (SELECT CAST(ts AS DATE) AS day, name, os, max(total) AS m FROM i GROUP BY ALL), s AS (SELECT left(name, 11) AS id, coalesce(split_part(os, ' ', 1), '?') AS os, name, sum(m)::BIGINT AS saved FROM d GROUP BY ALL) SELECT id, os, saved FROM s ORDER BY saved DESC, name LIMIT 20")
def g5_top_instances(spark, sf_dir):
    """The 20 instances that saved most, with short ids and the first word of their system."""
    n = F.col("instance")
    rows = _cumulative(spark, sf_dir).select("ts", "total", F.format_string("instance-%d-host", n).alias("name"), F.when(n % 3 == 0, "Linux 6.1").when(n % 3 == 1, "Darwin 23").alias("os"))
    d = rows.groupBy(F.to_date("ts").alias("day"), "name", "os").agg(F.max("total").alias("m"))
    best = d.groupBy("name", "os").agg(F.sum("m").alias("saved")).orderBy(F.desc("saved"), "name").limit(20)
    return best.select(F.substring("name", 1, 11).alias("id"), F.coalesce(F.split_part("os", F.lit(" "), F.lit(1)), F.lit("?")).alias("os"), "saved")


@query(f"WITH {_R}, d AS (SELECT model, mode, count(*) AS n, sum(tokens_before - tokens_after)::BIGINT AS saved FROM r GROUP BY ALL) SELECT model, '[' || string_agg('{{\"mode\":\"' || mode || '\",\"n\":' || n || ',\"saved\":' || saved || '}}', ',' ORDER BY mode) || ']' AS modes FROM d GROUP BY 1")
def g7_json_rollup(spark, sf_dir):
    """Counts by mode as one JSON array for each model."""
    d = requests(spark, sf_dir).groupBy("model", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))
    return d.groupBy("model").agg(F.to_json(F.array_sort(F.collect_list(F.struct("mode", "n", "saved")))).alias("modes"))


@query(f"WITH {_R}, {_CUM}, d AS (SELECT *, greatest(total - coalesce(lag(total) OVER (PARTITION BY instance ORDER BY ts, id), 0), 0) AS delta FROM c), b AS (SELECT u.bucket, date_trunc(u.bucket, ts)::TIMESTAMP AS start, model, delta, total, ts, id FROM d, (SELECT unnest(['hour', 'day', 'week', 'month']) AS bucket) u) SELECT bucket, start, sum(delta)::BIGINT AS saved, arg_max(total, (ts, id)) AS last, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM b GROUP BY ALL")
def g8_savings_rollup(spark, sf_dir):
    """Savings by hour, day, week (from Monday) and month: growth, the last counter, and the models."""
    d = deltas(_cumulative(spark, sf_dir), ["instance"], ["ts", "id"], "total")
    parts = [d.select(F.lit(b).alias("bucket"), F.date_trunc(b, "ts").cast("timestamp_ntz").alias("start"), "model", "delta", "total", "ts", "id") for b in ("hour", "day", "week", "month")]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("bucket", "start").agg(F.sum("delta").alias("saved"), F.max_by("total", F.struct("ts", "id")).alias("last"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query(f"WITH {_R}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY instance ORDER BY ts, id)), s AS (SELECT *, sum(new) OVER (PARTITION BY instance ORDER BY ts, id) AS session FROM g) SELECT instance, id, session::BIGINT AS session, sum(tokens_before - tokens_after) OVER (PARTITION BY instance, session ORDER BY ts, id)::BIGINT AS saved, count(*) OVER (PARTITION BY instance, session ORDER BY ts, id) AS requests FROM s")
def g9_session_running_totals(spark, sf_dir):
    """Running totals of each instance, from 0 after an hour without requests."""
    w = Window.partitionBy("instance").orderBy("ts", "id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 60 minutes"), F.lit(False)).cast("int")
    rows = requests(spark, sf_dir).withColumn("new", new).withColumn("session", F.sum("new").over(w))
    run = Window.partitionBy("instance", "session").orderBy("ts", "id")
    return rows.select("instance", "id", "session", F.sum(F.col("tokens_before") - F.col("tokens_after")).over(run).alias("saved"), F.count(F.lit(1)).over(run).alias("requests"))


@query(f"WITH {_R}, p AS (SELECT instance AS project, sum(tokens_before - tokens_after)::BIGINT AS saved, max(ts) AS active FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY project = 7 DESC, saved DESC, active DESC, project) AS place FROM p) SELECT project, saved FROM k WHERE place <= 50")
def g10_project_totals(spark, sf_dir):
    """Totals of 50 projects at most: the current one, then those that saved most, then the latest."""
    p = requests(spark, sf_dir).groupBy(F.col("instance").alias("project")).agg(F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"), F.max("ts").alias("active"))
    return p.orderBy(F.desc(F.col("project") == 7), F.desc("saved"), F.desc("active"), "project").limit(50).select("project", "saved")


@query(f"WITH {_R}, s AS (SELECT model, count(*) AS n, sum(tokens_before)::BIGINT AS before, sum(tokens_before - tokens_after)::BIGINT AS saved FROM r GROUP BY ROLLUP (model)) SELECT coalesce(model, 'all') AS model, n, before, saved, CASE WHEN before > 0 THEN round(saved * 100.0::DOUBLE / before, 1) ELSE 0 END AS pct, row_number() OVER (ORDER BY model IS NULL DESC, saved DESC, model) AS place FROM s")
def g11_perf_summary(spark, sf_dir):
    """Totals of all requests and by model, by falling savings."""
    s = requests(spark, sf_dir).rollup("model").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_before").alias("before"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))
    pct = F.when(F.col("before") > 0, F.round(F.col("saved") * 100.0 / F.col("before"), 1)).otherwise(0.0)
    return s.select(F.coalesce("model", F.lit("all")).alias("model"), "n", "before", "saved", pct.alias("pct"), F.row_number().over(Window.orderBy(F.desc(F.col("model").isNull()), F.desc("saved"), "model")).cast("long").alias("place"))


@query(f"WITH {_R}, x AS (SELECT 'rolling' AS span, model, tokens_before / (total_ms / 1000.0::DOUBLE) AS rate FROM r WHERE total_ms > 0 UNION ALL SELECT 'current', model, tokens_before / (total_ms / 1000.0::DOUBLE) FROM r WHERE total_ms > 0 AND ts >= (SELECT max(ts) FROM r) - INTERVAL 5 HOUR) SELECT key, share, round(q, 4) AS quantile FROM (SELECT span || '|' || model AS key, unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS share, unnest(quantile_cont(rate, [0.5, 0.95])) AS q FROM x GROUP BY 1)")
def g12_throughput(spark, sf_dir):
    """Median and 95th percentile of tokens a second by model, of all requests and of the last five hours."""
    rows = requests(spark, sf_dir).where("total_ms > 0").select("ts", "model", (F.col("tokens_before") / (F.col("total_ms") / 1000.0)).alias("rate"))
    last = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    now = rows.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 5 hours"))
    both = rows.select(F.concat_ws("|", F.lit("rolling"), "model").alias("key"), "rate").unionByName(now.select(F.concat_ws("|", F.lit("current"), "model").alias("key"), "rate"))
    return quantiles(both, "key", "rate", [0.5, 0.95]).select("key", "share", F.round("quantile", 4).alias("quantile"))


@query(f"WITH {_R}, w AS (SELECT 'html' AS signal, sum(tokens_before // 10)::BIGINT AS tokens FROM r UNION ALL SELECT 'base64', sum(CASE WHEN id % 4 = 0 THEN tokens_before // 5 ELSE 0 END)::BIGINT FROM r UNION ALL SELECT 'reread', sum(CASE WHEN id % 9 = 0 THEN tokens_before ELSE 0 END)::BIGINT FROM r), a AS (SELECT * FROM w UNION ALL SELECT 'history_bloat', greatest(0, (SELECT sum(tokens_before - tokens_after) FROM r) - (SELECT sum(tokens) FROM w WHERE signal <> 'reread'))::BIGINT) SELECT signal, tokens, round(tokens * 100.0::DOUBLE / max(tokens) OVER (), 1) AS pct_of_max FROM a")
def g13_w13_waste_histogram(spark, sf_dir):
    """Tokens wasted by signal, what no signal explains as history, each as a share of the largest."""
    t, i = F.col("tokens_before"), F.col("id")
    s = requests(spark, sf_dir).agg(
        F.sum(F.floor(t / 10)).alias("html"), F.sum(F.when(i % 4 == 0, F.floor(t / 5)).otherwise(0)).alias("base64"), F.sum(F.when(i % 9 == 0, t).otherwise(0)).alias("reread"),
        F.sum(t - F.col("tokens_after")).alias("saved"),
    )
    s = s.withColumn("history_bloat", F.greatest(F.lit(0), F.col("saved") - F.col("html") - F.col("base64")))
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("long").alias("tokens")) for c in ("html", "base64", "reread", "history_bloat")])).alias("w")).select("w.*")
    return rows.select("signal", "tokens", F.round(F.col("tokens") * 100.0 / F.max("tokens").over(Window.partitionBy()), 1).alias("pct_of_max"))


@query(f"WITH {_R} SELECT id, model, tokens_before - tokens_after AS saved FROM r ORDER BY saved DESC, id LIMIT 10")
def g14_top_requests(spark, sf_dir):
    """The ten requests that saved most."""
    return requests(spark, sf_dir).select("id", "model", (F.col("tokens_before") - F.col("tokens_after")).alias("saved")).orderBy(F.desc("saved"), "id").limit(10)


def _waste_sql(pattern):
    return f"greatest(0, floor(length(array_to_string(regexp_extract_all(t, '{pattern}'), '')) / 4.0::DOUBLE + 0.5))::BIGINT"


@query(f"WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, t || ' ' || repeat('QUJDREVG', CAST(page_id % 30 AS INT)) || repeat(' ', CAST(page_id % 13 AS INT)) || chr(10) || chr(10) || chr(10) AS t FROM p) SELECT page_id, {_waste_sql('<[^>]+>')} AS html, {_waste_sql('[A-Za-z0-9+/]{50,}={0,2}')} AS base64, {_waste_sql('[ \\t]{4,}|\\n{3,}')} AS blank FROM d")
def g16_waste_tokens(spark, sf_dir):
    """Estimated tokens of tags, base64 and white space in each page."""
    n = (F.col("page_id") % 30).cast("int")
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(" "), F.expr("repeat('QUJDREVG', cast(page_id % 30 as int))"), F.expr("repeat(' ', cast(page_id % 13 as int))"), F.lit("\n\n\n"))
    waste = lambda p: F.floor(F.length(F.array_join(F.regexp_extract_all("t", F.lit(p), F.lit(0)), "")) / 4.0 + 0.5).cast("long")
    rows = read(spark, sf_dir, "pages").select("page_id", text.alias("t"), n.alias("n"))
    return rows.select("page_id", waste("<[^>]+>").alias("html"), waste("[A-Za-z0-9+/]{50,}={0,2}").alias("base64"), waste("[ \\t]{4,}|\\n{3,}").alias("blank"))


@query(f"WITH {_R}, m AS (SELECT model, count(*) AS requests, sum(tokens_before - tokens_after)::BIGINT AS saved, sum(tokens_after)::BIGINT AS sent, sum(cached)::BIGINT AS cache_read, sum(greatest(tokens_after - cached, 0))::BIGINT AS uncached, round(sum({_COST}), 6) AS cost FROM r GROUP BY 1) SELECT *, coalesce(cost > 3, false) AS over_budget FROM m")
def g17_cost_tracking(spark, sf_dir):
    """Tokens and dollars by model, and which are over a budget."""
    r = requests(spark, sf_dir)
    c = cost(F.col("model"), F.col("tokens_before") - F.col("cached"), F.col("cached"), F.col("tokens_out"))
    m = r.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"), F.sum("tokens_after").alias("sent"), F.sum("cached").alias("cache_read"),
        F.sum(F.greatest(F.col("tokens_after") - F.col("cached"), F.lit(0))).alias("uncached"), F.round(F.sum(c), 6).alias("cost"),
    )
    return m.withColumn("over_budget", F.coalesce(F.col("cost") > 3, F.lit(False)))


@query(f"WITH {_R}, m AS (SELECT model, sum(cached)::BIGINT AS hit, sum(tokens_before)::BIGINT AS seen, round(sum(cached * ({_price_sql(0)} - {_price_sql(1)})) / 1e6, 6) AS saved, avg((cached > 0)::INT) AS rate FROM r GROUP BY 1) SELECT model, hit, seen, round(hit / seen, 6) AS token_rate, round(rate, 6) AS request_rate, saved FROM m")
def g18_cache_stats(spark, sf_dir):
    """Hit rates of the prompt cache and the dollars that it saves, by model."""
    m = requests(spark, sf_dir).groupBy("model").agg(
        F.sum("cached").alias("hit"), F.sum("tokens_before").alias("seen"), F.round(F.sum(F.col("cached") * (price(F.col("model"), 0) - price(F.col("model"), 1))) / 1e6, 6).alias("saved"),
        F.round(F.avg((F.col("cached") > 0).cast("double")), 6).alias("request_rate"),
    )
    return m.select("model", "hit", "seen", F.round(F.col("hit") / F.col("seen"), 6).alias("token_rate"), "request_rate", "saved")


@query(f"WITH {_R} SELECT id, round({_COST}, 9) AS dollars, {_price_sql(0)} IS NULL AS unpriced FROM r")
def g19_request_cost(spark, sf_dir):
    """Dollars of each request; requests of unknown models have none."""
    c = cost(F.col("model"), F.col("tokens_before") - F.col("cached"), F.col("cached"), F.col("tokens_out"))
    return requests(spark, sf_dir).select("id", F.round(c, 9).alias("dollars"), c.isNull().alias("unpriced"))


def field_distribution(rows: DataFrame, by: str, field: str, order: str) -> DataFrame:
    """Mean length, unique ratio and id-likeness of texts; population variance bucket, outliers and score-likeness of numbers."""
    x = F.col(field).cast("double")
    w = Window.partitionBy(by)
    seq = w.orderBy(order)
    rows = rows.where(x.isNotNull()).select(by, x.alias("x"), F.avg(x).over(w).alias("m"), F.stddev_pop(x).over(w).alias("d"), (x - F.lag(x).over(seq)).alias("step"))
    s = rows.groupBy(by).agg(F.var_pop("x").alias("v"), F.max((F.abs(F.col("x") - F.col("m")) > 2 * F.col("d")).cast("int")).alias("o"), F.min("step").alias("down"), F.max("step").alias("up"), F.max((F.col("x") != F.floor("x")).cast("int")).alias("f"))
    bucket = F.when(F.col("v") == 0, "zero").when(F.col("v") < 10, "low").when(F.col("v") < 1000, "medium").otherwise("high")
    monotone = (F.coalesce("down", F.lit(0.0)) >= 0) | (F.coalesce("up", F.lit(0.0)) <= 0)
    return s.select(by, bucket.alias("variance_bucket"), (F.col("o") == 1).alias("has_outliers"), (monotone & bucket.isin("medium", "high")).alias("likely_score"), (F.col("f") == 0).alias("is_integer"))


@query(f"WITH {_R}, d AS (SELECT instance, tokens_out::DOUBLE AS x, avg(tokens_out) OVER w AS m, stddev_pop(tokens_out) OVER w AS d, tokens_out - lag(tokens_out) OVER (PARTITION BY instance ORDER BY id) AS step FROM r WINDOW w AS (PARTITION BY instance)), s AS (SELECT instance, var_pop(x) AS v, max((abs(x - m) > 2 * d)::INT) AS o, min(step) AS down, max(step) AS up FROM d GROUP BY 1), b AS (SELECT *, CASE WHEN v = 0 THEN 'zero' WHEN v < 10 THEN 'low' WHEN v < 1000 THEN 'medium' ELSE 'high' END AS b FROM s) SELECT instance, b AS variance_bucket, o = 1 AS has_outliers, (coalesce(down, 0) >= 0 OR coalesce(up, 0) <= 0) AND b IN ('medium', 'high') AS likely_score, true AS is_integer FROM b")
def g21_number_distribution(spark, sf_dir):
    """How the output sizes of each instance are distributed."""
    return field_distribution(requests(spark, sf_dir), "instance", "tokens_out", "id")


@query("SELECT lang, round(avg(length(text)), 4) AS avg_length, round(count(DISTINCT text) / count(*), 6) AS unique_ratio, count(DISTINCT text) / count(*) > 0.9 AND avg(length(text)) > 5 AS looks_like_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def g21_text_distribution(spark, sf_dir):
    """How the texts of each language are distributed."""
    ratio = F.countDistinct("text") / F.count(F.lit(1))
    return read(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg(F.round(F.avg(F.length("text")), 4).alias("avg_length"), F.round(ratio, 6).alias("unique_ratio"), ((ratio > 0.9) & (F.avg(F.length("text")) > 5)).alias("looks_like_id"))


def signature(fields: dict[str, str]) -> str:
    """SHA-256, 24 digits, of sorted name:type pairs."""
    import hashlib

    return hashlib.sha256(",".join(f"{k}:{v}" for k, v in sorted(fields.items())).encode()).hexdigest()[:24]


@query("SELECT left(sha256('count:int,name:string,size:int'), 24) AS signature, count(*) AS items, 3 AS n_fields FROM part WHERE p_size % 2 = 0 UNION ALL SELECT left(sha256('name:string,size:string'), 24), count(*), 2 FROM part WHERE p_size % 2 = 1")
def g22_tool_signatures(spark, sf_dir):
    """Items by the signature of their fields and types."""
    even = F.array(F.struct(F.lit("size").alias("f"), F.lit("int").alias("t")), F.struct(F.lit("name").alias("f"), F.lit("string").alias("t")), F.struct(F.lit("count").alias("f"), F.lit("int").alias("t")))
    odd = F.array(F.struct(F.lit("size").alias("f"), F.lit("string").alias("t")), F.struct(F.lit("name").alias("f"), F.lit("string").alias("t")))
    rows = read(spark, sf_dir, "part").select(F.array_sort(F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)).alias("fields"))
    text = F.array_join(F.transform("fields", lambda s: F.concat_ws(":", s["f"], s["t"])), ",")
    return rows.groupBy(F.substring(F.sha2(text, 256), 1, 24).alias("signature"), F.size("fields").alias("n_fields")).agg(F.count(F.lit(1)).alias("items"))


_TOIN = f"{_R}, p AS (SELECT instance % 40 AS pattern, count(*) AS n, count(DISTINCT instance) AS users, sum((id % 4 = 0)::INT) / count(*) AS rate, sum((id % 8 = 0)::INT) / greatest(sum((id % 4 = 0)::INT), 1) AS full_rate, sum(tokens_before)::BIGINT AS items FROM r WHERE instance % 40 < 20 OR id % 2 = 0 GROUP BY 1)"


def _patterns(spark, sf_dir):
    i = F.col("id")
    rows = requests(spark, sf_dir).where((F.col("instance") % 40 < 20) | (i % 2 == 0))
    hit = F.sum((i % 4 == 0).cast("int"))
    return rows.groupBy((F.col("instance") % 40).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instance").alias("users"), (hit / F.count(F.lit(1))).alias("rate"), (F.sum((i % 8 == 0).cast("int")) / F.greatest(hit, F.lit(1))).alias("full_rate"), F.sum("tokens_before").alias("items"))


def confidence(n: Column, users: Column, least_users: int = 3) -> Column:
    """min(.95, min(.7, n / 100) + .03 a user, .3 at most, from least_users on)."""
    return F.least(F.lit(0.95), F.least(F.lit(0.7), n / 100) + F.when(users >= least_users, F.least(F.lit(0.3), users * 0.03)).otherwise(0.0))


def recommended_items(rate: Column, full_rate: Column, items: Column, n: Column) -> Column:
    return F.when(rate > 0.5, F.when(full_rate > 0.8, F.floor(items / F.greatest(n, F.lit(1)))).otherwise(50)).when(rate > 0.2, 30).otherwise(20)


@query(f"WITH {_TOIN} SELECT pattern, n, users, round(least(0.95::DOUBLE, least(0.7::DOUBLE, n / 100) + CASE WHEN users >= 3 THEN least(0.3::DOUBLE, users * 0.03::DOUBLE) ELSE 0 END), 6) AS confidence FROM p")
def g23_pattern_confidence(spark, sf_dir):
    """How surely a learned pattern is known, by its samples and users."""
    return _patterns(spark, sf_dir).select("pattern", "n", "users", F.round(confidence(F.col("n"), F.col("users")), 6).alias("confidence"))


@query(f"WITH {_TOIN} SELECT pattern, round(rate, 6) AS rate, CASE WHEN rate > 0.5 THEN CASE WHEN full_rate > 0.8 THEN items // greatest(n, 1) ELSE 50 END WHEN rate > 0.2 THEN 30 ELSE 20 END::BIGINT AS max_items, rate > 0.5 AND full_rate > 0.8 AS skip FROM p")
def g24_recommendations(spark, sf_dir):
    """How many items to keep for a pattern, by how often they are retrieved."""
    rate, full = F.col("rate"), F.col("full_rate")
    return _patterns(spark, sf_dir).select("pattern", F.round(rate, 6).alias("rate"), recommended_items(rate, full, F.col("items"), F.col("n")).cast("long").alias("max_items"), ((rate > 0.5) & (full > 0.8)).alias("skip"))


@query(f"WITH {_R} SELECT model, count(tokens_out) AS n, round(avg(tokens_out), 4) AS mean, round(var_samp(tokens_out), 2) AS variance FROM r GROUP BY 1")
def g25_g27_merged_moments(spark, sf_dir):
    """Mean and variance by model, merged from parts of each day."""
    parts = moments(requests(spark, sf_dir).withColumn("day", F.to_date("ts")), ["model", "day"], "tokens_out")
    m = merge_moments(parts, ["model"])
    return m.select("model", "n", F.round(F.col("s") / F.col("n"), 4).alias("mean"), F.round(variance(F.col("n"), F.col("s"), F.col("q")), 2).alias("variance"))


_STRATUM = "CASE WHEN contains(model, 'sonnet') THEN 'sonnet' WHEN contains(model, 'haiku') THEN 'haiku' WHEN contains(model, 'gpt') THEN 'gpt' WHEN contains(model, 'gemini') THEN 'gemini' ELSE 'other' END || '|' || mode || '|' || CASE WHEN tokens_before < 2000 THEN 'xs' WHEN tokens_before < 8000 THEN 's' WHEN tokens_before < 32000 THEN 'm' WHEN tokens_before < 128000 THEN 'l' ELSE 'xl' END || '|' || CASE WHEN id % 2 = 0 THEN 'tools' ELSE 'notools' END"
_ARM = "CASE WHEN ('0x' || left(sha256('arm:' || instance), 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'control' ELSE 'treatment' END"


def _stratified(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.withColumn("key", stratum(F.col("model"), F.col("mode"), F.col("tokens_before"), F.col("id") % 2 == 0)).withColumn("arm", arm(F.col("instance").cast("string"), 0.3))


@query(f"WITH {_R} SELECT {_STRATUM} AS key, count(*) AS n, sum(tokens_out)::BIGINT AS tokens FROM r GROUP BY 1")
def x11_x12_x13_strata(spark, sf_dir):
    """Requests by stratum: family, turn, input bucket, tools."""
    return _stratified(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_out").alias("tokens"))


@query(f"WITH {_R} SELECT instance, {_ARM} AS arm FROM (SELECT DISTINCT instance FROM r)")
def l6_arms(spark, sf_dir):
    """The arm of each instance in an experiment with 30 % held out."""
    return requests(spark, sf_dir).select("instance").distinct().select("instance", arm(F.col("instance").cast("string"), 0.3).alias("arm"))


def back_off(keys: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, n, s, q, level) of the baseline for each key: the stratum itself, else the first one that shares the most
    leading parts, else all. baseline has (key, n, s, q)."""
    parts = F.split("key", r"\|")
    out = keys.select("key").distinct().withColumn("p", parts)
    total = baseline.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select(F.struct("n", "s", "q").alias("all"))
    hits = []
    for level in (4, 3, 2, 1):
        name = f"m{level}"
        prefix = F.array_join(F.slice("p", 1, level), "|")
        table = baseline.where("n > 0").withColumn("p", parts).withColumn("prefix", F.array_join(F.slice("p", 1, level), "|"))
        first = table.groupBy("prefix").agg(F.min_by(F.struct("n", "s", "q"), "key").alias(name))
        out = out.withColumn("prefix", prefix).join(first, "prefix", "left").drop("prefix")
        hits.append((level, name))
    out = out.crossJoin(F.broadcast(total))  # one row
    level = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in hits], F.lit(0))
    best = F.coalesce(*[F.col(n) for _, n in hits], F.col("all"))
    return out.select("key", best.alias("b"), level.alias("level")).select("key", "b.*", "level")


_BASE = f"{_R}, k AS (SELECT *, {_STRATUM} AS key FROM r), bm AS (SELECT key, count(*) AS n, avg(tokens_out) AS mean, coalesce(var_samp(tokens_out), 0) AS var FROM k WHERE instance % 2 = 0 AND NOT (contains(key, 'gpt|audit|xs') OR contains(key, 'other')) GROUP BY 1), gl AS (SELECT sum(n) AS n, avg(x) AS mean, var_samp(x) AS var FROM (SELECT tokens_out AS x, 1 AS n FROM k WHERE instance % 2 = 0 AND NOT (contains(key, 'gpt|audit|xs') OR contains(key, 'other')))), t AS (SELECT key, count(*) AS n, avg(tokens_out) AS mean, coalesce(var_samp(tokens_out), 0) AS var FROM k WHERE instance % 2 = 1 GROUP BY 1)"
_PRE = "array_to_string(string_split({0}, '|')[1:{1}], '|')"
_LOOK = ", l AS (SELECT t.key, t.n, t.mean, t.var, " + ", ".join(f"(SELECT arg_min((b.n, b.mean, b.var), b.key) FROM bm b WHERE {_PRE.format('b.key', i)} = {_PRE.format('t.key', i)}) AS m{i}" for i in (4, 3, 2, 1)) + ", (SELECT (n, mean, var) FROM gl) AS m0 FROM t), u AS (SELECT key, n, mean, var, coalesce(m4, m3, m2, m1, m0) AS b, CASE WHEN m4 IS NOT NULL THEN 4 WHEN m3 IS NOT NULL THEN 3 WHEN m2 IS NOT NULL THEN 2 WHEN m1 IS NOT NULL THEN 1 ELSE 0 END AS level FROM l)"


def _arms(spark, sf_dir):
    rows = _stratified(spark, sf_dir)
    seen = ~(F.col("key").contains("gpt|audit|xs") | F.col("key").contains("other"))
    return moments(rows.where((F.col("instance") % 2 == 0) & seen), ["key"], "tokens_out"), moments(rows.where("instance % 2 = 1"), ["key"], "tokens_out")


@query(f"WITH {_BASE}{_LOOK} SELECT key, level, b[1]::BIGINT AS n, round(b[2], 4) AS mean FROM u")
def j9_back_off(spark, sf_dir):
    """The baseline of each stratum, backing off to shorter prefixes and then to all requests."""
    base, seen = _arms(spark, sf_dir)
    return back_off(seen, base).select("key", "level", "n", F.round(F.col("s") / F.col("n"), 4).alias("mean"))


@query(f"WITH {_BASE}{_LOOK}, s AS (SELECT sum(n * (b[2] - mean)) AS saved, sum(n * b[2]) AS base, sum(n * var + n * n * b[3] / b[1]) AS v, sum(n)::BIGINT AS n FROM u) SELECT n, round(saved, 2) AS saved, round(saved / base * 100, 4) AS pct, round((saved - 1.96::DOUBLE * sqrt(v)) / base * 100, 4) AS low, round((saved + 1.96::DOUBLE * sqrt(v)) / base * 100, 4) AS high FROM s")
def g28_baseline_savings(spark, sf_dir):
    """Savings against a baseline by stratum, with their 95 % interval."""
    base, seen = _arms(spark, sf_dir)
    b = back_off(seen, base).select("key", F.col("n").alias("m"), (F.col("s") / F.col("n")).alias("mu"), variance(F.col("n"), F.col("s"), F.col("q")).alias("mv"))
    rows = seen.join(b, "key").withColumn("mean", F.col("s") / F.col("n")).withColumn("var", variance(F.col("n"), F.col("s"), F.col("q")))
    n = F.col("n")
    s = rows.agg(F.sum(n * (F.col("mu") - F.col("mean"))).alias("saved"), F.sum(n * F.col("mu")).alias("base"), F.sum(n * F.col("var") + n * n * F.col("mv") / F.col("m")).alias("v"), F.sum("n").alias("n"))
    pct, low, high = wilson_free_ci(F.col("saved"), F.col("base"), F.col("v"))
    return s.select("n", F.round("saved", 2).alias("saved"), F.round(pct, 4).alias("pct"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query(f"WITH {_R}, v AS (SELECT instance, round(avg((tokens_out > 2000)::INT), 6) AS long_rate, round(avg((total_ms < 100)::INT), 6) AS fast_rate, round(avg((id % 11 = 0)::INT), 6) AS interrupt_rate FROM r GROUP BY 1) SELECT * FROM v")
def g32_verbosity(spark, sf_dir):
    """Shares of long outputs, fast skips and interrupts of each instance."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return requests(spark, sf_dir).groupBy("instance").agg(rate(F.col("tokens_out") > 2000).alias("long_rate"), rate(F.col("total_ms") < 100).alias("fast_rate"), rate(F.col("id") % 11 == 0).alias("interrupt_rate"))


@query(f"WITH {_R} SELECT CAST(ts AS DATE) AS day, count(DISTINCT instance) AS sessions, round(avg(tokens_after / tokens_before), 6) AS ratio, round(avg((id % 4 = 0)::INT), 6) AS retrieval_rate, round(avg((tokens_after <= tokens_before * 0.95)::INT), 6) AS gate_rate FROM r GROUP BY 1")
def g33_quality_snapshot(spark, sf_dir):
    """Daily averages of ratio, retrieval and gate rates."""
    rate = lambda c: F.round(F.avg(c), 6)
    return requests(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.countDistinct("instance").alias("sessions"), rate(F.col("tokens_after") / F.col("tokens_before")).alias("ratio"), rate((F.col("id") % 4 == 0).cast("double")).alias("retrieval_rate"),
        rate((F.col("tokens_after") <= F.col("tokens_before") * 0.95).cast("double")).alias("gate_rate"),
    )


@query(f"WITH {_R} SELECT model AS tool, count(*) AS calls, sum(tokens_before)::BIGINT AS original, sum(tokens_after)::BIGINT AS compressed, round(1 - sum(tokens_after) / sum(tokens_before), 6) AS reduction, round(avg(total_ms), 4) AS latency, max(total_ms) AS slowest FROM r GROUP BY 1")
def g34_g35_tool_report(spark, sf_dir):
    """Reduction and latency by tool."""
    return requests(spark, sf_dir).groupBy(F.col("model").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_before").alias("original"), F.sum("tokens_after").alias("compressed"), F.round(1 - F.sum("tokens_after") / F.sum("tokens_before"), 6).alias("reduction"),
        F.round(F.avg("total_ms"), 4).alias("latency"), F.max("total_ms").alias("slowest"),
    )


@query("SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS edges, (SELECT sum(length(text))::BIGINT FROM conversations) AS chars")
def g36_store_stats(spark, sf_dir):
    """Sizes of the stores."""
    chat = read(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("sessions"), F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))
    vectors = read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))
    edges = read(spark, sf_dir, "nation").select(F.lit(1).alias("e")).unionAll(read(spark, sf_dir, "customer").select(F.lit(1).alias("e"))).agg(F.count(F.lit(1)).alias("edges"))
    return chat.crossJoin(vectors).crossJoin(edges)  # one row each


@query(f"WITH {_R}, h AS (SELECT instance, count(*) AS n, avg(tokens_after / tokens_before) AS ratio, avg((cached > 0)::INT) AS cache, avg(least(1.0::DOUBLE, tokens_after / 40000.0)) AS load FROM r GROUP BY 1) SELECT instance, n, round(0.4::DOUBLE * (1 - ratio) + 0.3::DOUBLE * cache + 0.3::DOUBLE * (1 - load), 6) AS health, CASE WHEN load >= 0.9 THEN 'critical' WHEN load >= 0.5 THEN 'warning' ELSE 'ok' END AS state FROM h")
def g38_context_health(spark, sf_dir):
    """A health score of each instance from its savings, cache hits and load.

    Doubles add up in the order of ids, as the SQL adds them over a table in that order: many scores lie halfway between
    two results, where another order of the same sum falls otherwise.
    """
    w = Window.partitionBy("instance").orderBy("id", "ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio, load = F.col("tokens_after") / F.col("tokens_before"), F.least(F.lit(1.0), F.col("tokens_after") / 40000.0)
    rows = requests(spark, sf_dir).select("instance", "id", "ts", (F.col("cached") > 0).cast("int").alias("hit"), ratio.alias("ratio"), load.alias("load"))
    rows = rows.withColumns({"ratios": F.sum("ratio").over(w), "loads": F.sum("load").over(w), "k": F.row_number().over(w.orderBy("id", "ts"))})
    h = rows.groupBy("instance").agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("ratios", "k") / F.count("ratio")).alias("ratio"), (F.sum("hit") / F.count("hit")).alias("cache"), (F.max_by("loads", "k") / F.count("load")).alias("load")
    )
    state = F.when(F.col("load") >= 0.9, "critical").when(F.col("load") >= 0.5, "warning").otherwise("ok")
    health = 0.4 * (1 - F.col("ratio")) + 0.3 * F.col("cache") + 0.3 * (1 - F.col("load"))
    return h.select("instance", "n", (F.round(health * 1e6) / 1e6).alias("health"), state.alias("state"))


@query(f"WITH {_R}, h AS (SELECT instance, id, ts, sha256(model || '|' || mode) AS h FROM r), d AS (SELECT *, lag(h) OVER (PARTITION BY instance ORDER BY ts, id) AS before FROM h) SELECT instance, id, h <> before AS drifted FROM d WHERE before IS NOT NULL")
def g39_w19_drift(spark, sf_dir):
    """Whether the fixed part of a request differs from that of the request before."""
    w = Window.partitionBy("instance").orderBy("ts", "id")
    rows = requests(spark, sf_dir).withColumn("h", F.sha2(F.concat_ws("|", "model", "mode"), 256)).withColumn("before", F.lag("h").over(w))
    return rows.where("before is not null").select("instance", "id", (F.col("h") != F.col("before")).alias("drifted"))


@query(f"WITH {_R}, t AS (SELECT model AS tool, count(*) AS n, avg((id % 4 = 0)::INT) AS rate, avg((id % 8 = 0)::INT) AS full_rate FROM r WHERE mode = 'optimize' OR id % 2 = 0 GROUP BY 1) SELECT tool, n, CASE WHEN n < 10 THEN 'none' WHEN rate > 0.5 THEN 'keep_more' WHEN rate < 0.1 THEN 'keep_fewer' WHEN full_rate > 0.1 THEN 'check_full' ELSE 'as_is' END AS hint FROM t")
def g42_feedback_hints(spark, sf_dir):
    """A hint for each tool by how often its compressed output is retrieved."""
    i = F.col("id")
    t = requests(spark, sf_dir).where((F.col("mode") == "optimize") | (i % 2 == 0)).groupBy(F.col("model").alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.avg((i % 4 == 0).cast("double")).alias("rate"), F.avg((i % 8 == 0).cast("double")).alias("full_rate"))
    hint = F.when(F.col("n") < 10, "none").when(F.col("rate") > 0.5, "keep_more").when(F.col("rate") < 0.1, "keep_fewer").when(F.col("full_rate") > 0.1, "check_full").otherwise("as_is")
    return t.select("tool", "n", hint.alias("hint"))


#: Costs in millionths of a dollar: whole numbers add up alike in any order.
_LIMITS = {"tokens_per_request": 39000, "cost_per_request": 110_000, "requests_per_minute": 3, "tokens_per_minute": 60000, "cost_per_minute": 150_000, "cost_per_hour": 600_000, "cost_per_day": 12_000_000}


def _trail(what, seconds):
    return f"coalesce(sum({what}) OVER (PARTITION BY day ORDER BY tick RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND 1 PRECEDING), 0)"


@query(f"WITH {_R}, s AS (SELECT id, date_trunc('month', ts) AS day, epoch_us(ts) AS tick, tokens_before AS tokens, CAST(round(coalesce({_COST}, 0) * 1e6) AS BIGINT) AS cost FROM r), w AS (SELECT *, {_trail('1', 60)} AS mr, {_trail('tokens', 60)} AS mt, {_trail('cost', 60)} AS mc, {_trail('cost', 3600)} AS hc, {_trail('cost', 86400)} AS dc FROM s) SELECT id, mr::BIGINT AS minute_requests, mt::BIGINT AS minute_tokens, hc::BIGINT AS hour_cost, dc::BIGINT AS day_cost, CASE WHEN tokens > 39000 THEN 'tokens_per_request' WHEN cost > 110000 THEN 'cost_per_request' WHEN mr >= 3 THEN 'requests_per_minute' WHEN mt + tokens > 60000 THEN 'tokens_per_minute' WHEN mc + cost > 150000 THEN 'cost_per_minute' WHEN hc + cost > 600000 THEN 'cost_per_hour' WHEN dc + cost > 12000000 THEN 'cost_per_day' ELSE '' END AS reason FROM w")
def g43_w21_spend_guard(spark, sf_dir):
    """Trailing sums over a minute, an hour and a day before each request, and the first limit that it breaks."""
    c = cost(F.col("model"), F.col("tokens_before") - F.col("cached"), F.col("cached"), F.col("tokens_out"))
    rows = requests(spark, sf_dir).select("id", "ts", F.date_trunc("month", "ts").alias("month"), F.col("tokens_before").alias("tokens"), F.round(F.coalesce(c, F.lit(0.0)) * 1e6).cast("long").alias("cost"))
    out = spend_guard(rows, "month", _LIMITS)
    return out.select("id", F.col("minute_requests").cast("long").alias("minute_requests"), F.col("minute_tokens").cast("long").alias("minute_tokens"), F.col("hour_cost").cast("long").alias("hour_cost"), F.col("day_cost").cast("long").alias("day_cost"), "reason")


@query("SELECT split_part(o_orderpriority, '-', 2) AS suite, count(*) AS cases, round(avg(o_totalprice / 100000), 4) AS score, round(avg((o_orderstatus = 'F')::INT), 6) AS pass_rate, round(min(o_totalprice), 2) AS worst FROM orders GROUP BY 1")
def g44_eval_suites(spark, sf_dir):
    """Averages and pass rates of evaluation suites."""
    return read(spark, sf_dir, "orders").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("suite")).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("o_totalprice") / 100000), 4).alias("score"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("pass_rate"), F.round(F.min("o_totalprice"), 2).alias("worst")
    )


# --- windows, order, sampling ----------------------------------------------------------------------------------------


@query(f"WITH {_R}, w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tokens_out DESC, id) AS best, row_number() OVER (PARTITION BY model ORDER BY ts, id) AS k, row_number() OVER (PARTITION BY model ORDER BY ts DESC, id DESC) AS back FROM r) SELECT model, id FROM w WHERE k = 1 OR back = 1 OR best <= 5")
def w4_l3_edges_and_best(spark, sf_dir):
    """The first, the last and the five largest requests of each model, in their order."""
    w = Window.partitionBy("model")
    rows = requests(spark, sf_dir).withColumns({"best": F.row_number().over(w.orderBy(F.desc("tokens_out"), "id")), "k": F.row_number().over(w.orderBy("ts", "id")), "back": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id")))})
    return rows.where("k = 1 or back = 1 or best <= 5").orderBy("model", "k").select("model", "id")


@query(f"WITH {_R}, f AS (SELECT instance, model, min((ts, id)) AS first FROM r GROUP BY ALL), s AS (SELECT r.instance, r.id, r.ts, CASE WHEN f.first IS NOT NULL THEN 1 ELSE 0 END AS new FROM r LEFT JOIN f ON r.instance = f.instance AND r.model = f.model AND f.first = (r.ts, r.id)) SELECT instance, id, sum(new) OVER (PARTITION BY instance ORDER BY ts, id)::BIGINT AS models FROM s")
def w5_running_distinct(spark, sf_dir):
    """How many different models an instance has used up to each request."""
    first = F.row_number().over(Window.partitionBy("instance", "model").orderBy("ts", "id")) == 1
    rows = requests(spark, sf_dir).withColumn("new", first.cast("int"))
    return rows.select("instance", "id", F.sum("new").over(Window.partitionBy("instance").orderBy("ts", "id")).alias("models"))


@query(f"WITH {_R} SELECT id, CASE WHEN max(tokens_out) OVER w = min(tokens_out) OVER w THEN 0.5 ELSE round((tokens_out - min(tokens_out) OVER w) / (max(tokens_out) OVER w - min(tokens_out) OVER w), 6) END::DOUBLE AS scaled FROM r WINDOW w AS (PARTITION BY instance)")
def w12_min_max(spark, sf_dir):
    """Output sizes from 0 to 1 within their instance; constant ones are .5."""
    w = Window.partitionBy("instance")
    low, high = F.min("tokens_out").over(w), F.max("tokens_out").over(w)
    return requests(spark, sf_dir).select("id", F.when(high == low, 0.5).otherwise(F.round((F.col("tokens_out") - low) / (high - low), 6)).alias("scaled"))


@query(f"WITH {_R}, n AS (SELECT instance, id, model, row_number() OVER (PARTITION BY instance ORDER BY ts, id) AS k FROM r) SELECT instance, id, max(k) OVER (PARTITION BY instance) - k AS residency, coalesce(k - lag(k) OVER (PARTITION BY instance, model ORDER BY k), 0) AS gap FROM n")
def w14_residency(spark, sf_dir):
    """How many requests follow each one, and how far back the last one of its model is."""
    w = Window.partitionBy("instance")
    rows = requests(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("ts", "id")).cast("long"))
    return rows.select("instance", "id", (F.max("k").over(w) - F.col("k")).alias("residency"), F.coalesce(F.col("k") - F.lag("k").over(Window.partitionBy("instance", "model").orderBy("k")), F.lit(0)).alias("gap"))


@query(f"WITH {_R}, n AS (SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY ts DESC, id DESC) AS back, count(*) OVER (PARTITION BY instance) AS n FROM r), s AS (SELECT *, n - back AS place, greatest(1, (n - 20 + 9) // 10) AS step FROM n) SELECT instance, id FROM s WHERE back <= 20 OR place % step = 0")
def w17_l8_compacted_history(spark, sf_dir):
    """A dense tail of 20 requests of each instance, and an even sample of ten or so before it."""
    w = Window.partitionBy("instance")
    rows = requests(spark, sf_dir).withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id")))).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 20 + 9) / 10))
    return rows.where((F.col("back") <= 20) | ((F.col("n") - F.col("back")) % step == 0)).select("instance", "id")


@query(f"WITH {_R}, n AS (SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY tokens_out DESC, id) AS k, row_number() OVER (PARTITION BY instance ORDER BY ts, id) AS place, count(*) OVER (PARTITION BY instance) AS n FROM r), t AS (SELECT *, k <= ceil(n * 0.4::DOUBLE) AS top FROM n) SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY CASE WHEN top AND k % 2 = 1 THEN 0 WHEN NOT top THEN 1 ELSE 2 END, CASE WHEN top AND k % 2 = 1 THEN k WHEN NOT top THEN place ELSE -k END) AS position FROM t")
def w18_t39_bookends(spark, sf_dir):
    """The top two fifths of each instance's requests alternate to the front and the back, the others stay in the middle."""
    w = Window.partitionBy("instance")
    rows = requests(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy(F.desc("tokens_out"), "id")), "place": F.row_number().over(w.orderBy("ts", "id")), "n": F.count(F.lit(1)).over(w)})
    top = F.col("k") <= F.ceil(F.col("n") * 0.4)
    zone = F.when(top & (F.col("k") % 2 == 1), 0).when(~top, 1).otherwise(2)
    at = F.when(zone == 0, F.col("k")).when(zone == 1, F.col("place")).otherwise(-F.col("k"))
    return rows.withColumn("zone", zone).withColumn("at", at).select("instance", "id", F.row_number().over(w.orderBy("zone", "at")).cast("long").alias("position"))


@query(f"WITH {_R}, c AS (SELECT instance, model, count(*) AS c FROM r WHERE id % 3 > 0 OR instance % 4 > 0 OR model = 'gpt-large' GROUP BY ALL), m AS (SELECT instance, max(c) AS c, sum(c) AS n, arg_max(model, (c, model)) AS model FROM c GROUP BY 1) SELECT instance, CASE WHEN c >= n * 0.3::DOUBLE THEN model WHEN n < 50 THEN 'early' WHEN n < 65 THEN 'middle' ELSE 'late' END AS phase FROM m")
def w20_phase(spark, sf_dir):
    """The phase of an instance: its dominant model from a share on, else by how far it is."""
    rows = requests(spark, sf_dir).where("id % 3 > 0 or instance % 4 > 0 or model = 'gpt-large'").groupBy("instance", "model").agg(F.count(F.lit(1)).alias("c"))
    m = rows.groupBy("instance").agg(F.max("c").alias("c"), F.sum("c").alias("n"), F.max_by("model", F.struct("c", "model")).alias("model"))
    return m.select("instance", F.when(F.col("c") >= F.col("n") * 0.3, F.col("model")).when(F.col("n") < 50, "early").when(F.col("n") < 65, "middle").otherwise("late").alias("phase"))


@query(f"WITH {_R} SELECT id, tokens_out FROM r ORDER BY tokens_out DESC, id LIMIT 25 OFFSET 50")
def l1_page(spark, sf_dir):
    """The third page of 25 requests by size."""
    return requests(spark, sf_dir).select("id", "tokens_out").orderBy(F.desc("tokens_out"), "id").offset(50).limit(25)


@query(f"WITH {_R}, n AS (SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY ts, id) - 1 AS k, count(*) OVER (PARTITION BY instance) AS n FROM r) SELECT instance, id FROM n WHERE k % greatest(1, n // 10) = 0")
def l4_stride_sample(spark, sf_dir):
    """Every so manieth request of each instance, about ten."""
    w = Window.partitionBy("instance")
    rows = requests(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy("ts", "id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("k") % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0).select("instance", "id")


@query("WITH t AS (SELECT p_partkey, (p_brand = 'Brand#7')::INT * 3 + contains(p_name, 'ring')::INT * 2 + (p_size < 10)::INT AS score FROM part) SELECT p_partkey, score FROM t ORDER BY score DESC, p_partkey LIMIT 12")
def l9_eager_tools(spark, sf_dir):
    """The twelve tools to load eagerly, by priority."""
    score = (F.col("p_brand") == "Brand#7").cast("int") * 3 + F.col("p_name").contains("ring").cast("int") * 2 + (F.col("p_size") < 10).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(12)


QUERIES, ORACLES = query.queries, query.oracles
