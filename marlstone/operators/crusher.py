"""The array crusher: profile the items of an array, choose a strategy, and flag the items to keep.

An array is the rows of one `arr`, in the order of `idx` (0, 1, ...), `n` of them; `item` is an item as text. All steps
are windows and aggregations over `arr`, so arrays of any number are crushed at once; one array must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.operators.text import ERROR_KEYWORDS
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()


# Windows need a session: they are made where they are used.
def _by():
    return Window.partitionBy("arr")


def _in_order():
    return _by().orderBy("idx")


# --- operators -------------------------------------------------------------------------------------------------------


def arrays(rows: DataFrame, by: str, order: list[str], item: Column, **fields: Column) -> DataFrame:
    """(arr, idx, n, item, fields) of rows grouped by `by`."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.select(
        F.col(by).alias("arr"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"),
        item.alias("item"), *[c.alias(f) for f, c in fields.items()],
    )


def profile(items: DataFrame, field: str) -> DataFrame:
    """count, unique_count (null is a value), unique_ratio, constant flag, and of finite numbers min, max, mean, variance."""
    x = F.col(field).cast("double")
    unique = F.countDistinct(field) + F.max(F.col(field).isNull().cast("int"))
    return items.groupBy("arr").agg(
        F.count(F.lit(1)).alias("count"), unique.alias("unique_count"), (unique / F.count(F.lit(1))).alias("unique_ratio"), (unique == 1).alias("constant"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.when(F.count(x) < 2, 0.0).otherwise(F.var_samp(x)).alias("variance"),
    )


def sequential(items: DataFrame, field: str) -> DataFrame:
    """Whether 5 numbers or more run up in steps of 0.5 to 2: over 80 % of the sorted gaps, and over 70 % in array order."""
    x = F.col(field).cast("double")
    step = lambda d: (d >= 0.5) & (d <= 2.0)
    rows = items.where(x.isNotNull()).select("arr", (x - F.lag(x).over(_by().orderBy(x, "idx"))).alias("gap"), (x - F.lag(x).over(_in_order())).alias("next"))
    per = rows.groupBy("arr").agg(
        F.count(F.lit(1)).alias("m"), F.avg("gap").alias("mean"), F.avg(step(F.col("gap")).cast("double")).alias("even"), F.avg((F.col("next") >= 0).cast("double")).alias("rising")
    )
    return per.select("arr", ((F.col("m") >= 5) & step(F.col("mean")) & (F.col("even") > 0.8) & (F.col("rising") > 0.7)).alias("sequential"))


def score_confidence(items: DataFrame, field: str) -> DataFrame:
    """How much a numeric field looks like a score: bounds, falling order, fractions. Sequential fields are none."""
    x = F.col(field).cast("double")
    rows = items.where(x.isNotNull()).select("arr", x.alias("x"), (x <= F.lag(x).over(_in_order())).alias("falls"), F.row_number().over(_in_order()).alias("k"))
    whole = F.col("x") == F.floor("x")
    per = rows.groupBy("arr").agg(
        F.count(F.lit(1)).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg(F.col("falls").cast("double")).alias("falling"),
        F.avg(F.when(F.col("k") <= 20, (~whole).cast("double"))).alias("fractional"),
    )
    inside = lambda a, b: (F.col("low") >= a) & (F.col("high") <= b)
    bounded = F.when(inside(0, 1), 0.4).when(inside(0, 10), 0.3).when(inside(0, 100), 0.25).when(inside(-1, 1), 0.35)
    more = F.when((F.col("m") >= 5) & (F.col("falling") > 0.7), 0.3).otherwise(0.0) + F.when(F.col("fractional") > 0.3, 0.1).otherwise(0.0)
    first = sequential(items.where("idx < 50"), field)
    return per.join(first, "arr", "left").select("arr", F.when(bounded.isNull() | F.coalesce("sequential", F.lit(False)), 0.0).otherwise(F.round(bounded + more, 2)).alias("confidence"))


def change_points(items: DataFrame, field: str, window: int = 5) -> DataFrame:
    """(arr, idx) where the mean of the next `window` leaves that of the last by over two deviations, over a window apart."""
    x = F.col(field).cast("double")
    raw = items.select(
        "arr", "idx", "n", F.avg(x).over(_in_order().rowsBetween(-window, -1)).alias("before"), F.avg(x).over(_in_order().rowsBetween(0, window - 1)).alias("after"),
        F.stddev_samp(x).over(_by()).alias("deviation"),
    ).where((F.col("n") >= 2 * window) & F.col("idx").between(window, F.col("n") - window) & (F.abs(F.col("after") - F.col("before")) > 2 * F.col("deviation")))
    far = lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(acc, -1) > window), F.concat(acc, F.array(i))).otherwise(acc)
    kept = raw.groupBy("arr").agg(F.array_sort(F.collect_list("idx")).alias("found"))
    return kept.select("arr", F.explode(F.aggregate("found", F.array().cast("array<bigint>"), far)).alias("idx"))


def is_anomaly(field: str) -> Column:
    """Over two sample deviations from the mean of the array."""
    x = F.col(field).cast("double")
    return F.coalesce((F.stddev_samp(x).over(_by()) > 0) & (F.abs(x - F.avg(x).over(_by())) > 2 * F.stddev_samp(x).over(_by())), F.lit(False))


def is_error(item: str = "item") -> Column:
    return F.lower(item).rlike("|".join(ERROR_KEYWORDS))


def rare_values(items: DataFrame, field: str) -> DataFrame:
    """(arr, value) of a field of 2 to 50 values outside of the most frequent ones (5 at most) that cover 80 % of the items."""
    counts = items.groupBy("arr", F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    w = _by().orderBy(F.desc("c"), "value")
    ranked = counts.select(
        "arr", "value", "c", F.row_number().over(w).alias("r"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.sum("c").over(_by()).alias("total"), F.count(F.lit(1)).over(_by()).alias("distinct"),
    )
    covering = (F.col("upto") - F.col("c")) < F.ceil(F.col("total") * 0.8)  # of the top values, up to the one that reaches the share
    marked = ranked.withColumn("top", F.count_if(covering).over(_by())).where("distinct between 2 and 50 and top <= 5 and r > top")
    return marked.select("arr", "value")


def rare_fields(items: DataFrame, fields: list[str]) -> Column:
    """Whether an item of an array of 5 or more holds a field that under 20 % of the items hold."""
    return F.col("n").__ge__(5) & F.greatest(*[F.col(f).isNotNull() & (F.count(f).over(_by()) < F.col("n") * 0.2) for f in fields], F.lit(False))


def anchors(n: Column, limit: int, front: float, back: float, idx: Column) -> Column:
    """Whether a place is a front or back anchor of an array that is over the limit; the middle is left to density."""
    slots = F.least(F.greatest(F.lit(3), F.lit(int(limit * 0.25))), F.lit(12), n)
    f, b = F.greatest(F.lit(1), F.floor(slots * front)), F.greatest(F.lit(1), F.floor(slots * back))
    b = F.when(f + b > slots, F.greatest(F.lit(1), slots - f)).otherwise(b)
    f_end, b_start = F.least(f * 2, F.floor(n / 3)), F.greatest(n - b * 2, F.floor(2 * n / 3))

    def spread(start, end, k):
        size = end - start
        j = F.sequence(F.lit(1), k)
        places = F.transform(j, lambda i: F.least(start + F.floor(i * (size / (k + 1))), end - 1))
        return F.when(k >= size, (idx >= start) & (idx < end)).otherwise(F.array_contains(places, idx))

    return F.when(n <= limit, F.lit(True)).otherwise(spread(F.lit(0).cast("long"), f_end, f) | spread(b_start, n, b))


def information(items: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `information`: .4 rarity of the field values + .3 length among the items + .3 structure (0 where all share fields)."""
    rarity = sum(1 - F.count(F.lit(1)).over(Window.partitionBy("arr", f)) / F.col("n") for f in fields) / len(fields)
    size = F.length("item")
    low, high = F.min(size).over(_by()), F.max(size).over(_by())
    length = F.when(high == low, 0.5).otherwise((size - low) / (high - low))
    return items.withColumn("information", F.when(F.col("n") < 2, 0.5).otherwise(0.4 * rarity + 0.3 * length))


def prioritize(items: DataFrame, limit: int) -> DataFrame:
    """Adds `final` to items with `keep` and `critical`.

    Kept items of equal text count once. Free places are filled from the others in strides, texts not seen yet. If there
    are too many, all critical ones stay, then the first three, the last two, and the rest in order, up to the limit.
    """
    rows = items.withColumn("keep", F.col("keep") & (F.row_number().over(Window.partitionBy("arr", "item", "keep").orderBy("idx")) == 1))
    rows = rows.withColumn("m", F.count_if("keep").over(_by())).withColumn("seen", F.max("keep").over(Window.partitionBy("arr", "item")))
    # Others in the order in which strides visit them.
    rows = rows.withColumn("c", F.when(~F.col("keep"), F.row_number().over(Window.partitionBy("arr", "keep").orderBy("idx")) - 1))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("m")) / (F.lit(limit) - F.col("m") + 1)))
    rows = rows.withColumn("visit", F.when(F.col("m") < limit, F.col("c") % step))
    new = ~F.col("keep") & ~F.col("seen") & (F.row_number().over(Window.partitionBy("arr", "item", "keep").orderBy("visit", "c")) == 1)
    rows = rows.withColumn("new", new).withColumn("turn", F.when(F.col("new"), F.row_number().over(Window.partitionBy("arr", "new").orderBy("visit", "c"))))
    filled = F.col("keep") | (F.col("new") & (F.col("turn") <= F.lit(limit) - F.col("m")))
    group = F.when(F.col("critical"), 0).when(F.col("idx") < 3, 1).when(F.col("idx") >= F.col("n") - 2, 2).when(F.col("keep"), 3)
    rows = rows.withColumn("group", group)
    place = F.row_number().over(_by().orderBy(F.asc_nulls_last("group"), "idx"))
    final = F.when(F.col("m") <= limit, filled).otherwise(F.col("group").isNotNull() & (F.col("critical") | (place <= limit)))
    return items.join(rows.select("arr", "idx", final.alias("final")), ["arr", "idx"])


# --- arrays of the test tables ---------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    """Events of a user."""
    cents = F.round(F.col("value") * 100).cast("long")
    return arrays(
        read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.concat_ws(" ", "event_type", cents.cast("string"), "props"),
        event_id=F.col("event_id"), kind=F.col("event_type"), value=F.col("value"), k=F.get_json_object("props", "$.k").try_cast("long"),
    )


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of a supplier's parts."""
    return arrays(
        read(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"],
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")),
        quantity=F.col("l_quantity"), price=F.col("l_extendedprice"), discount=F.col("l_discount"), flag=F.col("l_returnflag"),
    )


_E = "e AS (SELECT user_id AS arr, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n, concat_ws(' ', event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), props) AS item, event_id, event_type AS kind, value, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_L = "l AS (SELECT l_suppkey AS arr, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n, concat_ws(' ', l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS item, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_returnflag AS flag FROM lineitem)"
_ERR = f"regexp_matches(lower(item), '{'|'.join(ERROR_KEYWORDS)}')"


def _anomaly(x):
    return f"coalesce(stddev_samp({x}) OVER (PARTITION BY arr) > 0 AND abs({x} - avg({x}) OVER (PARTITION BY arr)) > 2 * stddev_samp({x}) OVER (PARTITION BY arr), false)"


@query(f"WITH {_E}, t AS (SELECT arr, idx, CASE WHEN arr % 5 = 4 THEN 'nested' WHEN arr % 5 = 3 AND idx % 2 = 0 THEN 'string' WHEN arr % 5 = 3 THEN 'number' WHEN arr % 5 = 2 THEN 'bool' WHEN arr % 5 = 1 THEN 'number' ELSE 'dict' END AS kind FROM e) SELECT arr AS user_id, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS class FROM t GROUP BY 1")
def a1_array_class(spark, sf_dir):
    """The class of a JSON array by the types of its items: dict, string, number, bool, nested, mixed or empty."""
    kind = F.col("arr") % 5
    one = (
        F.when(kind == 4, F.lit("[1]")).when((kind == 3) & (F.col("idx") % 2 == 0), F.to_json(F.array("kind")).substr(F.lit(2), F.length("kind") + 2))
        .when(kind.isin(3, 1), F.col("k").cast("string")).when(kind == 2, F.lit("true")).otherwise(F.lit('{"k": 1}'))
    )
    docs = _events(spark, sf_dir).groupBy("arr").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("json"))
    return docs.select(F.col("arr").alias("user_id"), array_class(F.col("json")).alias("class"))


def array_class(json: Column) -> Column:
    """The class of a JSON array text; null where it is no array."""
    parts = F.from_json(json, "array<variant>")
    kinds = F.array_distinct(F.transform(parts, lambda v: _json_kind(F.schema_of_variant(v))))
    return F.when(F.size(parts) == 0, "empty").when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(parts.isNotNull(), "mixed")


def _json_kind(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), "dict").when(schema.startswith("ARRAY"), "nested").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "bool").when(schema == "VOID", "null").otherwise("number")
    )


@query(f"WITH {_E}, s AS (SELECT arr, 'value' AS field, count(*) AS count, count(DISTINCT value) AS u, min(value) AS low, max(value) AS high, avg(value) AS mean, var_samp(value) AS variance FROM e GROUP BY 1 UNION ALL SELECT arr, 'k', count(*), count(DISTINCT k), min(k), max(k), avg(k), var_samp(k) FROM e GROUP BY 1) SELECT arr AS user_id, field, count, u AS unique_count, round(u / count, 6) AS unique_ratio, u = 1 AS constant, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS mean, round(variance, 6) AS variance FROM s")
def a2_number_profile(spark, sf_dir):
    """Profile of the numeric fields of each user's events."""
    items = _events(spark, sf_dir)
    both = profile(items, "value").withColumn("field", F.lit("value")).unionByName(profile(items, "k").withColumn("field", F.lit("k")))
    r = lambda c, d: F.round(c, d).alias(c)
    return both.select(F.col("arr").alias("user_id"), "field", "count", "unique_count", r("unique_ratio", 6), "constant", r("low", 4), r("high", 4), r("mean", 4), r("variance", 6))


@query(f"WITH {_E}, c AS (SELECT arr, kind, count(*) AS c FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY arr ORDER BY c DESC, kind) AS r FROM c) SELECT user_id, avg_length, unique_count, top FROM (SELECT arr AS user_id, round(avg(length(kind)), 4) AS avg_length, count(DISTINCT kind) AS unique_count FROM e GROUP BY 1) JOIN (SELECT arr, string_agg(kind || ':' || c, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY 1) ON arr = user_id")
def a2_text_profile(spark, sf_dir):
    """Profile of a text field: mean length, values, and the three most frequent with their counts."""
    items = _events(spark, sf_dir)
    ranked = items.groupBy("arr", "kind").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.row_number().over(_by().orderBy(F.desc("c"), "kind")))
    top = ranked.where("r <= 3").groupBy("arr").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "kind", F.col("c").cast("string")).alias("t")))).alias("top"))
    base = items.groupBy("arr").agg(F.round(F.avg(F.length("kind")), 4).alias("avg_length"), F.countDistinct("kind").alias("unique_count"))
    return base.join(top, "arr").select(F.col("arr").alias("user_id"), "avg_length", "unique_count", F.array_join("top.t", ",").alias("top"))


_RAW = "p AS (SELECT arr, idx FROM (SELECT arr, idx, n, avg({x}) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg({x}) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, stddev_samp({x}) OVER (PARTITION BY arr) AS d FROM {t} WINDOW o AS (PARTITION BY arr ORDER BY idx)) WHERE n >= 10 AND idx BETWEEN 5 AND n - 5 AND abs(a - b) > 2 * d), g AS (SELECT arr, list_reduce(list(list_value(idx) ORDER BY idx), lambda a, b: CASE WHEN b[1] - a[-1] > 5 THEN list_concat(a, b) ELSE a END) AS ids FROM p GROUP BY 1), cp AS (SELECT arr, unnest(ids) AS idx FROM g)"


@query(f"WITH {_E}, {_RAW.format(x='value', t='e')} SELECT arr AS user_id, idx FROM cp")
def a3_change_points(spark, sf_dir):
    """Change points of each user's values, the first of each cluster."""
    return change_points(_events(spark, sf_dir), "value").select(F.col("arr").alias("user_id"), "idx")


_SEQ = "SELECT arr, count(*) >= 5 AND avg(gap) BETWEEN 0.5 AND 2 AND avg(CASE WHEN gap BETWEEN 0.5 AND 2 THEN 1.0::DOUBLE WHEN gap IS NOT NULL THEN 0 END) > 0.8 AND avg(CASE WHEN step >= 0 THEN 1.0::DOUBLE WHEN step IS NOT NULL THEN 0 END) > 0.7 AS sequential FROM (SELECT arr, {x} - lag({x}) OVER (PARTITION BY arr ORDER BY {x}, idx) AS gap, {x} - lag({x}) OVER (PARTITION BY arr ORDER BY idx) AS step FROM {t} WHERE {x} IS NOT NULL) GROUP BY 1"
_ORD = "o AS (SELECT o_custkey AS arr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey AS step, o_totalprice AS price, o_orderpriority AS word FROM orders)"


def _orders(spark, sf_dir) -> DataFrame:
    """Orders of a customer; `step` numbers them."""
    rows = arrays(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], F.col("o_orderpriority"), id=F.col("o_orderkey"), price=F.col("o_totalprice"), word=F.col("o_orderpriority"))
    return rows.withColumn("step", F.col("idx") + 1 + F.col("arr"))


@query(f"WITH {_ORD}, a AS ({_SEQ.format(x='id', t='o')}), b AS ({_SEQ.format(x='step', t='o')}) SELECT arr AS o_custkey, a.sequential AS id_sequential, b.sequential AS step_sequential FROM a JOIN b USING (arr)")
def a7_sequential(spark, sf_dir):
    """Whether the numbers of a customer's orders form a near-sequential ascending run."""
    items = _orders(spark, sf_dir)
    a, b = (sequential(items, f).withColumnRenamed("sequential", f"{f}_sequential") for f in ("id", "step"))
    return a.join(b, "arr").withColumnRenamed("arr", "o_custkey")


@query(f"""WITH {_ORD}, q AS ({_SEQ.format(x='step', t='o')}), s AS (SELECT arr, count(*) AS n, count(DISTINCT id) / count(*) AS uid, min(id) AS lo, max(id) AS hi, count(DISTINCT step) / count(*) AS ust, min(step) AS slo, max(step) AS shi, count(DISTINCT word) / count(*) AS uw FROM o GROUP BY 1)
SELECT arr AS o_custkey, CASE WHEN uid > 0.95 AND hi > lo THEN 0.85 WHEN uid > 0.98 THEN 0.7 ELSE 0 END::DOUBLE AS id_confidence, CASE WHEN ust < 0.9 THEN 0 WHEN sequential AND ust > 0.95 THEN 0.9 WHEN ust > 0.95 AND shi > slo THEN 0.85 WHEN ust > 0.98 THEN 0.7 ELSE 0 END::DOUBLE AS step_confidence, CASE WHEN uw > 0.98 THEN 0.7 ELSE 0 END::DOUBLE AS word_confidence FROM s JOIN q USING (arr)""")
def a5_id_fields(spark, sf_dir):
    """How surely a field of a customer's orders is an identifier: unique, sequential or wide numbers, unique words."""
    items = _orders(spark, sf_dir)

    def number(f):
        s = profile(items, f).join(sequential(items, f), "arr")
        u = F.col("unique_ratio")
        found = F.when(u < 0.9, 0.0).when(F.col("sequential") & (u > 0.95), 0.9).when((u > 0.95) & (F.col("high") > F.col("low")), 0.85).when(u > 0.98, 0.7).otherwise(0.0)
        return s.select("arr", found.alias(f"{f}_confidence"))

    word = profile(items.withColumn("size", F.length("word")), "word").select("arr", F.when(F.col("unique_ratio") > 0.98, 0.7).otherwise(0.0).alias("word_confidence"))
    return number("id").join(number("step"), "arr").join(word, "arr").withColumnRenamed("arr", "o_custkey")


def _score_sql(x, t):
    return f"""SELECT arr, CASE WHEN coalesce(sequential, false) THEN 0 WHEN lo >= 0 AND hi <= 1 THEN 0.4 + more WHEN lo >= 0 AND hi <= 10 THEN 0.3 + more WHEN lo >= 0 AND hi <= 100 THEN 0.25 + more WHEN lo >= -1 AND hi <= 1 THEN 0.35 + more ELSE 0 END AS c FROM (SELECT arr, min(x) AS lo, max(x) AS hi, CASE WHEN count(*) >= 5 AND avg(CASE WHEN x <= before THEN 1.0::DOUBLE WHEN before IS NOT NULL THEN 0 END) > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN avg(CASE WHEN r <= 20 THEN CASE WHEN x <> floor(x) THEN 1.0::DOUBLE ELSE 0 END END) > 0.3 THEN 0.1 ELSE 0 END AS more FROM (SELECT arr, {x} AS x, lag({x}) OVER w AS before, row_number() OVER w AS r FROM {t} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY arr ORDER BY idx)) GROUP BY 1) LEFT JOIN ({_SEQ.format(x=x, t=f'(SELECT * FROM {t} WHERE idx < 50)')}) USING (arr)"""


_RANKED = "s AS (SELECT l_suppkey AS arr, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS idx, l_discount AS discount, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)"


@query(f"WITH {_RANKED} SELECT arr AS l_suppkey, round(a.c, 2)::DOUBLE AS discount, round(b.c, 2)::DOUBLE AS quantity, round(p.c, 2)::DOUBLE AS price FROM ({_score_sql('discount', 's')}) a JOIN ({_score_sql('quantity', 's')}) b USING (arr) JOIN ({_score_sql('price', 's')}) p USING (arr)")
def a6_score_fields(spark, sf_dir):
    """How much each number of a supplier's lines, by falling discount, looks like a score."""
    items = arrays(read(spark, sf_dir, "lineitem").withColumn("down", -F.col("l_discount")), "l_suppkey", ["down", "l_orderkey", "l_linenumber", "l_partkey"], F.lit(""), discount=F.col("l_discount"), quantity=F.col("l_quantity"), price=F.col("l_extendedprice"))
    parts = [score_confidence(items, f).withColumnRenamed("confidence", f) for f in ("discount", "quantity", "price")]
    return parts[0].join(parts[1], "arr").join(parts[2], "arr").withColumnRenamed("arr", "l_suppkey")


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM d) GROUP BY ALL), p AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*) AS u, sum(c * log2(c)) AS s FROM c WHERE ch <> '' GROUP BY 1) SELECT doc_id, CASE WHEN n < 2 OR u < 2 THEN 0 ELSE round((log2(n) - s / n) / log2(least(u, n)), 6) END::DOUBLE AS by_distinct, CASE WHEN n < 2 THEN 0 ELSE round((log2(n) - s / n) / log2(n), 6) END::DOUBLE AS by_length FROM p")
def a8_text_entropy(spark, sf_dir):
    """Character entropy of each text with both normalisers: the distinct characters, and the length."""
    chars = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).where("ch <> ''")
    counts = chars.groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("u"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    bits = F.log2("n") - F.col("s") / F.col("n")
    norm = lambda top, least, name: F.when((F.col("n") < 2) | (top < least), 0.0).otherwise(F.round(bits / F.log2(top), 6)).alias(name)
    return per.select("doc_id", norm(F.least("u", "n"), 2, "by_distinct"), norm(F.col("n"), 2, "by_length"))


_RARE = "rare AS (SELECT arr, v FROM (SELECT *, count(*) FILTER (upto - c < ceil(total * 0.8::DOUBLE)) OVER (PARTITION BY arr) AS top FROM (SELECT arr, v, c, row_number() OVER w AS r, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY arr) AS total, count(*) OVER (PARTITION BY arr) AS d FROM (SELECT arr, {f} AS v, count(*) AS c FROM {t} GROUP BY ALL) WINDOW w AS (PARTITION BY arr ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) WHERE d BETWEEN 2 AND 50 AND top <= 5 AND r > top)"


@query(f"WITH {_E}, {_RARE.format(f='kind', t='e')} SELECT e.arr AS user_id, idx FROM e JOIN rare ON e.arr = rare.arr AND kind = v")
def a11_rare_status(spark, sf_dir):
    """Items whose status is not among the few that cover four fifths of the array."""
    items = _events(spark, sf_dir)
    rare = rare_values(items, "kind").withColumnRenamed("value", "kind")
    return items.join(rare, ["arr", "kind"], "left_semi").select(F.col("arr").alias("user_id"), "idx")


@query(f"WITH {_E}, f AS (SELECT *, CASE WHEN k < 15 THEN k END AS few, CASE WHEN k % 2 = 0 THEN k END AS half FROM e), {_RARE.format(f='kind', t='e')} SELECT f.arr AS user_id, idx FROM (SELECT arr, idx, n, kind, few IS NOT NULL AND count(few) OVER (PARTITION BY arr) < n * 0.2::DOUBLE OR half IS NOT NULL AND count(half) OVER (PARTITION BY arr) < n * 0.2::DOUBLE AS odd FROM f) f LEFT JOIN rare ON f.arr = rare.arr AND kind = v WHERE n >= 5 AND (odd OR v IS NOT NULL)")
def a10_structural_outliers(spark, sf_dir):
    """Items with a field that under a fifth of the array holds, or with a rare status."""
    items = _events(spark, sf_dir).withColumn("few", F.when(F.col("k") < 15, F.col("k"))).withColumn("half", F.when(F.col("k") % 2 == 0, F.col("k")))
    rare = rare_values(items, "kind").select("arr", F.col("value").alias("kind"), F.lit(True).alias("rare"))
    flagged = items.withColumn("odd", rare_fields(items, ["few", "half"])).join(rare, ["arr", "kind"], "left")
    return flagged.where("n >= 5 and (odd or rare)").select(F.col("arr").alias("user_id"), "idx")


@query(f"WITH {_E} SELECT arr AS user_id, idx FROM e WHERE {_ERR}")
def a12_error_items(spark, sf_dir):
    """Items whose text names an error."""
    return _events(spark, sf_dir).where(is_error()).select(F.col("arr").alias("user_id"), "idx")


def pattern(stats: DataFrame) -> Column:
    """time_series, logs, search_results or generic, from temporal, varies, message, level and score of an array."""
    return (
        F.when(F.col("temporal") & F.col("varies"), "time_series").when(F.col("message") & F.col("level"), "logs")
        .when(F.col("score") >= 0.5, "search_results").otherwise("generic")
    )


@query(f"""WITH {_E}, {_RANKED}, {_ORD}, t AS (
SELECT 'events' AS source, CAST(arr AS VARCHAR) AS arr, true AS temporal, var_samp(value) > 0 AS varies, false AS message, false AS level, 0 AS score FROM e GROUP BY arr
UNION ALL SELECT 'documents', source, false, false, count(DISTINCT text) / count(*) > 0.5 AND avg(length(coalesce(text, ''))) > 20, count(DISTINCT lang) / count(*) < 0.1 AND count(DISTINCT lang) BETWEEN 2 AND 10, 0 FROM documents GROUP BY source
UNION ALL SELECT 'lines', CAST(arr AS VARCHAR), false, true, false, false, c FROM ({_score_sql('discount', 's')})
UNION ALL SELECT 'orders', CAST(arr AS VARCHAR), false, true, false, false, c FROM ({_score_sql('price', 'o')}))
SELECT source, CASE WHEN temporal AND varies THEN 'time_series' WHEN message AND level THEN 'logs' WHEN score >= 0.5 THEN 'search_results' ELSE 'generic' END AS pattern, count(*) AS n FROM t GROUP BY ALL""")
def a4_array_patterns(spark, sf_dir):
    """What four kinds of arrays are taken for: events of a user, documents of a source, ranked lines, orders."""
    no = F.lit(False)
    events = profile(_events(spark, sf_dir), "value").select(F.lit("events").alias("source"), F.col("arr").cast("string").alias("arr"), F.lit(True).alias("temporal"), (F.col("variance") > 0).alias("varies"), no.alias("message"), no.alias("level"), F.lit(0.0).alias("score"))
    share, langs = lambda c: F.countDistinct(c) / F.count(F.lit(1)), F.countDistinct("lang")
    texts = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("arr")).agg(
        ((share("text") > 0.5) & (F.avg(F.length(F.coalesce("text", F.lit("")))) > 20)).alias("message"), ((share("lang") < 0.1) & langs.between(2, 10)).alias("level")
    ).select(F.lit("documents").alias("source"), "arr", no.alias("temporal"), no.alias("varies"), "message", "level", F.lit(0.0).alias("score"))

    def scored(source, items, field):
        return score_confidence(items, field).select(F.lit(source).alias("source"), F.col("arr").cast("string").alias("arr"), no.alias("temporal"), F.lit(True).alias("varies"), no.alias("message"), no.alias("level"), F.col("confidence").alias("score"))

    ranked = arrays(read(spark, sf_dir, "lineitem").withColumn("down", -F.col("l_discount")), "l_suppkey", ["down", "l_orderkey", "l_linenumber", "l_partkey"], F.lit(""), discount=F.col("l_discount"))
    stats = events.unionByName(texts).unionByName(scored("lines", ranked, "discount")).unionByName(scored("orders", _orders(spark, sf_dir), "price"))
    return stats.groupBy("source", pattern(stats).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def crushable() -> tuple[Column, Column, Column]:
    """(crushable, confidence, reason) from has_id, id_unique, text_unique, number_unique and signals of an array."""
    most, content, signal = F.greatest("text_unique", "id_unique"), F.greatest("text_unique", "number_unique"), F.col("signals") > 0
    cases = [
        ((content < 0.1) & F.col("has_id"), True, 0.85, "repetitive_content_with_ids"), (most < 0.3, True, 0.9, "low_uniqueness_safe_to_sample"),
        (F.col("has_id") & (most > 0.8) & ~signal, False, 0.85, "unique_entities_no_signal"), ((most > 0.8) & signal, True, 0.7, "unique_entities_with_signal"),
        (~signal, False, 0.6, "medium_uniqueness_no_signal"), (F.lit(True), True, 0.5, "medium_uniqueness_with_signal"),
    ]
    out = []
    for k in (1, 2, 3):
        col = None
        for case in cases:
            col = F.when(case[0], case[k]) if col is None else col.when(case[0], case[k])
        out.append(col)
    return out[0], out[1], out[2]


def strategy(pattern_: Column, n: Column, can: Column, points: Column, message_unique: Column, least: int = 5) -> Column:
    """none, skip, time_series, cluster_sample, top_n or smart_sample."""
    return (
        F.when(n < least, "none").when(~can, "skip").when((pattern_ == "time_series") & (points > 0), "time_series")
        .when((pattern_ == "logs") & (message_unique < 0.5), "cluster_sample").when(pattern_ == "search_results", "top_n").otherwise("smart_sample")
    )


def reduction(strategy_: Column, constant: Column) -> Column:
    """Expected share of items that go, from the strategy and the share of constant fields."""
    base = F.when(strategy_ == "time_series", 0.7).when(strategy_ == "cluster_sample", 0.8).when(strategy_ == "top_n", 0.6).when(strategy_ == "smart_sample", 0.5).otherwise(0.3)
    return F.when(strategy_ == "none", 0.0).otherwise(F.least(base + constant * 0.2, F.lit(0.95)))


_STATS = f"""WITH {_E}, {_RAW.format(x='value', t='e')}, {_RARE.format(f='kind', t='e')},
a AS (SELECT arr, sum(CAST({_ERR} AS INT)) AS errors, sum(CAST(odd AS INT)) AS anomalies FROM (SELECT arr, item, {_anomaly('value')} OR {_anomaly('k')} AS odd FROM e) GROUP BY 1),
b AS (SELECT arr, any_value(n) AS n, count(DISTINCT kind) / count(*) AS ukind, count(DISTINCT item) / count(*) AS uitem, (count(DISTINCT value) / count(*) + count(DISTINCT k) / count(*)) / 2 AS unum, CAST(count(DISTINCT kind) = 1 AS INT) AS const FROM e GROUP BY 1),
c AS (SELECT arr, count(*) AS points FROM cp GROUP BY 1), r AS (SELECT DISTINCT arr FROM rare),
f AS (SELECT b.arr, n, coalesce(points, 0) AS points, v.view, CASE v.view WHEN 'all' THEN ukind WHEN 'kind' THEN ukind WHEN 'id_kind' THEN ukind ELSE uitem END AS tu, CASE WHEN v.view IN ('all', 'id_kind', 'id_item', 'id_plain') THEN 1 ELSE 0 END AS id, CASE v.view WHEN 'all' THEN unum ELSE 0 END AS nu,
 CASE WHEN v.view = 'id_plain' OR v.view = 'half' THEN 0 ELSE least(errors, 1) END + CASE WHEN v.view = 'all' THEN least(anomalies, 1) + least(coalesce(points, 0), 1) ELSE 0 END + CASE WHEN v.view IN ('all', 'kind', 'id_kind') AND r.arr IS NOT NULL THEN 1 ELSE 0 END AS signals
 FROM b JOIN a USING (arr) LEFT JOIN c USING (arr) LEFT JOIN r USING (arr), (SELECT unnest(['all', 'kind', 'id_kind', 'id_item', 'id_plain', 'half', 'half_errors']) AS view) v),
sg AS (SELECT arr, view, n, points, id = 1 AS has_id, id::DOUBLE AS iu, CASE WHEN view LIKE 'half%' THEN tu / 2 ELSE tu END AS tu, nu, signals FROM f),
h AS (SELECT *, CASE WHEN greatest(tu, nu) < 0.1 AND has_id THEN 1 WHEN greatest(tu, iu) < 0.3 THEN 2 WHEN has_id AND greatest(tu, iu) > 0.8 AND signals = 0 THEN 3 WHEN greatest(tu, iu) > 0.8 AND signals > 0 THEN 4 WHEN signals = 0 THEN 5 ELSE 6 END AS c FROM sg)"""


def _views(spark, sf_dir) -> DataFrame:
    """Statistics of each user's events seen with different fields, so that every case of the decision occurs."""
    items = _events(spark, sf_dir)
    flags = items.withColumn("odd", is_anomaly("value") | is_anomaly("k"))
    base = flags.groupBy("arr").agg(
        F.max("n").alias("n"), F.sum(is_error().cast("int")).alias("errors"), F.sum(F.col("odd").cast("int")).alias("anomalies"),
        (F.countDistinct("kind") / F.count(F.lit(1))).alias("ukind"), (F.countDistinct("item") / F.count(F.lit(1))).alias("uitem"),
        ((F.countDistinct("value") / F.count(F.lit(1)) + F.countDistinct("k") / F.count(F.lit(1))) / 2).alias("unum"),
    )
    points = change_points(items, "value").groupBy("arr").agg(F.count(F.lit(1)).alias("points"))
    rare = rare_values(items, "kind").select("arr", F.lit(1).alias("rare")).distinct()
    rows = base.join(points, "arr", "left").join(rare, "arr", "left").na.fill(0, ["points", "rare"])
    view = F.col("view")
    rows = rows.withColumn("view", F.explode(F.array(*map(F.lit, ["all", "kind", "id_kind", "id_item", "id_plain", "half", "half_errors"]))))
    seen = lambda *names: view.isin(*names)
    text = F.when(seen("all", "kind", "id_kind"), F.col("ukind")).otherwise(F.col("uitem"))
    one = lambda c: F.least(F.col(c), F.lit(1))
    return rows.select(
        "arr", "view", "n", "points", seen("all", "id_kind", "id_item", "id_plain").alias("has_id"), seen("all", "id_kind", "id_item", "id_plain").cast("double").alias("id_unique"),
        F.when(view.startswith("half"), text / 2).otherwise(text).alias("text_unique"), F.when(seen("all"), F.col("unum")).otherwise(0.0).alias("number_unique"),
        (
            F.when(seen("id_plain", "half"), 0).otherwise(one("errors")) + F.when(seen("all"), one("anomalies") + one("points")).otherwise(0)
            + F.when(seen("all", "kind", "id_kind"), F.col("rare")).otherwise(0)
        ).alias("signals"),
    )


@query(_STATS + " SELECT arr AS user_id, view, c NOT IN (3, 5) AS crushable, list_element([0.85, 0.9, 0.85, 0.7, 0.6, 0.5], c)::DOUBLE AS confidence, list_element(['repetitive_content_with_ids', 'low_uniqueness_safe_to_sample', 'unique_entities_no_signal', 'unique_entities_with_signal', 'medium_uniqueness_no_signal', 'medium_uniqueness_with_signal'], c) AS reason FROM h")
def a13_crushability(spark, sf_dir):
    """Whether each array may be sampled, how surely, and why."""
    can, sure, why = crushable()
    return _views(spark, sf_dir).select(F.col("arr").alias("user_id"), "view", can.alias("crushable"), sure.alias("confidence"), why.alias("reason"))


_PATTERN = "CASE view WHEN 'all' THEN 'time_series' WHEN 'id_item' THEN 'search_results' WHEN 'kind' THEN 'logs' ELSE 'generic' END"


@query(_STATS + f", k AS (SELECT arr, view, CASE WHEN n < 5 THEN 'none' WHEN c IN (3, 5) THEN 'skip' WHEN view = 'all' AND points > 0 THEN 'time_series' WHEN view = 'kind' AND tu < 0.5 THEN 'cluster_sample' WHEN view = 'id_item' THEN 'top_n' ELSE 'smart_sample' END AS strategy FROM h) SELECT arr AS user_id, view, strategy, round(CASE strategy WHEN 'none' THEN 0 WHEN 'time_series' THEN 0.7 WHEN 'cluster_sample' THEN 0.8 WHEN 'top_n' THEN 0.6 WHEN 'smart_sample' THEN 0.5 ELSE 0.3 END + CASE WHEN view = 'all' THEN 0.1 ELSE 0 END, 4)::DOUBLE AS reduction FROM k")
def a14_strategies(spark, sf_dir):
    """The strategy for each array, and the reduction to expect; half of the fields of view `all` count as constant."""
    can, _, _ = crushable()
    view = F.col("view")
    kind = F.when(view == "all", "time_series").when(view == "id_item", "search_results").when(view == "kind", "logs").otherwise("generic")
    rows = _views(spark, sf_dir).withColumn("strategy", strategy(kind, F.col("n"), can, F.col("points"), F.col("text_unique")))
    return rows.select(F.col("arr").alias("user_id"), "view", "strategy", F.round(reduction(F.col("strategy"), F.when(view == "all", 0.5).otherwise(0.0)), 4).alias("reduction"))


def _anchor_sql(limit, front, back):
    slots = f"least(greatest(3, {int(limit * 0.25)}), 12, n)"
    f, b0 = f"greatest(1, floor({slots} * {front}::DOUBLE)::BIGINT)", f"greatest(1, floor({slots} * {back}::DOUBLE)::BIGINT)"
    return f"""(SELECT *, n <= {limit} OR (CASE WHEN f >= fe THEN idx < fe ELSE list_contains(list_transform(range(1, f + 1), lambda i: least(floor(i * (fe / (f + 1)))::BIGINT, fe - 1)), idx) END) OR (CASE WHEN b >= n - bs THEN idx >= bs ELSE list_contains(list_transform(range(1, b + 1), lambda i: least(bs + floor(i * ((n - bs) / (b + 1)))::BIGINT, n - 1)), idx) END) AS anchor FROM (SELECT *, least(f * 2, n // 3) AS fe, greatest(n - b * 2, 2 * n // 3) AS bs FROM (SELECT *, CASE WHEN f + b0 > slots THEN greatest(1, slots - f) ELSE b0 END AS b FROM (SELECT *, {slots} AS slots, {f} AS f, {b0} AS b0 FROM {{t}}))))"""


@query(f"WITH {_E}, {_L} SELECT 'events' AS source, arr, idx FROM {_anchor_sql(15, 0.45, 0.45).format(t='e')} WHERE anchor UNION ALL SELECT 'lines', arr, idx FROM {_anchor_sql(40, 0.75, 0.15).format(t='l')} WHERE anchor")
def a20_anchors(spark, sf_dir):
    """Front and back anchors: balanced for time series, front-heavy for ranked lines."""
    parts = [(_events(spark, sf_dir), "events", 15, 0.45, 0.45), (_lines(spark, sf_dir), "lines", 40, 0.75, 0.15)]
    out = [items.where(anchors(F.col("n"), limit, f, b, F.col("idx"))).select(F.lit(s).alias("source"), "arr", "idx") for items, s, limit, f, b in parts]
    return out[0].unionByName(out[1])


@query(f"WITH {_E} SELECT arr AS user_id, idx, round(0.4::DOUBLE * ((1 - count(*) OVER (PARTITION BY arr, kind) / n) + (1 - count(*) OVER (PARTITION BY arr, k) / n)) / 2 + 0.3::DOUBLE * CASE WHEN max(length(item)) OVER (PARTITION BY arr) = min(length(item)) OVER (PARTITION BY arr) THEN 0.5 ELSE (length(item) - min(length(item)) OVER (PARTITION BY arr)) / (max(length(item)) OVER (PARTITION BY arr) - min(length(item)) OVER (PARTITION BY arr)) END, 6) AS information FROM e")
def a22_information(spark, sf_dir):
    """Information score of each event among its user's."""
    return information(_events(spark, sf_dir), ["kind", "k"]).select(F.col("arr").alias("user_id"), "idx", F.round("information", 6).alias("information"))


def _prioritize_sql(t, limit):
    return f"""(SELECT arr, idx, CASE WHEN m <= {limit} THEN kept OR (fresh AND turn <= {limit} - m) ELSE grp < 9 AND (critical OR row_number() OVER (PARTITION BY arr ORDER BY grp, idx) <= {limit}) END AS final FROM (
SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY arr, fresh ORDER BY visit, c) END AS turn, CASE WHEN critical THEN 0 WHEN idx < 3 THEN 1 WHEN idx >= n - 2 THEN 2 WHEN kept THEN 3 ELSE 9 END AS grp FROM (
SELECT *, NOT kept AND NOT seen AND row_number() OVER (PARTITION BY arr, item, kept ORDER BY visit, c) = 1 AS fresh FROM (
SELECT *, c % greatest(1, (n - m) // nullif({limit} - m + 1, 0)) AS visit FROM (
SELECT *, CASE WHEN NOT kept THEN row_number() OVER (PARTITION BY arr, kept ORDER BY idx) - 1 END AS c FROM (
SELECT *, count(*) FILTER (kept) OVER (PARTITION BY arr) AS m, bool_or(kept) OVER (PARTITION BY arr, item) AS seen FROM (
SELECT *, keep AND row_number() OVER (PARTITION BY arr, item, keep ORDER BY idx) = 1 AS kept FROM {t})))))))"""


def _plan_flags(spark, sf_dir, reach: int) -> DataFrame:
    """Events with `critical` (errors, rare statuses, anomalies) and `near` (a change point)."""
    items = _events(spark, sf_dir)
    rare = rare_values(items, "kind").select("arr", F.col("value").alias("kind"), F.lit(True).alias("rare"))
    near = change_points(items, "value").select("arr", F.explode(F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("idx")).distinct().withColumn("near", F.lit(True))
    odd = is_error() | is_anomaly("value") | is_anomaly("k")
    rows = items.withColumn("odd", odd).join(rare, ["arr", "kind"], "left").join(near, ["arr", "idx"], "left")
    return rows.na.fill(False, ["rare", "near"]).withColumn("critical", F.col("odd") | F.col("rare")).drop("odd", "rare")


def _flag_sql(reach, keep, limit, front, back):
    return f"""WITH {_E}, {_RAW.format(x='value', t='e')}, {_RARE.format(f='kind', t='e')}, near AS (SELECT DISTINCT arr, idx + d AS idx, true AS near FROM cp, (SELECT unnest(range(-{reach}, {reach} + 1)) AS d)),
x AS (SELECT e.*, coalesce(near, false) AS near, odd OR v IS NOT NULL AS critical FROM (SELECT *, {_ERR} OR {_anomaly('value')} OR {_anomaly('k')} AS odd FROM e) e LEFT JOIN rare ON e.arr = rare.arr AND kind = v LEFT JOIN near ON e.arr = near.arr AND e.idx = near.idx),
y AS (SELECT *, {keep} AS keep FROM {_anchor_sql(limit, front, back).format(t='x')}) SELECT arr AS user_id, idx FROM {_prioritize_sql('y', limit)} WHERE final"""


@query(_flag_sql(1, "anchor OR critical OR near", 15, 0.5, 0.4))
def a16_smart_sample(spark, sf_dir):
    """Items that a smart sample of 15 keeps: anchors, errors, outliers, anomalies, change points and their neighbours."""
    rows = _plan_flags(spark, sf_dir, 1)
    rows = rows.withColumn("keep", anchors(F.col("n"), 15, 0.5, 0.4, F.col("idx")) | F.col("critical") | F.col("near"))
    return prioritize(rows, 15).where("final").select(F.col("arr").alias("user_id"), "idx")


@query(_flag_sql(2, "anchor OR critical OR near", 40, 0.45, 0.45))
def a19_time_series_sample(spark, sf_dir):
    """Items that a time-series plan of 40 keeps: change points with two neighbours, anchors, errors and outliers."""
    rows = _plan_flags(spark, sf_dir, 2)
    rows = rows.withColumn("keep", anchors(F.col("n"), 40, 0.45, 0.45, F.col("idx")) | F.col("critical") | F.col("near"))
    return prioritize(rows, 40).where("final").select(F.col("arr").alias("user_id"), "idx")


@query(f"WITH {_L}, y AS (SELECT *, anchor AS keep, false AS critical FROM {_anchor_sql(40, 0.5, 0.4).format(t='l')}) SELECT arr AS l_suppkey, idx FROM {_prioritize_sql('y', 40)} WHERE final")
def a21_prioritized(spark, sf_dir):
    """A budget of 40 over a supplier's lines: anchors first, then strides over texts that are not yet seen."""
    rows = _lines(spark, sf_dir).withColumn("keep", anchors(F.col("n"), 40, 0.5, 0.4, F.col("idx"))).withColumn("critical", F.lit(False))
    return prioritize(rows, 40).where("final").select(F.col("arr").alias("l_suppkey"), "idx")


@query(f"WITH {_RANKED.replace('l_quantity AS quantity', 'l_quantity AS quantity, l_returnflag AS flag')}, t AS (SELECT *, row_number() OVER (PARTITION BY arr ORDER BY quantity DESC, idx) AS r FROM s) SELECT arr AS l_suppkey, idx FROM t WHERE r <= 12 OR quantity = 50 AND price > 90000")
def a17_top_n(spark, sf_dir):
    """A top-n plan of 15: the 12 highest scores, and every item that must stay."""
    items = arrays(read(spark, sf_dir, "lineitem").withColumn("down", -F.col("l_discount")), "l_suppkey", ["down", "l_orderkey", "l_linenumber", "l_partkey"], F.lit(""), quantity=F.col("l_quantity"), price=F.col("l_extendedprice"))
    return top_n(items, "quantity", 15, (F.col("quantity") == 50) & (F.col("price") > 90000)).select(F.col("arr").alias("l_suppkey"), "idx")


def top_n(items: DataFrame, score: str, limit: int, must: Column) -> DataFrame:
    """The limit - 3 items of the highest score, ties in order, and all that must stay, in array order."""
    rank = F.row_number().over(_by().orderBy(F.desc(score), "idx"))
    return items.withColumn("rank", rank).where((F.col("rank") <= limit - 3) | must).drop("rank")


@query("WITH t AS (SELECT conv_id AS arr, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS idx, role, text FROM conversations), c AS (SELECT role, idx, left(md5(left(text, 50)), 8) AS cluster FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY role, cluster ORDER BY idx) AS r FROM c) SELECT role, idx, cluster FROM r WHERE r <= 2")
def a18_cluster_sample(spark, sf_dir):
    """The first two messages of each cluster of equal beginnings, among all of a role."""
    items = arrays(read(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"], F.col("text"))
    return cluster_sample(items, F.col("item"), 2).select(F.col("arr").alias("role"), "idx", "cluster")


def cluster_sample(items: DataFrame, message: Column, keep: int) -> DataFrame:
    """The first `keep` items of each cluster: messages whose first 50 characters are equal."""
    rows = items.withColumn("cluster", F.substring(F.md5(F.substring(message, 1, 50)), 1, 8))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("arr", "cluster").orderBy("idx"))).where(F.col("r") <= keep).drop("r")


_GRAMS = "w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL), b AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) < 2 THEN [coalesce(w[1], '') || chr(1)] ELSE list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1]) END) AS g FROM w), f AS (SELECT conv_id, g, min(turn) AS turn FROM b GROUP BY ALL), c AS (SELECT w.conv_id, w.turn, count(g) AS c FROM w LEFT JOIN f ON w.conv_id = f.conv_id AND w.turn = f.turn GROUP BY ALL), curve AS (SELECT conv_id, turn, row_number() OVER o - 1 AS k, sum(c) OVER o AS seen FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"


def bigram_curve(items: DataFrame, text: str) -> DataFrame:
    """(arr, idx, seen): distinct word pairs in the items up to each one."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda x: x != "")
    pairs = F.when(F.size("w") < 2, F.array(F.concat(F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.lit("\x01")))).otherwise(
        F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit("\x01"), b))
    )
    rows = items.where(F.col(text).isNotNull()).withColumn("w", words)
    first = rows.select("arr", "idx", F.explode(pairs).alias("g")).groupBy("arr", "g").agg(F.min("idx").alias("idx")).groupBy("arr", "idx").agg(F.count(F.lit(1)).alias("c"))
    return rows.join(first, ["arr", "idx"], "left").select("arr", "idx", F.sum(F.coalesce("c", F.lit(0))).over(_in_order()).alias("seen"))


def knee(curve: DataFrame) -> DataFrame:
    """(arr, n, knee) of curves: the place of the greatest height over the diagonal, 1 if flat, null if none or under 3 points."""
    rows = curve.select("arr", "seen", (F.row_number().over(_in_order()) - 1).alias("k"), F.count(F.lit(1)).over(_by()).alias("n"), F.min("seen").over(_by()).alias("low"), F.max("seen").over(_by()).alias("high"))
    above = F.round(F.try_divide(F.col("seen") - F.col("low"), F.col("high") - F.col("low")) - F.try_divide("k", F.col("n") - 1), 9)
    best = rows.groupBy("arr").agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), F.max(F.struct(above.alias("d"), (-F.col("k")).alias("at"))).alias("top"))
    found = F.when(F.col("n") < 3, None).when(F.col("high") == F.col("low"), 1).when(F.col("top.d") >= 0.05, 1 - F.col("top.at"))
    return best.select("arr", "n", found.cast("long").alias("knee"))


@query(f"WITH {_GRAMS} SELECT conv_id, turn, seen::BIGINT AS seen FROM curve")
def a25_bigram_curve(spark, sf_dir):
    """Distinct word pairs of a conversation up to each of its turns."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("arr"), F.col("turn").alias("idx"), "text")
    return bigram_curve(turns, "text").select(F.col("arr").alias("conv_id"), F.col("idx").alias("turn"), "seen")


@query(f"WITH {_GRAMS}, d AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, min(seen) OVER (PARTITION BY conv_id) AS lo, max(seen) OVER (PARTITION BY conv_id) AS hi FROM curve), x AS (SELECT *, CASE WHEN hi > lo AND n > 1 THEN round((seen - lo) / (hi - lo) - k / (n - 1), 9) END AS h FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY h DESC, k) AS r FROM x) SELECT conv_id, n, CASE WHEN n < 3 THEN NULL WHEN hi = lo THEN 1 WHEN h >= 0.05 THEN k + 1 END::BIGINT AS knee FROM r WHERE r = 1")
def a24_knee(spark, sf_dir):
    """Where the word pairs of each conversation begin to saturate."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("arr"), F.col("turn").alias("idx"), "text")
    return knee(bigram_curve(turns, "text")).withColumnRenamed("arr", "conv_id")


@query("SELECT n AS k, greatest(1, round_even(n * 0.3::DOUBLE, 0))::BIGINT AS first, least(greatest(1, round_even(n * 0.15::DOUBLE, 0)), greatest(0, n - greatest(1, round_even(n * 0.3::DOUBLE, 0))))::BIGINT AS last FROM (SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey)")
def a27_k_split(spark, sf_dir):
    """How a budget of k splits into first and last items; halves go to even."""
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).select("k").distinct()
    first = F.greatest(F.lit(1), F.bround(F.col("k") * 0.3, 0)).cast("long")
    last = F.least(F.greatest(F.lit(1), F.bround(F.col("k") * 0.15, 0)), F.greatest(F.lit(0), F.col("k") - first)).cast("long")
    return counts.select("k", first.alias("first"), last.alias("last"))


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, role FROM conversations), a AS (SELECT role AS arr, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS idx, count(*) OVER (PARTITION BY role) AS n, text AS item FROM t),
x AS (SELECT *, {_ERR} OR abs(length(item) - avg(length(item)) OVER (PARTITION BY arr)) > 2 * stddev_samp(length(item)) OVER (PARTITION BY arr) AS critical, idx < 6 OR idx >= n - 3 AS edge FROM a),
y AS (SELECT *, critical OR edge AS keep FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY arr, item ORDER BY keep DESC, idx) AS r, bool_or(keep) OVER (PARTITION BY arr, item) AS seen FROM y) SELECT arr AS role, idx FROM z WHERE keep OR (NOT seen AND r = 1 AND idx % 10 = 0)""")
def a28_string_crush(spark, sf_dir):
    """Of the texts of a role: errors, unusual lengths, the first six, the last three, and a stride of distinct others."""
    items = arrays(read(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"], F.coalesce("text", F.lit("")))
    return string_crush(items, 6, 3, 10).select(F.col("arr").alias("role"), "idx")


def string_crush(items: DataFrame, first: int, last: int, stride: int) -> DataFrame:
    size = F.length("item")
    unusual = F.abs(size - F.avg(size).over(_by())) > 2 * F.stddev_samp(size).over(_by())
    keep = is_error() | F.coalesce(unusual, F.lit(False)) | (F.col("idx") < first) | (F.col("idx") >= F.col("n") - last)
    rows = items.withColumn("keep", keep)
    same = Window.partitionBy("arr", "item")
    rows = rows.withColumn("r", F.row_number().over(same.orderBy(F.desc("keep"), "idx"))).withColumn("seen", F.max("keep").over(same))
    return rows.where(F.col("keep") | (~F.col("seen") & (F.col("r") == 1) & (F.col("idx") % stride == 0))).select("arr", "idx", "item")


@query(f"WITH {_E}, raw AS (SELECT arr, idx FROM (SELECT arr, idx, n, avg(value) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, stddev_samp(value) OVER (PARTITION BY arr) AS d FROM e WINDOW o AS (PARTITION BY arr ORDER BY idx)) WHERE n > 10 AND idx BETWEEN 5 AND n - 5 AND abs(a - b) > 2 * d) SELECT arr AS user_id, idx FROM (SELECT *, {_anomaly('value')} AS odd FROM e) e WHERE odd OR idx < 5 OR idx >= n - 3 OR idx % 8 = 0 OR EXISTS (SELECT 1 FROM raw WHERE raw.arr = e.arr AND raw.idx = e.idx)")
def a29_number_crush(spark, sf_dir):
    """Of each user's values: two-sigma outliers, change points, the first five, the last three, and every eighth."""
    items = _events(spark, sf_dir)
    x = F.col("value")
    before, after = F.avg(x).over(_in_order().rowsBetween(-5, -1)), F.avg(x).over(_in_order().rowsBetween(0, 4))
    point = (F.col("n") > 10) & F.col("idx").between(5, F.col("n") - 5) & (F.abs(after - before) > 2 * F.stddev_samp(x).over(_by()))
    kept = items.withColumn("keep", is_anomaly("value") | point | (F.col("idx") < 5) | (F.col("idx") >= F.col("n") - 3) | (F.col("idx") % 8 == 0))
    return kept.where("keep").select(F.col("arr").alias("user_id"), "idx")


@query("WITH p AS (SELECT p_partkey, unnest([{'pos': 1, 'key': 'p_name', 'value': p_name}, {'pos': 2, 'key': 'p_brand', 'value': p_brand}, {'pos': 3, 'key': 'p_type', 'value': p_type}, {'pos': 4, 'key': 'p_size', 'value': CAST(p_size AS VARCHAR)}, {'pos': 5, 'key': 'note', 'value': repeat(p_name || ' ', 12)}, {'pos': 6, 'key': 'status', 'value': CASE WHEN p_size % 10 = 0 THEN repeat('check failed ', 8) ELSE repeat('all is fine ', 8) END}, {'pos': 7, 'key': 'tail', 'value': repeat(p_brand || ' ', 12)}]) AS f FROM part) SELECT p_partkey, f.key AS key FROM p WHERE length(f.value) // 4 <= 12 OR regexp_matches(lower(f.value), '" + "|".join(ERROR_KEYWORDS) + "') OR f.pos <= 2 OR f.pos > 6")
def a30_object_crush(spark, sf_dir):
    """Keys of an object that stay: small values (12 tokens or less), errors, the first two and the last one."""
    fields = {"p_name": F.col("p_name"), "p_brand": F.col("p_brand"), "p_type": F.col("p_type"), "p_size": F.col("p_size").cast("string"), "note": F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12))}
    fields["status"] = F.when(F.col("p_size") % 10 == 0, F.repeat(F.lit("check failed "), F.lit(8))).otherwise(F.repeat(F.lit("all is fine "), F.lit(8)))
    fields["tail"] = F.repeat(F.concat("p_brand", F.lit(" ")), F.lit(12))
    keep = object_crush(fields, 2, 1)
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(keep).alias("key"))


def object_crush(fields: dict[str, Column], first: int, last: int) -> Column:
    """The names of the fields of an object that stay, in order."""
    n = len(fields)
    keep = [
        F.when((F.floor(F.length(c) / 4) <= 12) | F.lower(c).rlike("|".join(ERROR_KEYWORDS)) | F.lit(k < first or k >= n - last), F.lit(name))
        for k, (name, c) in enumerate(fields.items())
    ]
    return F.array_compact(F.array(*keep))


@query(f"WITH {_E}, t AS (SELECT arr, idx, CASE WHEN k IN (1, 2) THEN 'bool' WHEN k % 3 = 0 THEN 'number' ELSE 'string' END AS type FROM e), c AS (SELECT *, count(*) OVER (PARTITION BY arr, type) AS c, row_number() OVER (PARTITION BY arr, type ORDER BY idx) AS r FROM t) SELECT arr AS user_id, idx, type FROM c WHERE c < 5 OR r <= 3 OR r > c - 2")
def a31_mixed_crush(spark, sf_dir):
    """A mixed array by type: groups under five stay whole, of the others the first three and the last two, in array order."""
    kind = F.when(F.col("k").isin(1, 2), "bool").when(F.col("k") % 3 == 0, "number").otherwise("string")
    w = Window.partitionBy("arr", "type")
    rows = _events(spark, sf_dir).withColumn("type", kind).withColumn("c", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("idx")))
    return rows.where("c < 5 or r <= 3 or r > c - 2").select(F.col("arr").alias("user_id"), "idx", "type")


@query(f"WITH {_L}, y AS (SELECT *, anchor AS keep, false AS critical FROM {_anchor_sql(40, 0.5, 0.4).format(t='l')}), k AS (SELECT arr, idx FROM {_prioritize_sql('y', 40)} WHERE final) SELECT l.arr AS l_suppkey, string_agg(item, chr(10) ORDER BY l.idx) || chr(10) || '<<ccr:' || left(max(h), 12) || ' ' || (max(n) - count(*)) || '_rows_offloaded>>' AS text FROM l JOIN k ON l.arr = k.arr AND l.idx = k.idx JOIN (SELECT arr, sha256(string_agg(item, chr(10) ORDER BY idx)) AS h FROM l GROUP BY 1) o ON o.arr = l.arr GROUP BY 1")
def a32_crushed_arrays(spark, sf_dir):
    """A supplier's lines crushed to 40: the kept items in order, and a marker with the hash of the whole."""
    items = _lines(spark, sf_dir)
    rows = items.withColumn("keep", anchors(F.col("n"), 40, 0.5, 0.4, F.col("idx"))).withColumn("critical", F.lit(False))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda s: s["item"]), "\n")
    whole = items.groupBy("arr").agg(F.sha2(text("item"), 256).alias("h"))
    kept = prioritize(rows, 40).where("final").groupBy("arr").agg(text("item").alias("body"), F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    return kept.join(whole, "arr").select(F.col("arr").alias("l_suppkey"), F.format_string("%s\n<<ccr:%s %d_rows_offloaded>>", "body", F.substring("h", 1, 12), F.col("n") - F.col("m")).alias("text"))


@query("SELECT name, left(sha256(name), 8) AS hash FROM (SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS name)")
def a36_field_hashes(spark, sf_dir):
    """Names of fields as short hashes."""
    return read(spark, sf_dir, "part").limit(0).select(F.lit("").alias("name")).unionByName(spark.createDataFrame([("p_name",), ("p_brand",), ("p_type",), ("p_size",)], "name string")).select("name", F.substring(F.sha2("name", 256), 1, 8).alias("hash"))


QUERIES, ORACLES = query.queries, query.oracles
