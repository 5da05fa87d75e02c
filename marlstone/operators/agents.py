"""Agent traffic: classes of tool calls, schedules, routing by complexity, learned rules and field meanings, output trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.operators.dedup import calls, similar_pairs, words
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

#: Tool names by class, with compressibility and value.
CLASSES = {"listing": (["ls", "glob", "list_dir"], 0.9, 0.2), "search": (["grep", "search"], 0.8, 0.5), "read": (["read", "cat"], 0.3, 0.8), "edit": (["edit", "write"], 0.1, 0.9), "test": (["pytest", "test"], 0.85, 0.7)}
FILLER = ["(?i)^(sure|certainly|of course|okay)[,.!]?\\s+", "(?i)^(let me|i will|i'll)\\b[^.!?\n]*[.!?]\\s*"]
META = "(?m)^(?:Note: |As an assistant).*\n?"


def classify(tool: Column) -> tuple[Column, Column, Column]:
    """(class, compressibility, value) of a tool; unknown tools are in the middle."""
    kind, squeeze, value = F.lit("other"), F.lit(0.5), F.lit(0.5)
    for name, (tools, c, v) in CLASSES.items():
        hit = F.lower(tool).isin(tools)
        kind, squeeze, value = F.when(hit, name).otherwise(kind), F.when(hit, c).otherwise(squeeze), F.when(hit, v).otherwise(value)
    return kind, squeeze, value


def trimmed_output(text: Column, most: int = 5) -> Column:
    """Output without leading filler, notes on itself, repeated paragraphs, and the tails of long code blocks."""
    for p in FILLER:
        text = F.trim(F.regexp_replace(text, p, ""))
    text = F.regexp_replace(text, META, "")
    parts = F.split(text, "\n\n")
    kept = F.filter(parts, lambda p, i: (F.trim(p) == "") | ~F.exists(F.slice(F.transform(parts, lambda q: F.trim(q)), F.lit(1), i), lambda q: q == F.trim(p)))
    return F.regexp_replace(F.array_join(kept, "\n\n"), f"(?s)(```[^\n]*\n(?:[^\n]*\n){{{most}}})(?:(?!```)[^\n]*\n)+```", "$1...\n```")


def complexity(messages: Column, tools: Column, code: Column, chars: Column, weights=(0.25, 0.25, 0.3, 0.2)) -> Column:
    """0 to 1: messages of 20, tools of 10, code, and characters of 20,000."""
    one = F.lit(1.0)
    a, b, c, d = weights
    return F.greatest(F.lit(0.0), F.least(one, F.least(messages / 20, one) * a + F.least(tools / 10, one) * b + code.cast("double") * c + F.least(chars / 20_000, one) * d))


def field_meaning() -> tuple[Column, Column]:
    """(type, confidence) of a field from retrievals, compressions, unique, equals, ranges, contains, top, misses, diversity.

    A dominant value keeps the later cases from being tried.
    """
    u, e, r, c = F.col("unique"), F.col("equals"), F.col("ranges"), F.col("contains")
    top, miss, div = F.col("top"), F.col("misses"), F.col("diversity")
    cases = [
        ((u > 0.8) & (e > 0.7), "identifier", F.least(F.lit(0.9), u * e)), ((top > 0.7) & (miss > 0.7), "error_indicator", F.least(F.lit(0.9), miss * top)), (top > 0.7, "unknown", F.lit(0.0)),
        ((u < 0.2) & (div < 0.5), "status", F.least(F.lit(0.85), (1 - u) * (1 - div))), (r > 0.5, "score", F.least(F.lit(0.85), r)),
        ((r > 0.3) & (u > 0.7), "temporal", F.least(F.lit(0.8), r * u)), (c > 0.5, "content", F.least(F.lit(0.85), c)),
    ]
    kind = sure = F.when((F.col("retrievals") < 3) | (F.col("compressions") < 2), F.lit(None))
    for test, name, confidence in cases:
        kind, sure = kind.when(test, F.lit(name)), sure.when(test, confidence)
    sure = F.coalesce(sure, F.lit(0.0))
    return F.when(sure < 0.3, "unknown").otherwise(F.coalesce(kind, F.lit("unknown"))), F.when(sure < 0.3, 0.0).otherwise(sure)


_TOOLS = ["ls", "Grep", "read", "edit", "pytest", "curl"]
_TOOL = "list_element(['ls', 'Grep', 'read', 'edit', 'pytest', 'curl'], CAST(event_id % 6 + 1 AS INT))"
_CLASS = "CASE " + " ".join(f"WHEN lower(tool) IN ({', '.join(repr(t) for t in tools)}) THEN {{{i}}}" for i, (tools, _, _) in enumerate(CLASSES.values())) + " ELSE {5} END"


def _class_sql(part):
    values = [repr(k) if part == 0 else v[part] for k, v in CLASSES.items()]
    return _CLASS.format(*values, "'other'" if part == 0 else 0.5)


def _tool():
    return F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % 6 + 1).cast("int"))


@query(f"WITH t AS (SELECT event_id, {_TOOL} AS tool FROM events) SELECT event_id, {_class_sql(0)} AS class, round(({_class_sql(1)}) * (1 - ({_class_sql(2)})), 6)::DOUBLE AS priority FROM t")
def x24_tool_classes(spark, sf_dir):
    """The class of each call, and how early to compress its result."""
    kind, squeeze, value = classify(_tool())
    return read(spark, sf_dir, "events").select("event_id", kind.alias("class"), F.round(squeeze * (1 - value), 6).alias("priority"))


@query(f"WITH t AS (SELECT event_id, {_TOOL} AS tool, value / 490.02 AS pressure, CASE WHEN event_id % 10 < 3 THEN 'explore' WHEN event_id % 10 < 8 THEN 'work' ELSE 'verify' END AS phase FROM events), c AS (SELECT *, {_class_sql(0)} AS class FROM t) SELECT phase, class, CASE WHEN pressure < 0.3 THEN 'lossless' WHEN pressure < 0.7 THEN 'lossy' ELSE 'aggressive' END AS level, CASE class WHEN 'listing' THEN 'smart_crusher' WHEN 'search' THEN 'search' WHEN 'read' THEN 'session_dedup' WHEN 'edit' THEN 'none' WHEN 'test' THEN 'log' ELSE CASE phase WHEN 'explore' THEN 'smart_crusher' ELSE 'text' END END AS transform, count(*) AS n FROM c GROUP BY ALL")
def t50_schedule(spark, sf_dir):
    """The transform and level for results by phase, class and pressure."""
    kind, _, _ = classify(_tool())
    i, p = F.col("event_id") % 10, F.col("value") / 490.02
    rows = read(spark, sf_dir, "events").select(F.when(i < 3, "explore").when(i < 8, "work").otherwise("verify").alias("phase"), kind.alias("class"), F.when(p < 0.3, "lossless").when(p < 0.7, "lossy").otherwise("aggressive").alias("level"))
    route = F.when(F.col("phase") == "explore", "smart_crusher").otherwise("text")
    for name, transform in (("listing", "smart_crusher"), ("search", "search"), ("read", "session_dedup"), ("edit", "none"), ("test", "log")):
        route = F.when(F.col("class") == name, transform).otherwise(route)
    return rows.groupBy("phase", "class", "level", route.alias("transform")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT doc_id, 'Sure, Let me look at it. ' || coalesce(left(text, 60), '') || chr(10) || chr(10) || 'same' || chr(10) || chr(10) || 'same' || chr(10) || chr(10) || 'Note: this is a note' || chr(10) || 'end' AS t FROM documents), a AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(t, '(?i)^(sure|certainly|of course|okay)[,.!]?\\s+', '')), '(?i)^(let me|i will|i''ll)\\b[^.!?\\n]*[.!?]\\s*', '')) AS t FROM t), b AS (SELECT doc_id, regexp_replace(t, '(?m)^(?:Note: |As an assistant).*\\n?', '', 'g') AS t FROM a), p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS l FROM b)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(p, ' ') ORDER BY i) AS r FROM p) SELECT doc_id, md5(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (r = 1 OR trim(p, ' ') = '')) AS text_md5 FROM r GROUP BY 1")
def t26_trimmed_outputs(spark, sf_dir):
    """Outputs without filler, notes and repeated paragraphs, as digests."""
    t = F.concat(F.lit("Sure, Let me look at it. "), F.coalesce(F.substring("text", 1, 60), F.lit("")), F.lit("\n\nsame\n\nsame\n\nNote: this is a note\nend"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(trimmed_output(t)).alias("text_md5"))


@query("WITH m AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN '[compress:' || left(sha256(lag(text) OVER w), 8) || ':done]' END AS mark, left(sha256(text), 8) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), k AS (SELECT conv_id, regexp_extract(mark, '\\[compress:([0-9a-f]+):([^\\]]*)\\]', 1) AS h, regexp_extract(mark, '\\[compress:([0-9a-f]+):([^\\]]*)\\]', 2) AS note, turn FROM m WHERE mark IS NOT NULL) SELECT m.conv_id, m.turn, max(k.note) AS replaced_by FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.h = m.h AND k.turn > m.turn GROUP BY ALL")
def t35_self_compression(spark, sf_dir):
    """Messages that a later marker of their conversation replaces by a summary."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 8)
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", short(F.col("text")).alias("h"), F.when(F.col("turn") % 3 == 2, F.concat(F.lit("[compress:"), short(F.lag("text").over(w)), F.lit(":done]"))).alias("mark"))
    pattern = r"\[compress:([0-9a-f]+):([^\]]*)\]"
    k = m.where("mark is not null").select("conv_id", F.regexp_extract("mark", pattern, 1).alias("h"), F.regexp_extract("mark", pattern, 2).alias("note"), F.col("turn").alias("at"))
    hits = m.join(k, ["conv_id", "h"], "left").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("at") > F.col("turn"), F.col("note"))).alias("replaced_by"))
    return hits


@query("WITH c AS (SELECT conv_id, count(*) AS n, conv_id % 12 AS tools, bool_or(contains(text, 'def ') OR conv_id % 4 = 0) AS code, sum(length(text)) AS chars FROM conversations GROUP BY 1), s AS (SELECT conv_id, least(n / 20, 1) * 0.25::DOUBLE + least(tools / 10, 1) * 0.25::DOUBLE + code::INT * 0.3::DOUBLE + least(chars / 20000, 1) * 0.2::DOUBLE AS s FROM c) SELECT conv_id, round(s, 6) AS complexity, CASE WHEN s < 0.25 THEN 'small' WHEN s < 0.5 THEN 'medium' ELSE 'large' END AS model FROM s")
def t48_model_routes(spark, sf_dir):
    """The model for each conversation by its complexity."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("text").contains("def ") | (F.col("conv_id") % 4 == 0)).alias("code"), F.sum(F.length("text")).alias("chars"))
    s = complexity(F.col("n"), F.col("conv_id") % 12, F.col("code"), F.col("chars"))
    return c.select("conv_id", F.round(s, 6).alias("complexity"), F.when(s < 0.25, "small").when(s < 0.5, "medium").otherwise("large").alias("model"))


@query("WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), s AS (SELECT doc_id, i, list_distinct(list_filter(string_split_regex(lower(t), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS s FROM p), q AS (SELECT a.doc_id, a.i AS a, b.i AS b, len(list_intersect(a.s, b.s)) AS n, len(a.s) + len(b.s) AS m FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.i < b.i WHERE len(a.s) > 0 AND len(b.s) > 0) SELECT doc_id, a::INT AS a, b::INT AS b FROM q WHERE n / (m - n) > 0.8")
def dd5_similar_paragraphs(spark, sf_dir):
    """Paragraphs of a text that are similar to an earlier one."""
    p = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    sets = p.select(F.col("doc_id").alias("group"), (F.col("i") + 1).alias("id"), words(F.col("t")).alias("s")).where(F.size("s") > 0)
    return similar_pairs(sets, 0.8).select(F.col("group").alias("doc_id"), "a", "b")


_FIELDS = "f AS (SELECT l_suppkey AS field, count(*) AS retrievals, count(DISTINCT l_orderkey) AS compressions, count(DISTINCT l_partkey) / count(*) AS u0, avg((l_quantity < 25)::INT) AS e0, l_suppkey % 7 AS k FROM lineitem GROUP BY 1), g AS (SELECT field, CASE WHEN field % 11 = 0 THEN 2 ELSE retrievals END AS retrievals, compressions, CASE k WHEN 0 THEN u0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 WHEN 3 THEN 0.5 WHEN 4 THEN 0.75 ELSE 0.4 END AS unq, CASE k WHEN 0 THEN 0.5 + e0 / 2 ELSE 0.1 END AS eq, CASE k WHEN 3 THEN 0.6 WHEN 4 THEN 0.45 ELSE 0 END AS rng, CASE k WHEN 5 THEN 0.9 ELSE 0.1 END AS con, CASE k WHEN 1 THEN 0.8 WHEN 6 THEN 0.9 ELSE 0.3 END AS top, CASE k WHEN 1 THEN 0.9 ELSE 0.2 END AS mis, CASE k WHEN 2 THEN 0.3 ELSE 0.8 END AS div FROM f)"


@query(f"WITH {_FIELDS}, h AS (SELECT *, CASE WHEN retrievals < 3 OR compressions < 2 THEN 0 WHEN unq > 0.8 AND eq > 0.7 THEN 1 WHEN top > 0.7 AND mis > 0.7 THEN 2 WHEN top > 0.7 THEN 0 WHEN unq < 0.2 AND div < 0.5 THEN 3 WHEN rng > 0.5 THEN 4 WHEN rng > 0.3 AND unq > 0.7 THEN 5 WHEN con > 0.5 THEN 6 ELSE 0 END AS c FROM g), s AS (SELECT field, c, CASE c WHEN 1 THEN least(0.9, unq * eq) WHEN 2 THEN least(0.9, mis * top) WHEN 3 THEN least(0.85, (1 - unq) * (1 - div)) WHEN 4 THEN least(0.85, rng) WHEN 5 THEN least(0.8, rng * unq) WHEN 6 THEN least(0.85, con) ELSE 0 END AS s FROM h) SELECT field, CASE WHEN s < 0.3 THEN 'unknown' ELSE list_element(['identifier', 'error_indicator', 'status', 'score', 'temporal', 'content'], c) END AS type, round(CASE WHEN s < 0.3 THEN 0 ELSE s END, 6)::DOUBLE AS confidence FROM s")
def g26_field_meanings(spark, sf_dir):
    """What fields mean, by how they are asked for."""
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("compressions"), (F.countDistinct("l_partkey") / F.count(F.lit(1))).alias("u0"), F.avg((F.col("l_quantity") < 25).cast("double")).alias("e0"))
    k = F.col("field") % 7
    pick = lambda default, **v: F.coalesce(*[F.when(k == int(n[1:]), x) for n, x in v.items()], F.lit(default))
    f = f.select(
        "field", F.when(F.col("field") % 11 == 0, 2).otherwise(F.col("n")).alias("retrievals"), "compressions", pick(0.4, k0=F.col("u0"), k1=F.lit(0.5), k2=F.lit(0.1), k3=F.lit(0.5), k4=F.lit(0.75)).alias("unique"),
        pick(0.1, k0=0.5 + F.col("e0") / 2).alias("equals"), pick(0.0, k3=F.lit(0.6), k4=F.lit(0.45)).alias("ranges"), pick(0.1, k5=F.lit(0.9)).alias("contains"), pick(0.3, k1=F.lit(0.8), k6=F.lit(0.9)).alias("top"),
        pick(0.2, k1=F.lit(0.9)).alias("misses"), pick(0.8, k2=F.lit(0.3)).alias("diversity"),
    )
    kind, sure = field_meaning()
    return f.select("field", kind.alias("type"), F.round(sure, 6).alias("confidence"))


@query("WITH c AS (SELECT event_type AS signature, count(*) AS n, round(avg(value), 4) AS mean, round(avg((event_id % 4 = 0)::INT), 6) AS retrieval FROM events GROUP BY 1) SELECT signature, n, mean, retrieval, CASE WHEN n < 100 THEN 'collect' WHEN retrieval > 0.3 THEN 'keep_more' WHEN mean > 49 THEN 'watch' ELSE 'as_is' END AS advice FROM c")
def g20_collector_stats(spark, sf_dir):
    """Averages by signature, and advice from them."""
    c = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.avg((F.col("event_id") % 4 == 0).cast("double")), 6).alias("retrieval"))
    advice = F.when(F.col("n") < 100, "collect").when(F.col("retrieval") > 0.3, "keep_more").when(F.col("mean") > 49, "watch").otherwise("as_is")
    return c.withColumn("advice", advice)


@query("WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'I always prefer tabs. ' WHEN 1 THEN 'We use Python 3.13 here. ' WHEN 2 THEN 'Never push to main! ' ELSE '' END || coalesce(left(text, 40), '') AS t FROM conversations), r AS (SELECT CASE WHEN regexp_matches(t, '(?i)(^|[^a-z])(always|prefer|never)([^a-z]|$)') THEN 'preference' WHEN regexp_matches(t, '(?i)(^|[^a-z])(we use|running|version)([^a-z]|$)') THEN 'environment' END AS kind, regexp_extract(t, '^[^.!?]*[.!?]') AS rule FROM m), c AS (SELECT kind, trim(rule) AS rule, count(*) AS evidence FROM r WHERE kind IS NOT NULL AND rule <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY evidence DESC, rule) AS place FROM c) SELECT kind, rule, evidence FROM k WHERE place <= 5")
def m12_g41_learned_rules(spark, sf_dir):
    """Preferences and facts that messages state, by evidence, five of each kind at most."""
    n = F.col("turn") % 4
    t = F.concat(F.when(n == 0, "I always prefer tabs. ").when(n == 1, "We use Python 3.13 here. ").when(n == 2, "Never push to main! ").otherwise(""), F.coalesce(F.substring("text", 1, 40), F.lit("")))
    names = lambda w: F.col("t").rlike(f"(?i)(^|[^a-z])({w})([^a-z]|$)")
    r = read(spark, sf_dir, "conversations").select(t.alias("t")).select(F.when(names("always|prefer|never"), "preference").when(names("we use|running|version"), "environment").alias("kind"), F.trim(F.regexp_extract("t", "^[^.!?]*[.!?]", 0)).alias("rule"))
    c = r.where("kind is not null and rule <> ''").groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("evidence"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("evidence"), "rule"))).where("place <= 5").drop("place")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'gpt' WHEN conv_id % 3 = 1 THEN 'sonnet' ELSE 'other' END AS family, round(least(1.0::DOUBLE, length(text) / 4 / 4096.0), 6) AS budget_share, turn = 0 AS first_turn, round(ln(turn + 1), 6) AS log_turn FROM conversations")
def tf8_meta_features(spark, sf_dir):
    """Features of a message's model, size and place."""
    from marlstone.operators.requests import model_family

    c = F.col("conv_id") % 3
    model = F.when(c == 0, "gpt-large").when(c == 1, "sonnet-mid").otherwise("llm")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", model_family(model).alias("family"), F.round(F.least(F.lit(1.0), F.length("text") / 4 / 4096.0), 6).alias("budget_share"), (F.col("turn") == 0).alias("first_turn"), F.round(F.ln(F.col("turn") + 1), 6).alias("log_turn"))


def maturation(reads: DataFrame, after: int) -> DataFrame:
    """(session, reads, saved): sizes that would be saved if a file were kept from its `after`-th read on."""
    r = F.row_number().over(Window.partitionBy("session", "file").orderBy("pos"))
    rows = reads.withColumn("r", r)
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.when(F.col("r") > after, F.col("size")).otherwise(0)).alias("saved"))


@query("WITH c AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, try_cast(json_extract_string(props, '$.k') AS BIGINT) % 6 AS file, CAST(floor(value) AS INT) AS size, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY session, file ORDER BY pos) AS r FROM c WHERE event_type <> 'error') SELECT session, count(*) AS reads, sum(CASE WHEN r > 2 THEN size ELSE 0 END)::BIGINT AS saved FROM r GROUP BY 1")
def g31_maturation(spark, sf_dir):
    """What keeping files from their second read on would save in each session."""
    return maturation(calls(spark, sf_dir).where("tool <> 'error'"), 2)


QUERIES, ORACLES = query.queries, query.oracles
