"""Quality of compressed texts, features of texts, experiments, set operations; queries of the scalar functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.functions import budgets, text as T
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

# Signs of errors, and of structure.
ERROR_SIGNS = ["ERROR", "Error", "error", "FAILED", "Failed", "Exception", "Traceback", "FATAL", "panic", "stack trace", "at line", "exit code"]
STRUCTURE_SIGNS = ["{", "}", "[", "]", "def ", "class ", "function ", "import ", "# ", "## ", "### "]
LOG_SIGNS = ["ERROR", "FAILED", "Exception", "Traceback", "error:", "FATAL", "panic"]
TEXT_SIGNS = ["# ", "## ", "### ", "```", "---", "**"]


# --- operators -------------------------------------------------------------------------------------------------------


def rouge_l(reference: Column, candidate: Column, beta: float = 1.25) -> Column:
    """F measure of the longest common subsequence of whitespace tokens, by bit-parallel counting."""
    square = beta * beta

    # Made here, so that workers get it whole and import nothing of this package.
    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = (x or "").split(), (y or "").split()
            if not x or not y:
                out.append(0.0)
                continue
            places: dict[str, int] = {}
            for i, w in enumerate(x):
                places[w] = places.get(w, 0) | 1 << i
            full = (1 << len(x)) - 1
            row = full
            for w in y:
                hit = row & places.get(w, 0)
                row = ((row + hit) | (row - hit)) & full
            n = len(x) - row.bit_count()
            p, r = n / len(y), n / len(x)
            out.append((1 + square) * p * r / (square * p + r) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return score(reference, candidate)


def preserved(original: Column, compressed: Column, signs: list[str], count: bool) -> Column:
    """The share of the signs of the original, or of their number, that the compressed text has; 1 where it had none."""
    def total(t):
        if count:
            return sum((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s) for s in signs)
        return sum((t.contains(s).cast("int") for s in signs), F.lit(0))

    before = total(original)
    return F.when(before == 0, 1.0).otherwise(F.least(F.lit(1.0), total(compressed) / before))


def key_values(text: Column) -> Column:
    """UUIDs, hex digests and numbers of five digits or more."""
    patterns = ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "[0-9a-f]{32,64}", "[0-9]{5,}")
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(0)) for p in patterns])))


def survival(original: Column, compressed: Column) -> Column:
    """|A and B| / |A| of two arrays; 1 for an empty A."""
    return F.when(F.size(original) == 0, 1.0).otherwise(F.size(F.array_intersect(original, compressed)) / F.size(original))


def gate(original: Column, compressed: Column, kind: Column) -> Column:
    """The checks that a compressed text fails, in order: token_reduction, critical_markers, density."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    a, b = F.size(words(original)), F.size(words(compressed))
    saves = (b <= a) & ((a == 0) | ((1 - b / a) * 100 >= 5))
    share = F.when(kind == "log", preserved(original, compressed, LOG_SIGNS, False)).otherwise(preserved(original, compressed, TEXT_SIGNS, False))
    marks = share >= F.when(kind == "log", 1.0).otherwise(0.8)
    unique = lambda t, n: F.size(F.array_distinct(words(t))) / F.greatest(F.lit(1), n)
    dense = F.when(b == 0, False).when(a == 0, True).otherwise(unique(compressed, b) >= unique(original, a) * 0.5)
    return F.array_compact(F.array(F.when(~saves, F.lit("token_reduction")), F.when(~marks, F.lit("critical_markers")), F.when(~dense, F.lit("density"))))


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """(id, bleu) of (id, a, b) token arrays: clipped n-gram precisions, geometric mean of those that are not zero."""
    out = None
    for n in range(1, most + 1):
        def grams(c):
            return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))

        a = pairs.select("id", F.explode(grams("a")).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("ca"))
        b = pairs.select("id", F.explode(grams("b")).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("cb"))
        p = a.join(b, ["id", "g"], "left").groupBy("id").agg((F.sum(F.least("ca", F.coalesce("cb", F.lit(0)))) / F.sum("ca")).alias("p"))
        out = p if out is None else out.unionByName(p)
    score = out.groupBy("id").agg(F.avg(F.when(F.col("p") > 0, F.ln("p"))).alias("m"))
    return pairs.select("id").join(score, "id", "left").select("id", F.coalesce(F.exp("m"), F.lit(0.0)).alias("bleu"))


# --- queries -----------------------------------------------------------------------------------------------------------

_PAIR = "p AS (SELECT a.conv_id * 1000 + a.turn AS id, coalesce(a.text, '') AS a, coalesce(b.text, '') AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark, sf_dir):
    """Each message and the next one."""
    chat = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    after = chat.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return chat.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "a", "b")


@query(None)
def q1_q2_rouge(spark, sf_dir):
    """ROUGE-L of each message and the next one, with both weights."""
    return _pairs(spark, sf_dir).select("id", F.round(rouge_l(F.col("a"), F.col("b"), 1.25), 6).alias("rouge_125"), F.round(rouge_l(F.col("a"), F.col("b"), 1.0), 6).alias("rouge_1"))


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"


@query(f"WITH {_PAIR}, t AS (SELECT id, {_TOK.format('a')} AS a, {_TOK.format('b')} AS b FROM p), g AS (" + " UNION ALL ".join(f"SELECT id, {n} AS n, unnest(list_transform(range(1, greatest(len(a) - {n - 1}, 0) + 1), lambda i: array_to_string(a[i:i + {n - 1}], ' '))) AS g, 0 AS side FROM t UNION ALL SELECT id, {n}, unnest(list_transform(range(1, greatest(len(b) - {n - 1}, 0) + 1), lambda i: array_to_string(b[i:i + {n - 1}], ' '))), 1 FROM t" for n in range(1, 5)) + "), c AS (SELECT id, n, g, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM g GROUP BY ALL), q AS (SELECT id, n, sum(least(ca, cb)) / sum(ca) AS p FROM c GROUP BY ALL HAVING sum(ca) > 0), s AS (SELECT id, exp(avg(ln(p))) AS s FROM q WHERE p > 0 GROUP BY 1) SELECT id, round(coalesce(s, 0), 6)::DOUBLE AS bleu FROM t LEFT JOIN s USING (id)")
def q4_bleu(spark, sf_dir):
    """BLEU of each message against the next one."""
    pairs = _pairs(spark, sf_dir).select("id", T.word_tokens(F.col("a")).alias("a"), T.word_tokens(F.col("b")).alias("b"))
    return bleu(pairs).select("id", F.round("bleu", 6).alias("bleu"))


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(substr(coalesce(text, ''), 1, length(text) // 2)) AS h FROM documents), f AS (SELECT item_id, lower(left(text, 25)) AS fact FROM benchmark), m AS (SELECT doc_id, count(*) FILTER (contains(t, fact)) AS had, count(*) FILTER (contains(h, fact)) AS kept FROM d, f GROUP BY 1) SELECT doc_id, had, kept, CASE WHEN had = 0 THEN 1 ELSE round(kept / had, 6) END::DOUBLE AS recall FROM m")
def q5_information_recall(spark, sf_dir):
    """Which probe facts of a text its first half still holds. The probes are few and known: they are broadcast."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumn("h", F.substring("t", F.lit(1), F.floor(F.length("t") / 2).cast("int")))
    facts = read(spark, sf_dir, "benchmark").agg(F.collect_list(F.lower(F.substring("text", 1, 25))).alias("facts"))  # one row: 25 characters a probe
    rows = d.crossJoin(F.broadcast(facts))
    held = lambda c: F.size(F.filter("facts", lambda f: F.contains(F.col(c), f))).cast("long")
    rows = rows.select("doc_id", held("t").alias("had"), held("h").alias("kept"))
    return rows.withColumn("recall", F.when(F.col("had") == 0, 1.0).otherwise(F.round(F.col("kept") / F.col("had"), 6)))


_LOG = "l AS (SELECT user_id, string_agg(CASE event_type WHEN 'error' THEN 'ERROR at line ' || event_id WHEN 'click' THEN 'def f' || event_id || '() {x}' WHEN 'view' THEN 'id 1' || lpad(event_id::VARCHAR, 6, '0') ELSE '# note [' || event_type || ']' END, chr(10) ORDER BY ts, event_id) AS a FROM events GROUP BY 1), c AS (SELECT user_id, a, array_to_string(list_filter(string_split(a, chr(10)), lambda x: NOT contains(x, '7')), chr(10)) AS b FROM l)"


def _compressed(spark, sf_dir):
    """A log of each user, and the same without lines that hold a 7."""
    i = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR at line "), i)).when(F.col("event_type") == "click", F.concat(F.lit("def f"), i, F.lit("() {x}"))).when(F.col("event_type") == "view", F.concat(F.lit("id 1"), F.lpad(i, 6, "0"))).otherwise(F.concat(F.lit("# note ["), "event_type", F.lit("]")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("x")))), lambda s: s["x"])
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(lines.alias("l"))
    return rows.select("user_id", F.array_join("l", "\n").alias("a"), F.array_join(F.filter("l", lambda x: ~x.contains("7")), "\n").alias("b"))


def _sum_sql(t, signs, count):
    if count:
        return " + ".join(f"(length({t}) - length(replace({t}, '{s}', ''))) / {len(s)}" for s in signs)
    return " + ".join(f"contains({t}, '{s}')::INT" for s in signs)


def _kept_sql(signs, count):
    return f"CASE WHEN {_sum_sql('a', signs, count)} = 0 THEN 1 ELSE least(1.0::DOUBLE, ({_sum_sql('b', signs, count)}) / ({_sum_sql('a', signs, count)})) END"


_KV = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}'), regexp_extract_all(lower({0}), '[0-9a-f]{{32,64}}'), regexp_extract_all(lower({0}), '[0-9]{{5,}}')))"


@query(f"WITH {_LOG}, s AS (SELECT user_id, {_kept_sql(ERROR_SIGNS, False)} AS e, {_kept_sql(STRUCTURE_SIGNS, True)} AS s, CASE WHEN len({_KV.format('a')}) = 0 THEN 1 ELSE len(list_intersect({_KV.format('a')}, {_KV.format('b')})) / len({_KV.format('a')}) END AS k, length(b) / length(a) AS ratio FROM c) SELECT user_id, round(e, 6)::DOUBLE AS errors, round(s, 6)::DOUBLE AS structure, round(k, 6)::DOUBLE AS key_values, round(0.4::DOUBLE * e + 0.3::DOUBLE * s + 0.3::DOUBLE * k, 6) AS ips, round((1 - ratio) * 0.9::DOUBLE, 6) AS cwq FROM s")
def q6_q7_preservation(spark, sf_dir):
    """What compressed logs keep of errors, structure and key values, and the scores from it."""
    a, b = F.col("a"), F.col("b")
    rows = _compressed(spark, sf_dir).select("user_id", preserved(a, b, ERROR_SIGNS, False).alias("e"), preserved(a, b, STRUCTURE_SIGNS, True).alias("s"), survival(key_values(a), key_values(b)).alias("k"), (F.length(b) / F.length(a)).alias("ratio"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("user_id", r("e", "errors"), r("s", "structure"), r("k", "key_values"), r(0.4 * F.col("e") + 0.3 * F.col("s") + 0.3 * F.col("k"), "ips"), r((1 - F.col("ratio")) * 0.9, "cwq"))


_SP = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


@query(f"WITH {_LOG}, d AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'log' ELSE 'text' END AS kind, a, CASE WHEN user_id % 5 = 0 THEN a WHEN user_id % 5 = 1 THEN repeat('note ', 40) ELSE b END AS b FROM c), w AS (SELECT *, len({_SP.format('a')}) AS na, len({_SP.format('b')}) AS nb, len(list_distinct({_SP.format('a')})) AS ua, len(list_distinct({_SP.format('b')})) AS ub, CASE WHEN kind = 'log' THEN {_kept_sql(LOG_SIGNS, False)} >= 1 ELSE {_kept_sql(TEXT_SIGNS, False)} >= 0.8 END AS marks FROM d) SELECT user_id, array_to_string(list_filter([CASE WHEN NOT (nb <= na AND (na = 0 OR (1 - nb / na) * 100 >= 5)) THEN 'token_reduction' END, CASE WHEN NOT marks THEN 'critical_markers' END, CASE WHEN NOT (nb > 0 AND (na = 0 OR ub / greatest(1, nb) >= ua / greatest(1, na) * 0.5)) THEN 'density' END], lambda x: x IS NOT NULL), ',') AS failures FROM w")
def q8_quality_gate(spark, sf_dir):
    """The checks that each compressed log fails; such a log goes back to the original."""
    u = F.col("user_id")
    rows = _compressed(spark, sf_dir).withColumn("b", F.when(u % 5 == 0, F.col("a")).when(u % 5 == 1, F.repeat(F.lit("note "), F.lit(40))).otherwise(F.col("b")))
    failed = gate(F.col("a"), F.col("b"), F.when(u % 2 == 0, "log").otherwise("text"))
    return rows.select("user_id", F.array_join(failed, ",").alias("failures"))


@query("WITH v AS (SELECT quality AS arm, toxic, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0, avg(n_chars) FILTER (arm = 1) AS m1, avg(n_chars) FILTER (arm = 0) AS m0, var_samp(n_chars) FILTER (arm = 1) AS v1, var_samp(n_chars) FILTER (arm = 0) AS v0 FROM v), z AS (SELECT *, m1 - m0 AS d, sqrt(v1 / n1 + v0 / n0) AS se, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS sd FROM s) SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, round(d, 4) AS difference, round(d - 1.96::DOUBLE * se, 4) AS low, round(d + 1.96::DOUBLE * se, 4) AS high, round(d / sd, 6) AS cohen_d, abs(d / se) > 1.96 AS significant, CASE WHEN least(n1, n0) < 2 THEN 'continue' WHEN abs(d / se) <= 1.96 THEN 'no_difference' WHEN d > 0 THEN 'adopt' ELSE 'reject' END AS verdict FROM z")
def q9_ab_analysis(spark, sf_dir):
    """Lengths of good and bad texts as the arms of an experiment: difference, interval, effect size, verdict."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    x = lambda a: F.when(F.col("quality") == a, F.col("n_chars").cast("double"))
    s = rows.agg(F.count(x(1)).alias("n1"), F.count(x(0)).alias("n0"), F.avg(x(1)).alias("m1"), F.avg(x(0)).alias("m0"), F.var_samp(x(1)).alias("v1"), F.var_samp(x(0)).alias("v0"))
    n1, n0, v1, v0 = (F.col(c) for c in ("n1", "n0", "v1", "v0"))
    s = s.withColumns({"d": F.col("m1") - F.col("m0"), "se": F.sqrt(v1 / n1 + v0 / n0), "sd": F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))})
    d, se = F.col("d"), F.col("se")
    # p = 2 (1 - cdf(|d / se|)) < .05 as a bound on the statistic.
    clear = 2 * (1 - T.normal_cdf(F.abs(d / se))) < 0.05
    verdict = F.when(F.least("n1", "n0") < 2, "continue").when(~clear, "no_difference").when(d > 0, "adopt").otherwise("reject")
    return s.select("n1", "n0", F.round(d, 4).alias("difference"), F.round(d - 1.96 * se, 4).alias("low"), F.round(d + 1.96 * se, 4).alias("high"), F.round(d / F.col("sd"), 6).alias("cohen_d"), clear.alias("significant"), verdict.alias("verdict"))


@query("WITH r AS (SELECT source, avg(quality) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), q AS (SELECT source, n, least(0.95::DOUBLE, greatest(0.05::DOUBLE, p)) AS p1, least(0.99::DOUBLE, greatest(0.05::DOUBLE, p) + 0.04::DOUBLE) AS p2 FROM r) SELECT source, ceil(round(power(1.959964::DOUBLE * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) + 0.841621::DOUBLE * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / power(p2 - p1, 2), 6))::BIGINT AS needed FROM q")
def q10_sample_sizes(spark, sf_dir):
    """Labels needed for each source to see a rise of its good share by four points."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    r = rows.groupBy("source").agg(F.avg("quality").alias("p"))
    low = F.greatest(F.lit(0.05), F.col("p"))
    r = r.withColumns({"p1": F.least(F.lit(0.95), low), "p2": F.least(F.lit(0.99), low + 0.04)})
    return r.select("source", sample_size(F.col("p1"), F.col("p2")).alias("needed"))


def sample_size(p1: Column, p2: Column, z_alpha: float = 1.959964, z_power: float = 0.841621) -> Column:
    """Samples of each arm for two proportions, at 5 % error and 80 % power."""
    m = (p1 + p2) / 2
    top = z_alpha * F.sqrt(2 * m * (1 - m)) + z_power * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.ceil(F.round(top * top / ((p2 - p1) * (p2 - p1)), 6)).cast("long")


@query(f"WITH {_LOG}, d AS (SELECT user_id % 6 AS dataset, length(b) / length(a) AS ratio, {_kept_sql(ERROR_SIGNS, False)} AS kept FROM c) SELECT dataset, count(*) AS n, round(avg(ratio), 6) AS ratio, round(avg(kept), 6) AS kept, round(avg((ratio < 0.75)::INT), 6) AS pass_rate FROM d GROUP BY 1")
def q11_q14_benchmark(spark, sf_dir):
    """Averages of compressed logs by dataset."""
    a, b = F.col("a"), F.col("b")
    rows = _compressed(spark, sf_dir).select((F.col("user_id") % 6).alias("dataset"), (F.length(b) / F.length(a)).alias("ratio"), preserved(a, b, ERROR_SIGNS, False).alias("kept"))
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), r("ratio", "ratio"), r("kept", "kept"), r((F.col("ratio") < 0.75).cast("double"), "pass_rate"))


@query(f"WITH {_LOG}, x AS (SELECT c.user_id, p.name, q.place, CASE q.place WHEN 'front' THEN p.payload || chr(10) || a WHEN 'back' THEN a || chr(10) || p.payload ELSE left(a, length(a) // 2) || p.payload || substr(a, length(a) // 2 + 1) END AS t FROM c, (SELECT unnest(['number', 'marker']) AS name, unnest(['needle 123456', 'ALERT 7']) AS payload) p, (SELECT unnest(['front', 'middle', 'back']) AS place) q), y AS (SELECT *, array_to_string(list_filter(string_split(t, chr(10)), lambda z: NOT contains(z, '7')), chr(10)) AS b FROM x) SELECT name, place, count(*) AS n, round(avg(contains(b, CASE name WHEN 'number' THEN 'needle 123456' ELSE 'ALERT 7' END)::INT), 6) AS survival FROM y GROUP BY ALL")
def q12_adversarial_grid(spark, sf_dir):
    """How often payloads of two kinds at three places survive the compression of a log."""
    payloads = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("payload")) for n, p in (("number", "needle 123456"), ("marker", "ALERT 7"))]))
    rows = _compressed(spark, sf_dir).select("a", payloads.alias("p")).select("a", "p.*", F.explode(F.array(*map(F.lit, ("front", "middle", "back")))).alias("place"))
    half = F.floor(F.length("a") / 2).cast("int")
    t = F.when(F.col("place") == "front", F.concat("payload", F.lit("\n"), "a")).when(F.col("place") == "back", F.concat("a", F.lit("\n"), "payload")).otherwise(F.concat(F.substring("a", F.lit(1), half), "payload", F.substring("a", half + 1, F.length("a"))))
    b = F.array_join(F.filter(F.split(t, "\n"), lambda z: ~z.contains("7")), "\n")
    rows = rows.withColumn("b", b)
    return rows.groupBy("name", "place").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.contains("b", "payload").cast("double")), 6).alias("survival"))


@query(f"WITH {_LOG}, o AS (SELECT user_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT user_id, string_split(a, chr(10)) AS l FROM c)), k AS (SELECT DISTINCT user_id, unnest(string_split(b, chr(10))) AS line FROM c), f AS (SELECT o.*, k.line IS NOT NULL AS kept FROM o LEFT JOIN k ON k.user_id = o.user_id AND k.line = o.line), s AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, kept ORDER BY i) AS run FROM f) SELECT user_id, kept, count(DISTINCT run) AS segments, count(*) AS lines FROM s GROUP BY ALL")
def q13_j13_compression_diff(spark, sf_dir):
    """Segments and lines of each log that its compressed form keeps or drops."""
    rows = _compressed(spark, sf_dir)
    o = rows.select("user_id", F.posexplode(F.split("a", "\n")).alias("i", "line"))
    k = rows.select("user_id", F.explode(F.split("b", "\n")).alias("line")).distinct().withColumn("hit", F.lit(True))
    f = o.join(k, ["user_id", "line"], "left").withColumn("kept", F.coalesce("hit", F.lit(False)))
    s = f.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("user_id", "kept").orderBy("i")))
    return s.groupBy("user_id", "kept").agg(F.countDistinct("run").alias("segments"), F.count(F.lit(1)).alias("lines"))


_SCRAPE = "regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|head)\\b.*?</(script|style|nav|footer|head)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@query(f"WITH t AS (SELECT page_id, {_TOK.format(_SCRAPE)} AS got, {_TOK.format("regexp_replace(regexp_extract(html, '(?is)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")} AS want FROM pages), g AS (SELECT page_id, unnest(got) AS w, 0 AS side FROM t UNION ALL SELECT page_id, unnest(want), 1 FROM t), c AS (SELECT page_id, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g GROUP BY ALL), s AS (SELECT page_id, sum(least(a, b)) AS hit, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1) SELECT page_id, round(CASE WHEN a > 0 THEN hit / a ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN b > 0 THEN hit / b ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN hit > 0 THEN 2 * hit / (a + b) ELSE 0 END, 6)::DOUBLE AS f1 FROM s")
def q15_html_benchmark(spark, sf_dir):
    """Precision, recall and F1 of a plain tag stripper against the article of each page, by tokens."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav|footer|head)\b.*?</(script|style|nav|footer|head)>", " "), "<[^>]*>", " ")
    true = F.regexp_replace(F.regexp_extract("html", "(?is)<article>(.*)</article>", 1), "<[^>]*>", " ")
    t = read(spark, sf_dir, "pages").select("page_id", T.word_tokens(plain).alias("got"), T.word_tokens(true).alias("want"))
    words = t.select("page_id", F.explode("got").alias("w"), F.lit(0).alias("side")).unionByName(t.select("page_id", F.explode("want").alias("w"), F.lit(1).alias("side")))
    c = words.groupBy("page_id", "w").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    s = c.groupBy("page_id").agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    per = lambda x, y, n: F.round(F.when(y > 0, x / y).otherwise(0.0), 6).alias(n)
    return s.select("page_id", per(F.col("both"), F.col("a"), "precision"), per(F.col("both"), F.col("b"), "recall"), per(2 * F.col("both"), F.col("a") + F.col("b"), "f1"))


@query("WITH w AS (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark), g AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w), d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), o AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 7, 0) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d), r AS (SELECT doc_id, count(*) AS n, count(g.g) AS hit FROM o LEFT JOIN g USING (g) GROUP BY 1) SELECT doc_id, round(coalesce(hit / n, 0), 6) AS echo FROM d LEFT JOIN r USING (doc_id)")
def o4_echo_ratio(spark, sf_dir):
    """The share of a text's 8-word sequences that stand in the benchmark."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    grams = F.when(F.size("w") >= 8, F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).otherwise(F.array().cast("array<string>"))
    known = read(spark, sf_dir, "benchmark").select(split(F.col("text")).alias("w")).select(F.explode(grams).alias("g")).distinct().withColumn("hit", F.lit(1))
    d = read(spark, sf_dir, "documents").select("doc_id", split(F.col("text")).alias("w"))
    r = d.select("doc_id", F.explode(grams).alias("g")).join(known, "g", "left").groupBy("doc_id").agg((F.count("hit") / F.count(F.lit(1))).alias("echo"))
    return d.select("doc_id").join(r, "doc_id", "left").select("doc_id", F.round(F.coalesce("echo", F.lit(0.0)), 6).alias("echo"))


@query("WITH m AS (SELECT l_orderkey, list(l_quantity > 25 ORDER BY l_linenumber, l_partkey, l_quantity > 25, l_discount > 0.05) AS a, list(l_discount > 0.05 ORDER BY l_linenumber, l_partkey, l_quantity > 25, l_discount > 0.05) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(list_zip(a, b), lambda z: (z[1] OR z[2])::INT), '') AS any, array_to_string(list_transform(list_zip(a, b), lambda z: (z[1] AND z[2])::INT), '') AS both FROM m")
def o1_o2_masks(spark, sf_dir):
    """Union and intersection of two masks over the lines of each order."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"))))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(order.alias("m"))
    bits = lambda f: F.array_join(F.transform("m", lambda s: f(s).cast("int").cast("string")), "")
    return rows.select("l_orderkey", bits(lambda s: s["a"] | s["b"]).alias("any"), bits(lambda s: s["a"] & s["b"]).alias("both"))


@query("WITH k AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) SELECT o_custkey, round(coalesce(len(list_intersect(a, b)), 0) / len(a), 6) AS survival FROM k")
def o3_key_survival(spark, sf_dir):
    """The share of a customer's priorities that finished orders keep."""
    k = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b"))
    return k.select("o_custkey", F.round(survival(F.col("a"), F.col("b")), 6).alias("survival"))


@query("WITH a AS (SELECT DISTINCT md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 = 0) SELECT CASE WHEN a.h IS NULL THEN 'import' WHEN b.h IS NULL THEN 'export' ELSE 'same' END AS action, count(*) AS n FROM a FULL JOIN b USING (h) GROUP BY 1".replace("a.h IS NULL", "a.h IS NULL"))
def o6_sync_diff(spark, sf_dir):
    """What to import and to export so that two stores hold the same texts."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    a, b = (d.where(f"doc_id % {n} = 0").select("h").distinct().withColumn(x, F.lit(1)) for n, x in ((2, "a"), (3, "b")))
    action = F.when(F.col("a").isNull(), "import").when(F.col("b").isNull(), "export").otherwise("same")
    return a.join(b, "h", "full").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


# --- features of texts -------------------------------------------------------------------------------------------------

_D = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _cnt(p):
    return f"len(regexp_extract_all(t, '{p}'))"


_FEATURES = {"questions": "[?]", "exclamations": "!", "code_blocks": "```", "bullets": "(?m)^\\s*[-*+] ", "numbered": "(?m)^\\s*[0-9]+[.)] ", "headers": "(?m)^#{1,6} ", "urls": "https?://[^\\s]+", "numbers": "[0-9]+", "emails": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "quotes": "\""}


@query(f"SELECT doc_id, {', '.join(f'{_cnt(p)}::INT AS {n}' for n, p in _FEATURES.items())} FROM {_D}")
def tf6_structure(spark, sf_dir):
    """Counts of structural elements of each text."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", *[T.count(text, p).alias(n) for n, p in _FEATURES.items()])


@query(f"WITH w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, greatest(1, {_cnt('[.!?]+')}) AS s FROM {_D}) SELECT doc_id, len(w)::INT AS words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 4)::DOUBLE AS avg_word, round(len(w) / s, 4) AS avg_sentence, round(len(regexp_extract_all(t, '[.,;:!?]')) / greatest(1, length(t)), 6) AS punctuation, round(len(regexp_extract_all(t, '[#*$%&|<>@^~]')) / greatest(1, length(t)), 6) AS special FROM w")
def tf1_tf3_averages(spark, sf_dir):
    """Mean word and sentence lengths, shares of punctuation and special characters."""
    t = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    n = F.size("w")
    total = F.aggregate(F.transform("w", F.length), F.lit(0), lambda a, x: a + x)
    share = lambda p, name: F.round(T.count(F.col("t"), p) / F.greatest(F.lit(1), F.length("t")), 6).alias(name)
    return rows.select("doc_id", n.alias("words"), F.round(F.when(n > 0, total / n).otherwise(0.0), 4).alias("avg_word"), F.round(n / F.greatest(F.lit(1), T.count(F.col("t"), "[.!?]+")), 4).alias("avg_sentence"), share("[.,;:!?]", "punctuation"), share("[#*$%&|<>@^~]", "special"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z0-9_]+') AS w FROM {_D}), g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w), r AS (SELECT doc_id, 1 - count(DISTINCT g) / count(*) AS r FROM g GROUP BY 1) SELECT doc_id, round(coalesce(r, 0), 6)::DOUBLE AS repetition FROM w LEFT JOIN r USING (doc_id)")
def tf4_repetition(spark, sf_dir):
    """The share of a text's word trigrams that repeat."""
    w = read(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    rows = w.withColumn("g", grams)
    return rows.select("doc_id", F.round(F.coalesce(1 - F.size(F.array_distinct("g")) / F.when(F.size("g") > 0, F.size("g")), F.lit(0.0)), 6).alias("repetition"))


@query(None)
def tf4_compression(spark, sf_dir):
    """The share of its size that each text keeps under zlib."""

    @pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        import zlib

        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return pd.Series([len(zlib.compress(r)) / len(r) if r else 0.0 for r in raw], dtype="float64")

    return read(spark, sf_dir, "documents").select("doc_id", F.round(ratio("text"), 6).alias("ratio"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z]+') AS w, greatest(1, {_cnt('[.!?]+')}) AS s FROM {_D}), y AS (SELECT doc_id, len(w) AS n, s, coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^aeiouy]e$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0) AS y FROM w) SELECT doc_id, y::INT AS syllables, round(greatest(0, least(100, 206.835::DOUBLE - 1.015 * (n / s) - 84.6 * (y / greatest(n, 1)))), 4) AS ease, round(0.39::DOUBLE * (n / s) + 11.8 * (y / greatest(n, 1)) - 15.59, 4) AS grade FROM y")
def tf5_readability(spark, sf_dir):
    """Syllables, reading ease and grade of each text."""
    t = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)).alias("w"), T.count(t, "[.!?]+").alias("s"))
    rows = rows.withColumn("y", F.aggregate(F.transform("w", T.syllables), F.lit(0), lambda a, x: a + x))
    ease, grade = T.flesch(F.size("w"), F.col("s"), F.col("y"))
    return rows.select("doc_id", F.col("y").alias("syllables"), F.round(ease, 4).alias("ease"), F.round(grade, 4).alias("grade"))


_TASKS = {"code": "code|function|class|debug", "analysis": "analy|compare|evaluate", "writing": "write|essay|story", "question": "what|how|why|when|who"}


@query("WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations) SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in _TASKS.items()) + " ELSE 'other' END AS task, len(regexp_extract_all(t, '(^|[^a-z])(good|great|thanks|nice)([^a-z]|$)')) - len(regexp_extract_all(t, '(^|[^a-z])(bad|wrong|broken|error)([^a-z]|$)')) AS sentiment, len(regexp_extract_all(t, '[a-z]{9,}'))::INT AS long_words FROM m")
def tf7_semantics(spark, sf_dir):
    """The task of a message by its words, its sentiment and its long words."""
    t = F.lower(F.coalesce("text", F.lit("")))
    task = F.lit("other")
    for n, p in reversed(_TASKS.items()):
        task = F.when(t.rlike(p), n).otherwise(task)
    word = lambda w: T.count(t, f"(^|[^a-z])({w})([^a-z]|$)")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", task.alias("task"), (word("good|great|thanks|nice") - word("bad|wrong|broken|error")).cast("long").alias("sentiment"), T.count(t, "[a-z]{9,}").alias("long_words"))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS normal_md5, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))::INT AS words, left(md5(coalesce(text, '')), 16) AS md5_16, left(sha256(coalesce(text, '')), 24) AS sha_24 FROM documents")
def x1_x4_x5_normal_forms(spark, sf_dir):
    """Normal form, words and short hashes of each text."""
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(t)).alias("normal_md5"), F.size(T.word_tokens(t)).alias("words"), F.substring(F.md5(t), 1, 16).alias("md5_16"), F.substring(F.sha2(t, 256), 1, 24).alias("sha_24"))


@query("WITH m AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'def f(x):' || chr(10) || '  return ' || props ELSE repeat(event_type || ' ', CAST(event_id % 7 AS INT)) END AS t FROM events) SELECT event_id, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, floor(length(t) / CASE WHEN regexp_matches(trim(t), '^[\\[{]') THEN 3.2::DOUBLE WHEN regexp_matches(t, '(?m)^\\s*(def|class|import|function|const|func|fn) ') THEN 3.5 ELSE 4.0 END + 0.5)) END::BIGINT AS tokens FROM m")
def x2_token_estimates(spark, sf_dir):
    """Estimated tokens of JSON, code and prose."""
    i = F.col("event_id")
    t = F.when(i % 3 == 0, F.col("props")).when(i % 3 == 1, F.concat(F.lit("def f(x):\n  return "), "props")).otherwise(F.expr("repeat(concat(event_type, ' '), cast(event_id % 7 as int))"))
    return read(spark, sf_dir, "events").select("event_id", T.token_estimate(t).alias("tokens"))


@query("WITH p AS (SELECT p_partkey, 'src/' || p_type || '/' || p_name AS a, 'src/' || CASE WHEN p_size % 3 = 0 THEN 'x/' || p_name WHEN p_size % 3 = 1 THEN p_type || '/' || p_name || 's' ELSE p_type || '/other' END AS b FROM part) SELECT p_partkey, levenshtein(a, b)::INT AS distance, a <> b AND ((regexp_replace(a, '/?[^/]*$', '') = regexp_replace(b, '/?[^/]*$', '') AND levenshtein(string_split(a, '/')[-1], string_split(b, '/')[-1]) <= 2) OR (regexp_replace(a, '/?[^/]*$', '') <> regexp_replace(b, '/?[^/]*$', '') AND string_split(a, '/')[-1] = string_split(b, '/')[-1])) AS typo FROM p")
def x6_x7_path_typos(spark, sf_dir):
    """Distances of two paths, and whether they look like a typo."""
    a = F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_name")
    size = F.col("p_size") % 3
    b = F.concat(F.lit("src/"), F.when(size == 0, F.concat(F.lit("x/"), "p_name")).when(size == 1, F.concat("p_type", F.lit("/"), "p_name", F.lit("s"))).otherwise(F.concat("p_type", F.lit("/other"))))
    return read(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), T.path_typo(a, b).alias("typo"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, try_cast(CASE WHEN event_id % 5 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed, split_part(event_type, 'i', 1) AS head, left(event_type, 3) AS short, coalesce(try_cast(CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '7' END AS INT), -1) AS number FROM events")
def x9_x10_parsing(spark, sf_dir):
    """Times and numbers from and to text; what cannot be parsed is null."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return read(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.try_to_timestamp(text).cast("timestamp_ntz").alias("parsed"), F.split_part("event_type", F.lit("i"), F.lit(1)).alias("head"),
        F.substring("event_type", 1, 3).alias("short"), F.coalesce(F.when(i % 2 == 0, "x").otherwise("7").try_cast("int"), F.lit(-1)).alias("number"),
    )


@query("SELECT event_id, round(exp(-value / 100), 6) AS decay, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log, round(CASE WHEN z >= 0 THEN 1 - p * exp(-z * z / 2) / 2 ELSE p * exp(-z * z / 2) / 2 END, 6) AS cdf FROM (SELECT event_id, value, z, 0.254829592::DOUBLE * t - 0.284496736::DOUBLE * t * t + 1.421413741::DOUBLE * t * t * t - 1.453152027::DOUBLE * pow(t, 4) + 1.061405429::DOUBLE * pow(t, 5) AS p FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM (SELECT event_id, value, (value - 50) / 40 AS z FROM events)))")
def x14_numeric(spark, sf_dir):
    """Decay, root, logarithm and the normal distribution of each value."""
    v = F.col("value")
    r = lambda c, n: F.round(c, 6).alias(n)
    return read(spark, sf_dir, "events").select("event_id", r(F.exp(-v / 100), "decay"), r(F.sqrt(v), "root"), r(F.ln(v + 1), "log"), r(T.normal_cdf((v - 50) / 40), "cdf"))


@query("WITH j AS (SELECT event_id, '{\"b\": ' || props || ', \"a\": [' || event_id || ', 2], \"t\": \"' || event_type || '\"}' AS j FROM events) SELECT event_id, array_to_string(list_sort(json_keys(j)), ',') AS keys, json_extract_string(j, '$.b.k') AS leaf, json_array_length(j, '$.a')::INT AS items, json_extract_string(j, '$.t') AS t FROM j")
def x15_json(spark, sf_dir):
    """Keys, leaves and array lengths of a JSON text."""
    j = F.concat(F.lit('{"b": '), "props", F.lit(', "a": ['), F.col("event_id").cast("string"), F.lit(', 2], "t": "'), "event_type", F.lit('"}'))
    return read(spark, sf_dir, "events").withColumn("j", j).select("event_id", F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"), F.get_json_object("j", "$.b.k").alias("leaf"), F.json_array_length(F.get_json_object("j", "$.a")).alias("items"), F.get_json_object("j", "$.t").alias("t"))


@query("WITH l AS (SELECT l_orderkey, list(l_quantity::INT ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS q, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(f)), '') AS flags, array_to_string(q[1:2], ',') AS first, list_contains(q, 50) AS full, list_sum(q)::BIGINT AS total, len(list_filter(list_zip(q, f), lambda z: z[2] = 'R' AND z[1] > 25))::INT AS big_returns FROM l")
def x16_x17_arrays(spark, sf_dir):
    """Arrays of an order: distinct, slice, contains, sum, zip and filter."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(order.alias("l")).withColumn("q", F.transform("l", lambda s: s["q"]))
    return rows.select(
        "l_orderkey", F.array_join(F.array_sort(F.array_distinct(F.transform("l", lambda s: s["f"]))), "").alias("flags"), F.array_join(F.slice("q", 1, 2), ",").alias("first"), F.array_contains("q", 50).alias("full"),
        F.aggregate("q", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size(F.filter("l", lambda s: (s["f"] == "R") & (s["q"] > 25))).alias("big_returns"),
    )


@query("WITH t AS (SELECT o_orderkey, 'see src/m' || o_custkey || '.py:' || o_orderkey % 90 || ' or mail u' || o_custkey || '@x.org about ' || (o_orderkey + 100000) AS t, CASE o_orderkey % 4 WHEN 0 THEN 'status:' || o_orderstatus || ' AND price>=10' WHEN 1 THEN 'name contains \"x\"' WHEN 2 THEN '' ELSE 'id!=3' END AS q FROM orders) SELECT o_orderkey, regexp_extract(t, '[A-Za-z0-9_./-]+\\.[A-Za-z]+:[0-9]+') AS place, regexp_extract(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, regexp_extract(t, '[0-9]{6,}') AS id, nullif(nullif(regexp_replace(q, '([A-Za-z0-9_]+)[=:](?:\"[^\"]*\"|''[^'']*''|[A-Za-z0-9_]+)', '\\1:*', 'g'), ''), '*') AS pattern, CASE WHEN contains(q, '!=') THEN '!=' WHEN contains(q, '>=') THEN '>=' WHEN contains(q, '<=') THEN '<=' WHEN contains(q, '>') THEN '>' WHEN contains(q, '<') THEN '<' WHEN contains(lower(q), 'contains') THEN 'contains' ELSE '=' END AS operator FROM t")
def x18_x19_entities(spark, sf_dir):
    """Places, addresses and ids of a text; the pattern and operator of a query."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    t = F.concat(F.lit("see src/m"), c, F.lit(".py:"), (k % 90).cast("string"), F.lit(" or mail u"), c, F.lit("@x.org about "), (k + 100000).cast("string"))
    q = F.when(k % 4 == 0, F.concat(F.lit("status:"), "o_orderstatus", F.lit(" AND price>=10"))).when(k % 4 == 1, 'name contains "x"').when(k % 4 == 2, "").otherwise("id!=3")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"), q.alias("q"))
    return rows.select("o_orderkey", F.regexp_extract("t", r"[A-Za-z0-9_./-]+\.[A-Za-z]+:[0-9]+", 0).alias("place"), F.regexp_extract("t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0).alias("email"), F.regexp_extract("t", "[0-9]{6,}", 0).alias("id"), T.anonymized(F.col("q")).alias("pattern"), T.query_operator(F.col("q")).alias("operator"))


@query("SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(trim(n), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'unknown') AS name, replace(replace(replace(n, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') AS label FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '??' ELSE ' ' || p_name || '/' || p_brand || ' \"q\" \\ ' || chr(10) END AS n FROM part)")
def x20_names(spark, sf_dir):
    """Names made safe for projects and for labels."""
    n = F.when(F.col("p_size") % 7 == 0, "??").otherwise(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit(' "q" \\ \n')))
    return read(spark, sf_dir, "part").select("p_partkey", T.sanitized_name(n).alias("name"), T.escaped_label(n).alias("label"))


@query("WITH t AS (SELECT event_id, CAST(floor(value * 400) AS BIGINT) AS used, CASE event_type WHEN 'view' THEN 200000 WHEN 'error' THEN 32000 ELSE 128000 END AS w, CASE event_id % 3 WHEN 0 THEN 'int4' WHEN 1 THEN 'int8' ELSE 'fp16' END AS p FROM events), z AS (SELECT *, CAST(floor(w * 0.6::DOUBLE * 0.9::DOUBLE * 1.0) AS BIGINT) AS zone FROM t) SELECT event_id, zone, CASE WHEN used / zone < 0.75 THEN 'light' WHEN used / zone < 0.85 THEN 'medium' WHEN used / zone < 1 THEN 'heavy' ELSE 'critical' END AS pressure, round(1 + (CASE p WHEN 'int4' THEN 0.8::DOUBLE WHEN 'int8' THEN 0.3::DOUBLE ELSE 0 END) * greatest(0, least(1, (used - 32000) / 96000.0::DOUBLE)), 6) AS multiplier, CASE WHEN p = 'fp16' OR used <= 32000 THEN 'safe' WHEN used < 128000 THEN 'elevated' ELSE 'critical' END AS risk, CASE WHEN used / w < 0.5 THEN 'green' WHEN used / w < 0.75 THEN 'yellow' WHEN used / w < 0.9 THEN 'orange' ELSE 'red' END AS zone_color FROM z")
def x21_x22_x26_budgets(spark, sf_dir):
    """Smart zones, pressure, precision and zones of contexts of several sizes."""
    used = F.floor(F.col("value") * 400).cast("long")
    window = F.when(F.col("event_type") == "view", 200_000).when(F.col("event_type") == "error", 32_000).otherwise(128_000)
    p = F.when(F.col("event_id") % 3 == 0, "int4").when(F.col("event_id") % 3 == 1, "int8").otherwise("fp16")
    rows = read(spark, sf_dir, "events").select("event_id", used.alias("used"), window.alias("w"), p.alias("p")).withColumn("zone", budgets.smart_zone(F.col("w"), 0.6, F.lit(0.9), F.lit(1.0)))
    return rows.select("event_id", "zone", budgets.pressure(F.col("used"), F.col("zone")).alias("pressure"), F.round(budgets.precision_multiplier(F.col("p"), F.col("used")), 6).alias("multiplier"), budgets.precision_risk(F.col("p"), F.col("used")).alias("risk"), budgets.zone(F.col("used"), F.col("w")).alias("zone_color"))


@query("WITH t AS (SELECT event_id, value * 10 + 0.123::DOUBLE AS d, try_cast(json_extract_string(props, '$.k') AS BIGINT) * 100 AS s, event_id % 20 AS r FROM events), g AS (SELECT *, d * (1.25::DOUBLE + 0.1::DOUBLE * (r - 1)) - 0.5::DOUBLE * 1.15::DOUBLE * (s + d) AS gain FROM t) SELECT event_id, round(gain, 6) AS gain, gain > 0 AS mutate, CASE WHEN d > 0 THEN round(11.5::DOUBLE * s / d, 6) END AS break_even FROM g")
def x23_net_gain(spark, sf_dir):
    """Whether a change to a cached prefix pays, and after how many reads."""
    d, s, r = F.col("value") * 10 + 0.123, F.get_json_object("props", "$.k").try_cast("long") * 100, F.col("event_id") % 20
    gain = budgets.net_gain(d, s, r, F.lit(0.5))
    return read(spark, sf_dir, "events").select("event_id", F.round(gain, 6).alias("gain"), (gain > 0).alias("mutate"), F.round(budgets.break_even_reads(d, s), 6).alias("break_even"))


@query("WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'Permission denied' WHEN 2 THEN 'No such file: x' WHEN 3 THEN 'SyntaxError: unexpected token' WHEN 4 THEN 'Connection refused' WHEN 5 THEN 'killed: out of memory' WHEN 6 THEN 'odd' ELSE 'File not found after timeout' END AS t FROM events) SELECT CASE WHEN regexp_matches(lower(t), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(t), 'permission|denied|forbidden') THEN 'permission' WHEN regexp_matches(lower(t), 'not found|no such file|does not exist') THEN 'not_found' WHEN regexp_matches(lower(t), 'syntax|parse|unexpected token') THEN 'syntax' WHEN regexp_matches(lower(t), 'connection|network|refused') THEN 'network' WHEN regexp_matches(lower(t), 'out of memory|oom') THEN 'memory' ELSE 'other' END AS category, count(*) AS n FROM t GROUP BY 1")
def x25_error_categories(spark, sf_dir):
    """Errors by category."""
    texts = ["Request timed out", "Permission denied", "No such file: x", "SyntaxError: unexpected token", "Connection refused", "killed: out of memory", "odd", "File not found after timeout"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "events").groupBy(T.error_category(t).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT conv_id, list(turn % 3 = 1 AND length(text) % 2 = 0 ORDER BY turn) AS m FROM conversations GROUP BY 1), f AS (SELECT conv_id, coalesce(list_max(list_transform(m, lambda x, i: CASE WHEN x THEN i ELSE 0 END)), 0) AS frozen FROM m) SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) > frozen AS live FROM conversations c JOIN f USING (conv_id)")
def x27_t45_live_zone(spark, sf_dir):
    """Messages behind the frozen prefix, which ends at the last one with a cache mark."""
    chat = read(spark, sf_dir, "conversations")
    marked = F.transform(F.array_sort(F.collect_list(F.struct("turn", ((F.col("turn") % 3 == 1) & (F.length("text") % 2 == 0)).alias("m")))), lambda s: s["m"])
    f = chat.groupBy("conv_id").agg(budgets.frozen_prefix(marked).alias("frozen"))
    return chat.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).join(f, "conv_id").select("conv_id", "turn", (F.col("k") > F.col("frozen")).alias("live"))


assert math.isclose(sum(budgets.PHASES.values()), 1.0)
QUERIES, ORACLES = query.queries, query.oracles
