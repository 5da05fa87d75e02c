"""The extension surface: text transforms and their pipeline, scorers, constraints, formatters, hooks.

A transform maps a text Column to a smaller one. The pipeline keeps a result only if it is strictly smaller, so that no
transform can make a text grow, and lists which ones were applied.
"""

from __future__ import annotations

import abc
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.operators.lines import clean_terminal, collapse_identical
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()


class Transform(abc.ABC):
    """Subclass this: a name, which texts it is for, and what it makes of them."""

    name: str

    def should_apply(self, text: Column) -> Column:
        return F.lit(True)

    @abc.abstractmethod
    def apply(self, text: Column) -> Column: ...


@dataclass
class Simple(Transform):
    """A transform from functions."""

    name: str
    make: Callable[[Column], Column]
    when: Callable[[Column], Column] = lambda text: F.lit(True)

    def should_apply(self, text: Column) -> Column:
        return self.when(text)

    def apply(self, text: Column) -> Column:
        return self.make(text)


def minify_json(text: Column) -> Column:
    """JSON without insignificant white space; strings stay as they are, and so does what is no JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


REFORMATS: list[Transform] = [
    Simple("clean_terminal", clean_terminal, lambda t: t.contains("\x1b") | t.contains("\r")),
    Simple("collapse_identical", collapse_identical, lambda t: t.contains("\n")),
    Simple("squeeze_blanks", lambda t: F.regexp_replace(t, "[ \t]{2,}", " ")),
]

#: Text between such markers may change; a marker may not.
MARKER = "<<ccr:[^>]+>>"


def run(rows: DataFrame, column: str, transforms: list[Transform], enough: float = 0.5, bias: str | None = None) -> DataFrame:
    """Adds `applied`: the transforms that made the text strictly smaller, in order, until `enough` of it is left.

    Rows whose text holds a retrieval marker keep it as it is. A bias column of 0 switches a row off.
    """
    first = f"_{column}_size"
    off = F.col(column).rlike(MARKER) | (F.lit(False) if bias is None else F.coalesce(F.col(bias), F.lit(1.0)) == 0)
    rows = rows.withColumns({first: F.length(column), "_off": off, "applied": F.array().cast("array<string>")})
    for t in transforms:
        rows = rows.withColumn("_new", F.when(~F.col("_off") & (F.length(column) > enough * F.col(first)) & t.should_apply(F.col(column)), t.apply(F.col(column))))
        better = F.length("_new") < F.length(column)
        rows = rows.withColumns({"applied": F.when(better, F.concat("applied", F.array(F.lit(t.name)))).otherwise(F.col("applied")), column: F.when(better, F.col("_new")).otherwise(F.col(column))})
    return rows.drop(first, "_off", "_new")


#: Plug-ins by kind: relevance scorers, constraints, line detectors, formatters, conflict merges. Each is a function of
#: Columns; register() adds one under a name.
PLUGINS: dict[str, dict[str, Callable[..., Column]]] = {kind: {} for kind in ("scorer", "constraint", "detector", "formatter", "merge")}


def register(kind: str, name: str, make: Callable[..., Column]) -> None:
    if kind not in PLUGINS:
        raise ValueError(f"unknown kind: {kind}; known: {', '.join(PLUGINS)}")
    PLUGINS[kind][name] = make


def observed(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    """The rows with measures of them that Spark reports under a name when they are computed."""
    return rows.observe(name, *[c.alias(k) for k, c in measures.items()])


_T = "t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || chr(10) || 'a' || chr(10) || 'a' || chr(10) || coalesce(left(text, 30), '') WHEN 1 THEN coalesce(left(text, 30), '') || '     end' WHEN 2 THEN '<<ccr:1>>    ' || coalesce(left(text, 30), '') ELSE 'one  two' || chr(10) || 'x' || chr(10) || 'x' || chr(10) || 'x' || chr(10) || 'x' || chr(10) || 'x' END AS text FROM documents)"


@query(f"WITH {_T}, l AS (SELECT doc_id, text AS t0, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM (SELECT *, string_split(text, chr(10)) AS p FROM t)), m AS (SELECT *, lag(trim(raw, ' ')) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l), g AS (SELECT *, sum(CASE WHEN trim(raw, ' ') <> '' AND trim(raw, ' ') = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m), r AS (SELECT doc_id, run, count(*) AS n, min(trim(raw, ' ')) AS t, first(raw ORDER BY i) AS raw FROM g GROUP BY ALL), c AS (SELECT doc_id, string_agg(CASE WHEN n > 1 THEN t || ' (x' || n || ')' ELSE raw END, chr(10) ORDER BY run) AS c FROM r WHERE n > 1 OR raw <> '' GROUP BY 1), a AS (SELECT t.doc_id, text, length(text) AS n0, regexp_matches(text, '<<ccr:[^>]+>>') AS off, coalesce(c, '') AS c FROM t LEFT JOIN c USING (doc_id)), b AS (SELECT *, NOT off AND contains(text, chr(10)) AND length(c) < n0 AS p1 FROM a), d AS (SELECT *, CASE WHEN p1 THEN c ELSE text END AS x FROM b), e AS (SELECT *, NOT off AND length(x) > 0.5 * n0 AND length(regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g')) < length(x) AS p2 FROM d) SELECT doc_id, md5(CASE WHEN p2 THEN regexp_replace(x, '[ \\t]{{2,}}', ' ', 'g') ELSE x END) AS text_md5, concat_ws(',', CASE WHEN p1 THEN 'collapse_identical' END, CASE WHEN p2 THEN 'squeeze_blanks' END) AS applied FROM e")
def t37_t43_pipeline(spark, sf_dir):
    """Texts through the reformats: which were applied, and a digest of the result; texts with a marker stay."""
    d, text = F.col("doc_id") % 4, F.coalesce(F.substring("text", 1, 30), F.lit(""))
    t = F.when(d == 0, F.concat(F.lit("a\na\na\n"), text)).when(d == 1, F.concat(text, F.lit("     end"))).when(d == 2, F.concat(F.lit("<<ccr:1>>    "), text)).otherwise("one  two\nx\nx\nx\nx\nx")
    rows = run(read(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "text", REFORMATS)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.array_join("applied", ",").alias("applied"))


@query("SELECT event_id, '{\"a\":\"x  y\",\"k\":' || CAST(json_extract_string(props, '$.k') AS INT) || ',\"l\":[1,2]}' AS json FROM events")
def t23_minified_json(spark, sf_dir):
    """JSON without insignificant blanks."""
    raw = F.concat(F.lit('{ "a" : "x  y" ,\n  "k" : '), F.get_json_object("props", "$.k"), F.lit(' , "l" : [ 1 , 2 ] }'))
    return read(spark, sf_dir, "events").select("event_id", minify_json(raw).alias("json"))


def toon(items: Column, columns: list[str], name: str = "items") -> Column:
    """An array of structs as a header and one row an item; line ends become blanks, commas are escaped."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " "), F.lit(","), F.lit("\\,"))
    rows = F.transform(items, lambda s: F.concat(F.lit("  "), F.concat_ws(",", *[cell(s[c]) for c in columns])))
    return F.concat(F.format_string(f"{name}[%d]{{{','.join(columns)}}}:\n", F.size(items)), F.array_join(rows, "\n"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, '  ' || o_orderkey || ',' || o_orderstatus || ',' || replace(o_orderpriority, '-', '\\,') AS row FROM orders) SELECT o_custkey, 'items[' || count(*) || ']{id,status,priority}:' || chr(10) || string_agg(row, chr(10) ORDER BY o_orderkey) AS text FROM r GROUP BY 1")
def t20_t21_tables(spark, sf_dir):
    """The orders of a customer as one compact table."""
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.replace("o_orderpriority", F.lit("-"), F.lit(",")).alias("priority"))))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(items.alias("i")).select("o_custkey", toon(F.col("i"), ["id", "status", "priority"]).alias("text"))


def short_description(text: Column, longest: int = 80) -> Column:
    """The first sentence of a description without Markdown, cut at a length."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[*_`#]+", ""), r"\s+", " "))
    first = F.regexp_extract(plain, r"^(.*?[.!?])(?:\s|$)", 1)
    out = F.when(first != "", first).otherwise(plain)
    return F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest - 3), F.lit("..."))).otherwise(out)


@query("WITH p AS (SELECT item_id, trim(regexp_replace(regexp_replace('**' || text || '**', '[*_`#]+', '', 'g'), '\\s+', ' ', 'g')) AS p FROM benchmark), f AS (SELECT *, regexp_extract(p, '^(.*?[.!?])(?:\\s|$)', 1) AS f FROM p), o AS (SELECT item_id, CASE WHEN f <> '' THEN f ELSE p END AS o FROM f) SELECT item_id, CASE WHEN length(o) > 80 THEN left(o, 77) || '...' ELSE o END AS description FROM o")
def t33_short_descriptions(spark, sf_dir):
    """Descriptions cut to their first sentence."""
    return read(spark, sf_dir, "benchmark").select("item_id", short_description(F.concat(F.lit("**"), "text", F.lit("**"))).alias("description"))


@query("WITH t AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations) SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(string_split(before, chr(10)), x)))::INT AS added, len(list_filter(string_split(before, chr(10)), lambda x: NOT list_contains(string_split(text, chr(10)), x)))::INT AS removed FROM t")
def t34_differences(spark, sf_dir):
    """Lines that a response adds to and removes from the one before."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("a"), F.split(before, "\n").alias("b"))
    only = lambda x, y: F.size(F.filter(x, lambda v: ~F.array_contains(F.col(y), v)))
    return rows.select("conv_id", "turn", only("a", "b").alias("added"), only("b", "a").alias("removed"))


@query("WITH t AS (SELECT doc_id, 'keep <note id=\"' || doc_id || '\">inner ' || doc_id || '</note> and <b>bold</b>' AS t FROM documents), p AS (SELECT doc_id, t, regexp_extract(t, '<note[^>]*>.*?</note>') AS tag FROM t) SELECT doc_id, replace(t, tag, '{{TAG_0}}') AS protected, replace(replace(t, tag, '{{TAG_0}}'), '{{TAG_0}}', tag) = t AS restored FROM p")
def t36_protected_tags(spark, sf_dir):
    """Custom tags replaced by a placeholder, and put back unchanged."""
    d = F.col("doc_id").cast("string")
    t = F.concat(F.lit('keep <note id="'), d, F.lit('">inner '), d, F.lit("</note> and <b>bold</b>"))
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.regexp_extract(t, "<note[^>]*>.*?</note>", 0).alias("tag"))
    hidden = F.replace("t", F.col("tag"), F.lit("{{TAG_0}}"))
    return rows.select("doc_id", hidden.alias("protected"), (F.replace(hidden, F.lit("{{TAG_0}}"), F.col("tag")) == F.col("t")).alias("restored"))


_RULES = {"git status": "status", "git diff": "diff", "git log": "log", "pytest": "tests", "npm test": "tests", "ls": "listing"}


@query("WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'git status -s' WHEN 1 THEN 'git diff HEAD~1' WHEN 2 THEN 'pytest' WHEN 3 THEN 'lsof -i' WHEN 4 THEN ' ls -la' ELSE 'npm testing' END AS c FROM events) SELECT event_id, CASE " + " ".join(f"WHEN trim(c) = '{p}' OR starts_with(trim(c), '{p} ') THEN '{t}'" for p, t in _RULES.items()) + " END AS content FROM c")
def t41_command_rules(spark, sf_dir):
    """What a command's output holds, by the first rule whose prefix it has."""
    commands = ["git status -s", "git diff HEAD~1", "pytest", "lsof -i", " ls -la", "npm testing"]
    c = F.trim(F.element_at(F.array(*map(F.lit, commands)), (F.col("event_id") % 6 + 1).cast("int")))
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(_RULES.items()):
        out = F.when((c == prefix) | c.startswith(prefix + " "), kind).otherwise(out)
    return read(spark, sf_dir, "events").select("event_id", out.alias("content"))


@query("WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), s AS (SELECT doc_id, len(l[1:100]) AS n, len(list_distinct(l[1:100])) AS u, len(list_filter(l[1:100], lambda x: length(x) < 20)) AS short FROM l) SELECT doc_id, round(0.5::DOUBLE * (1 - u / n) + 0.5::DOUBLE * short / n, 6) AS log_bloat FROM s")
def t44_bloat(spark, sf_dir):
    """How bloated the first hundred lines of a text are: repeated and thin ones."""
    l = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 100)  # noqa: E741
    n = F.size(l)
    return read(spark, sf_dir, "documents").select("doc_id", F.round(0.5 * (1 - F.size(F.array_distinct(l)) / n) + 0.5 * F.size(F.filter(l, lambda x: F.length(x) < 20)) / n, 6).alias("log_bloat"))


QUERIES, ORACLES = query.queries, query.oracles
