"""Text features and line-wise reductions, each inside its own row wherever no grouping is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.sources.tables import read

_WORD = r"[^\x20\x09-\x0D]+"
# The error keywords, in their order.
ERROR_KEYWORDS = "error exception failed failure critical fatal crash panic abort timeout denied rejected".split()
# Log levels by precedence.
LEVELS = (("ERROR", "ERROR|FATAL|CRITICAL|error|fatal|critical|Error|Fatal|Critical"), ("FAIL", "FAIL|FAILED|fail|failed|Fail|Failed"), ("WARN", "WARN|WARNING|warn|warning|Warn|Warning"), ("INFO", "INFO|info|Info"), ("DEBUG", "DEBUG|debug|Debug"), ("TRACE", "TRACE|trace|Trace"))


def _count(text, pattern):
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _lines():
    return F.transform(F.split("text", "\n"), lambda x: F.trim(x))


def text_counts(spark, sf_dir):
    """Characters, words, lines, sentence ends and paragraphs of each document."""
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        _count("text", _WORD).alias("n_words"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        _count("text", "[.!?]+").alias("n_sentences"),
        F.size(F.filter(F.split("text", "\n\n"), lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"),
    )


def character_ratios(spark, sf_dir):
    """Shares of upper-case letters, digits and blanks."""
    share = lambda keep: F.round(F.length(F.regexp_replace("text", f"[^{keep}]", "")) / F.greatest(F.length("text"), F.lit(1)), 6)
    return _docs(spark, sf_dir).select("doc_id", share("A-Z").alias("upper"), share("0-9").alias("digit"), share(r"\x20\x09-\x0D").alias("blank"))


def lexical_richness(spark, sf_dir):
    """Type-token ratio, share of words used once, Yule's K, over lower-case ASCII words."""
    words = _docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("c") == 1).alias("once"), F.sum(F.col("c") * F.col("c")).alias("m2"))
    return per.select(
        "doc_id", F.round(F.col("types") / F.col("n"), 6).alias("type_token"), F.round(F.col("once") / F.col("n"), 6).alias("hapax"),
        F.round(10000.0 * (F.col("m2") - F.col("n")) / (F.col("n") * F.col("n")), 4).alias("yule_k"),
    )


def log_levels(spark, sf_dir):
    """Lines built from events, counted by the first level that they name."""
    line = F.concat_ws(" ", F.upper("event_type"), "props")
    level = F.lit("OTHER")
    for name, words in reversed(LEVELS):
        level = F.when(line.rlike(f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"), name).otherwise(level)
    return read(spark, sf_dir, "events").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def collapsed_lines(spark, sf_dir):
    """Lines of each document before and after runs of equal trimmed lines become one."""
    docs = _docs(spark, sf_dir).select("doc_id", _lines().alias("l"))
    runs = F.filter("l", lambda x, i: (i == 0) | (x != F.get("l", i - 1)))
    return docs.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(runs).cast("long").alias("n_runs"))


def distinct_lines(spark, sf_dir):
    """Distinct trimmed lines that are not empty, in each document."""
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(F.filter(_lines(), lambda x: x != ""))).cast("long").alias("n_distinct"))


def dropped_paragraphs(spark, sf_dir):
    """Paragraphs equal, when trimmed, to an earlier one of their document."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    docs = _docs(spark, sf_dir).select("doc_id", parts.alias("p"))
    return docs.select("doc_id", (F.size("p") - F.size(F.array_distinct("p"))).cast("long").alias("n_dropped"))


def html_waste(spark, sf_dir):
    """Tags, comments and long white space of each page."""
    html = F.coalesce("html", F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", _count(html, "<[^>]+>").alias("n_tags"), _count(html, "<!--").alias("n_comments"), _count(html, r"[ \t]{4,}|\n{3,}").alias("n_blank_runs"))


def token_estimate(spark, sf_dir):
    """Estimated tokens by source, at 4 characters a token and at least 1 a document."""
    docs = read(spark, sf_dir, "documents")
    estimate = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4.0 + 0.5)).cast("long")
    return docs.groupBy("source").agg(F.sum(estimate).cast("long").alias("tokens"))


_FUNCTIONS = (text_counts, character_ratios, lexical_richness, log_levels, collapsed_lines, distinct_lines, dropped_paragraphs, html_waste, token_estimate)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_L = f"(SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS l FROM {_D})"
_P = f"(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM {_D})"
_SHARE = "round(length(regexp_replace(text, '[^{0}]', '', 'g')) / greatest(length(text), 1), 6) AS {1}"
_LEVEL = " ".join(rf"WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])({w})([^A-Za-z0-9_]|$)') THEN '{n}'" for n, w in LEVELS)
ORACLES = {
    "text_counts": rf"SELECT doc_id, length(text)::BIGINT AS n_chars, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(text, '[.!?]+'))::BIGINT AS n_sentences, p.n AS n_paragraphs FROM {_D} JOIN (SELECT doc_id AS k, len(p)::BIGINT AS n FROM {_P}) p ON doc_id = k",
    "character_ratios": f"SELECT doc_id, {_SHARE.format('A-Z', 'upper')}, {_SHARE.format('0-9', 'digit')}, {_SHARE.format(r'\x20\x09-\x0D', 'blank')} FROM {_D}",
    "lexical_richness": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {_D}), c AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY ALL), p AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*) AS types, count(*) FILTER (c = 1) AS once, sum(c * c)::DOUBLE AS m2 FROM c GROUP BY 1) SELECT doc_id, round(types / n, 6) AS type_token, round(once / n, 6) AS hapax, round(10000.0::DOUBLE * (m2 - n) / (n * n), 4) AS yule_k FROM p",
    "log_levels": f"SELECT CASE {_LEVEL} ELSE 'OTHER' END AS level, count(*) AS n FROM (SELECT concat_ws(' ', upper(event_type), props) AS line FROM events) GROUP BY 1",
    "collapsed_lines": f"SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]))::BIGINT AS n_runs FROM {_L}",
    "distinct_lines": f"SELECT doc_id, len(list_distinct(list_filter(l, lambda x: x <> '')))::BIGINT AS n_distinct FROM {_L}",
    "dropped_paragraphs": f"SELECT doc_id, (len(p) - len(list_distinct(p)))::BIGINT AS n_dropped FROM {_P}",
    "html_waste": r"SELECT page_id, len(regexp_extract_all(h, '<[^>]+>'))::BIGINT AS n_tags, len(regexp_extract_all(h, '<!--'))::BIGINT AS n_comments, len(regexp_extract_all(h, '[ \t]{4,}|\n{3,}'))::BIGINT AS n_blank_runs FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)",
    "token_estimate": "SELECT source, sum(greatest(1, floor(length(coalesce(text, '')) / 4.0::DOUBLE + 0.5)::BIGINT))::BIGINT AS tokens FROM documents GROUP BY 1",
}
