"""Predicates and detectors over one text: volatile tokens, sensitive spans, content types, intents, redaction."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from marlstone.operators.lines import ANALYSIS, RAG, SECURITY
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

# Shapes of tokens that change from call to call.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
JWT = "[A-Za-z0-9_-]{4,}\\.[A-Za-z0-9_-]{4,}\\.[A-Za-z0-9_-]{4,}"
ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
HEX = "(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})"
# Line patterns of the content types.
DIFF_HEAD = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-[0-9]+,[0-9]+\s+\+[0-9]+,[0-9]+\s+@@)"
DIFF_CHANGE = r"^[+-][^+-]"
SEARCH_LINE = r"^[^\s:]+:[0-9]+:"
LOG_LOUD = r"(?i)(^|[^A-Za-z0-9_])(ERROR|FAIL|FAILED|FATAL|CRITICAL|WARN|WARNING)([^A-Za-z0-9_]|$)"
LOG_LINE = r"(?i)(^|[^A-Za-z0-9_])(INFO|DEBUG|TRACE)([^A-Za-z0-9_]|$)|^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}|^\s*\[[0-9]{2}:[0-9]{2}:[0-9]{2}\]|^={3,}|^-{3,}|^npm ERR!|^yarn error|^cargo error|Traceback \(most recent call last\)|^\s*at\s+[A-Za-z0-9_.$]+\("
STRUCTURE = r"(?i)<(div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[\s>]"
CODE_LINE = r"^\s*(def|class|import|from|async def|function|const|let|var|export|interface|type|enum|func|package|fn|struct|impl|mod|use|pub)\s+[A-Za-z0-9_]+"


def trimmed_tokens(text: Column) -> Column:
    """Words of a text without the punctuation around them."""
    words = F.transform(F.split(text, r"[ \t\n\r]+"), lambda w: F.regexp_replace(F.regexp_replace(w, "^[.,;:!?\"'()\\[\\]{}<>]+", ""), "[.,;:!?\"'()\\[\\]{}<>]+$", ""))
    return F.filter(words, lambda w: w != "")


def volatile(token: Column) -> Column:
    """uuid, jwt, iso8601, hex_hash or null."""
    whole = lambda p: token.rlike(f"^(?:{p})$")
    return F.when(whole(UUID), "uuid").when(whole(JWT), "jwt").when(whole(ISO), "iso8601").when(whole(HEX), "hex_hash")


def content_type(text: Column) -> tuple[Column, Column]:
    """(type, confidence) of a text: the first of JSON array, diff, HTML, search results, build output, table, code, text."""
    lines = F.split(text, "\n")
    count = lambda top, p: F.size(F.filter(F.slice(lines, 1, top), lambda x: x.rlike(p)))
    full = lambda top: F.size(F.filter(F.slice(lines, 1, top), lambda x: F.trim(x) != ""))
    parsed = F.from_json(text, "array<variant>")
    dicts = F.size(F.filter(parsed, lambda v: ~F.schema_of_variant(v).startswith("OBJECT"))) == 0
    is_json = F.trim(text).startswith("[") & parsed.isNotNull()
    heads, changes = count(500, DIFF_HEAD), count(500, DIFF_CHANGE)
    sample = F.substring(text, 1, 3000)
    doctype, html, head, body = (sample.rlike(p) for p in (r"(?i)^\s*<!doctype\s+html", r"(?i)<html[\s>]", r"(?i)<head[\s>]", r"(?i)<body[\s>]"))
    tags = F.size(F.regexp_extract_all(sample, F.lit(STRUCTURE), F.lit(0)))
    page = F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for c, w in ((doctype, 0.5), (html, 0.3), (head, 0.1), (body, 0.1))), F.lit(0.0)) + F.least(F.lit(0.3), tags * 0.03))
    found = F.try_divide(count(100, SEARCH_LINE), full(100))
    loud = F.size(F.filter(F.slice(lines, 1, 200), lambda x: x.rlike(LOG_LOUD)))
    logged = F.size(F.filter(F.slice(lines, 1, 200), lambda x: x.rlike(LOG_LOUD) | x.rlike(LOG_LINE)))
    log = F.try_divide(logged, full(200))
    rows = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 20)
    commas = F.transform(rows, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    first = F.element_at(commas, 1)
    table = (F.size(rows) >= 3) & (first > 0) & (F.size(F.filter(commas, lambda c: c == first)) >= F.size(rows) * 0.85) & ~F.exists(rows, lambda x: F.rtrim(x).rlike("[.!?]$"))
    code = F.size(F.filter(F.slice(lines, 1, 100), lambda x: x.rlike(CODE_LINE)))
    cases = [
        (is_json, "json_array", F.when(dicts & (F.size(parsed) > 0), 1.0).otherwise(0.8)),
        (heads > 0, "git_diff", F.least(F.lit(1.0), 0.5 + heads * 0.2 + changes * 0.05)),
        ((doctype | html | (tags >= 3)) & (page >= 0.5), "html", page),
        (found >= 0.3, "search_results", F.least(F.lit(1.0), 0.4 + found * 0.6)),
        ((logged > 0) & (log >= 0.1), "build_output", F.least(F.lit(1.0), 0.3 + log * 0.5 + loud * 0.05)),
        (table, "tabular", F.least(F.lit(0.95), 0.8 + F.least(first + 1, F.lit(5)) * 0.03)),
        (code >= 3, "source_code", F.least(F.lit(1.0), 0.5 + code * 0.03)),
    ]
    kind = sure = None
    for test, name, confidence in cases:
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        sure = F.when(test, confidence) if sure is None else sure.when(test, confidence)
    return kind.otherwise("plain_text"), F.round(sure.otherwise(0.5), 4)


_TEXTS = """t AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '[{"a": 1}, {"a": ' || doc_id || '}]' WHEN 1 THEN '[1, "x"]' WHEN 2 THEN 'diff --git a/x b/x' || chr(10) || '-old' || chr(10) || '+new ' || doc_id WHEN 3 THEN 'a/b.py:3:hit' || chr(10) || 'a/c.py:4:hit' || chr(10) || 'other' WHEN 4 THEN 'ERROR one' || chr(10) || 'INFO two' || chr(10) || 'three' || chr(10) || coalesce(left(text, 40), '') WHEN 5 THEN 'a,b,c' || chr(10) || '1,2,3' || chr(10) || '4,5,' || doc_id || chr(10) || '7,8,9' WHEN 6 THEN 'import os' || chr(10) || 'def f(x):' || chr(10) || 'class A:' || chr(10) || 'def g(x):' ELSE coalesce(text, '') END AS text FROM documents UNION ALL SELECT 1000000 + page_id, coalesce(html, '') FROM pages)"""


def _texts(spark, sf_dir):
    """Texts of all content types."""
    d, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    text = (
        F.when(kind == 0, F.concat(F.lit('[{"a": 1}, {"a": '), d, F.lit("}]"))).when(kind == 1, '[1, "x"]').when(kind == 2, F.concat(F.lit("diff --git a/x b/x\n-old\n+new "), d))
        .when(kind == 3, "a/b.py:3:hit\na/c.py:4:hit\nother").when(kind == 4, F.concat(F.lit("ERROR one\nINFO two\nthree\n"), F.coalesce(F.substring("text", 1, 40), F.lit(""))))
        .when(kind == 5, F.concat(F.lit("a,b,c\n1,2,3\n4,5,"), d, F.lit("\n7,8,9"))).when(kind == 6, "import os\ndef f(x):\nclass A:\ndef g(x):").otherwise(F.coalesce("text", F.lit("")))
    )
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text")).unionByName(pages)


def _q(p):
    return p.replace("'", "''")


_TYPED = f"""WITH {_TEXTS}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, left(text, 3000) AS s, CASE WHEN starts_with(trim(text), '[') AND json_valid(text) THEN json_array_length(text) END AS n FROM t),
f AS (SELECT *, CASE WHEN n IS NOT NULL THEN len(list_filter(CAST(json_extract(text, '$[*]') AS JSON[]), lambda v: json_type(v) <> 'OBJECT')) END AS odd, len(list_filter(l[1:500], lambda x: regexp_matches(x, '{DIFF_HEAD}'))) AS heads, len(list_filter(l[1:500], lambda x: regexp_matches(x, '{DIFF_CHANGE}'))) AS changes, regexp_matches(s, '(?i)^\\s*<!doctype\\s+html') AS a, regexp_matches(s, '(?i)<html[\\s>]') AS b, regexp_matches(s, '(?i)<head[\\s>]') AS c, regexp_matches(s, '(?i)<body[\\s>]') AS d, len(regexp_extract_all(s, '{STRUCTURE}')) AS tags,
 len(list_filter(l[1:100], lambda x: regexp_matches(x, '{SEARCH_LINE}'))) / nullif(len(list_filter(l[1:100], lambda x: trim(x) <> '')), 0) AS found, len(list_filter(l[1:200], lambda x: regexp_matches(x, '{LOG_LOUD}'))) AS loud, len(list_filter(l[1:200], lambda x: regexp_matches(x, '{LOG_LOUD}') OR regexp_matches(x, '{LOG_LINE}'))) AS logged, nullif(len(list_filter(l[1:200], lambda x: trim(x) <> '')), 0) AS full200, list_filter(l, lambda x: trim(x) <> '')[1:20] AS r, len(list_filter(l[1:100], lambda x: regexp_matches(x, '{CODE_LINE}'))) AS code FROM l),
g AS (SELECT *, least(1.0::DOUBLE, a::INT * 0.5 + b::INT * 0.3 + c::INT * 0.1 + d::INT * 0.1 + least(0.3::DOUBLE, tags * 0.03)) AS page, list_transform(r, lambda x: length(x) - length(replace(x, ',', ''))) AS commas FROM f),
h AS (SELECT *, len(r) >= 3 AND commas[1] > 0 AND len(list_filter(commas, lambda c: c = commas[1])) >= len(r) * 0.85::DOUBLE AND len(list_filter(r, lambda x: regexp_matches(rtrim(x), '[.!?]$'))) = 0 AS tab FROM g)
SELECT doc_id, CASE WHEN n IS NOT NULL THEN 'json_array' WHEN heads > 0 THEN 'git_diff' WHEN (a OR b OR tags >= 3) AND page >= 0.5 THEN 'html' WHEN found >= 0.3 THEN 'search_results' WHEN logged > 0 AND logged / full200 >= 0.1 THEN 'build_output' WHEN tab THEN 'tabular' WHEN code >= 3 THEN 'source_code' ELSE 'plain_text' END AS type,
 round(CASE WHEN n IS NOT NULL THEN CASE WHEN odd = 0 AND n > 0 THEN 1.0 ELSE 0.8 END WHEN heads > 0 THEN least(1.0::DOUBLE, 0.5 + heads * 0.2 + changes * 0.05) WHEN (a OR b OR tags >= 3) AND page >= 0.5 THEN page WHEN found >= 0.3 THEN least(1.0::DOUBLE, 0.4 + found * 0.6) WHEN logged > 0 AND logged / full200 >= 0.1 THEN least(1.0::DOUBLE, 0.3 + logged / full200 * 0.5 + loud * 0.05) WHEN tab THEN least(0.95::DOUBLE, 0.8 + least(commas[1] + 1, 5) * 0.03) WHEN code >= 3 THEN least(1.0::DOUBLE, 0.5 + code * 0.03) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM h"""


@query(_TYPED)
def t1_content_types(spark, sf_dir):
    """The content type of texts of eight kinds, and how sure it is."""
    kind, sure = content_type(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", kind.alias("type"), sure.alias("confidence"))


@query(f"WITH {_TEXTS}, k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?m){DIFF_HEAD}') THEN 'git_diff' ELSE 'plain_text' END AS type FROM t) SELECT type, count(*) AS n FROM k GROUP BY 1")
def t2_rule_chain(spark, sf_dir):
    """The chain of rules without a model: a diff, or plain text."""
    kind = F.when(F.col("text").rlike(f"(?m){DIFF_HEAD}"), "git_diff").otherwise("plain_text")
    return _texts(spark, sf_dir).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


_MIXED = "m AS (SELECT doc_id, coalesce(left(text, 300), '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '{\"a\": 1}' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'a.py:3:x' ELSE '' END AS text FROM documents)"


def _mixed(spark, sf_dir):
    some = lambda n, t: F.when(F.col("doc_id") % n == 0, t).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce(F.substring("text", 1, 300), F.lit("")), some(3, "\n```py\nx = 1\n```"), some(4, '\n{"a": 1}'), some(5, "\na.py:3:x")).alias("text"))


def mixed_content(text: Column) -> Column:
    """Whether a text has two or more of code fences, JSON blocks, prose and search results."""
    prose = F.size(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+\\s+[A-Za-z0-9_]+\\s+[A-Za-z0-9_]+"), F.lit(0))) > 5
    tests = [text.rlike("(?m)^```([A-Za-z0-9_]*)\\s*$"), text.rlike("(?m)^\\s*[\\[{]"), prose, text.rlike("(?m)^\\S+:[0-9]+:")]
    return sum((t.cast("int") for t in tests), F.lit(0)) >= 2


@query(f"WITH {_MIXED} SELECT doc_id, regexp_matches(text, '(?m)^```([A-Za-z0-9_]*)\\s*$')::INT + regexp_matches(text, '(?m)^\\s*[\\[{{]')::INT + (len(regexp_extract_all(text, '[A-Z][a-z]+\\s+[A-Za-z0-9_]+\\s+[A-Za-z0-9_]+')) > 5)::INT + regexp_matches(text, '(?m)^\\S+:[0-9]+:')::INT >= 2 AS mixed FROM m")
def f21_mixed_content(spark, sf_dir):
    """Which texts are of several kinds."""
    return _mixed(spark, sf_dir).select("doc_id", mixed_content(F.col("text")).alias("mixed"))


_SECTIONS = f"""WITH {_MIXED}, l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM m)),
a AS (SELECT *, regexp_matches(line, '^```') AS fence, sum(regexp_matches(line, '^```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM l),
b AS (SELECT *, CASE WHEN f % 2 = 1 OR fence THEN 'code' WHEN regexp_matches(line, '^\\s*[\\[{{].*[\\]}}]\\s*$') THEN 'json' WHEN regexp_matches(line, '^\\S+:[0-9]+:') THEN 'search' ELSE 'text' END AS type FROM a),
c AS (SELECT *, sum((type IS DISTINCT FROM before OR (fence AND f % 2 = 1))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b))
SELECT doc_id, CAST(section AS BIGINT) AS section, min(type) AS type, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM c GROUP BY 1, 2"""


def sections(texts):
    """(doc_id, section, type, text): fenced code, one-line JSON, search results and other text, in order."""
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("fence", F.col("line").startswith("```"))
    lines = lines.withColumn("f", F.sum(F.col("fence").cast("int")).over(w))
    kind = F.when((F.col("f") % 2 == 1) | F.col("fence"), "code").when(F.col("line").rlike(r"^\s*[\[{].*[\]}]\s*$"), "json").when(F.col("line").rlike(r"^\S+:[0-9]+:"), "search").otherwise("text")
    lines = lines.withColumn("type", kind)
    new = ~F.col("type").eqNullSafe(F.lag("type").over(w)) | (F.col("fence") & (F.col("f") % 2 == 1))
    lines = lines.withColumn("new", new.cast("int")).withColumn("section", F.sum("new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("doc_id", "section").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n_lines"), joined.alias("text"))


@query(_SECTIONS)
def t3_sections(spark, sf_dir):
    """Mixed texts cut into typed sections."""
    return sections(_mixed(spark, sf_dir)).select("doc_id", "section", "type", "n_lines", F.md5("text").alias("text_md5"))


@query(_TYPED.replace("SELECT doc_id, CASE WHEN n IS NOT NULL", "SELECT CASE type WHEN 'json_array' THEN 'smart_crusher' WHEN 'git_diff' THEN 'diff' WHEN 'html' THEN 'html' WHEN 'search_results' THEN 'search' WHEN 'build_output' THEN 'log' WHEN 'tabular' THEN 'tabular' WHEN 'source_code' THEN 'code_aware' ELSE 'text' END AS strategy, count(*) AS n, sum((small < size)::INT)::BIGINT AS smaller FROM (SELECT length(text) AS size, length(regexp_replace(text, '\\s+', ' ', 'g')) AS small, CASE WHEN n IS NOT NULL", 1).rsplit(",\n round(CASE", 1)[0] + " FROM h) GROUP BY 1")
def t4_routes(spark, sf_dir):
    """The strategy for each text by its type, and how often squeezing white space gives a smaller one that is accepted."""
    kind, _ = content_type(F.col("text"))
    route = {"json_array": "smart_crusher", "git_diff": "diff", "html": "html", "search_results": "search", "build_output": "log", "tabular": "tabular", "source_code": "code_aware"}
    out = F.lit("text")
    for name, strategy in route.items():
        out = F.when(F.col("type") == name, strategy).otherwise(out)
    small = F.length(F.regexp_replace("text", r"\s+", " ")) < F.length("text")
    return _texts(spark, sf_dir).withColumn("type", kind).groupBy(out.alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.count_if(small).alias("smaller"))


_VOL = "v AS (SELECT event_id, 'id ' || CASE event_id % 6 WHEN 0 THEN '(550e8400-e29b-41d4-a716-' || lpad(event_id::VARCHAR, 12, '0') || '),' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z.' WHEN 2 THEN md5(event_id::VARCHAR) WHEN 3 THEN 'eyJhbGci.' || md5(event_id::VARCHAR) || '.sig_' || event_id ELSE 'plain' || event_id END || ' end' AS text FROM events)"


@query(f"WITH {_VOL}, w AS (SELECT event_id, regexp_replace(regexp_replace(unnest(string_split_regex(text, '[ \\t\\n\\r]+')), '^[.,;:!?\"''()\\[\\]{{}}<>]+', ''), '[.,;:!?\"''()\\[\\]{{}}<>]+$', '') AS token FROM v), c AS (SELECT *, CASE WHEN regexp_full_match(token, '{UUID}') THEN 'uuid' WHEN regexp_full_match(token, '{JWT}') THEN 'jwt' WHEN regexp_full_match(token, '{ISO}') THEN 'iso8601' WHEN regexp_full_match(token, '{HEX}') THEN 'hex_hash' END AS kind FROM w) SELECT event_id, token, kind FROM c WHERE kind IS NOT NULL")
def f16_volatile_tokens(spark, sf_dir):
    """Tokens that change from call to call, with their kind."""
    i, kind = F.col("event_id").cast("string"), F.col("event_id") % 6
    part = (
        F.when(kind == 0, F.concat(F.lit("(550e8400-e29b-41d4-a716-"), F.lpad(i, 12, "0"), F.lit("),"))).when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z.")))
        .when(kind == 2, F.md5(i)).when(kind == 3, F.concat(F.lit("eyJhbGci."), F.md5(i), F.lit(".sig_"), i)).otherwise(F.concat(F.lit("plain"), i))
    )
    tokens = read(spark, sf_dir, "events").select("event_id", F.explode(trimmed_tokens(F.concat(F.lit("id "), part, F.lit(" end")))).alias("token"))
    return tokens.withColumn("kind", volatile(F.col("token"))).where("kind is not null")


#: Kinds of spans that change, in the order in which they claim text.
SPANS = {"uuid": UUID, "datetime": "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "ip": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "number": "[0-9]{4,}"}


@query("WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(f"r{k} AS (SELECT doc_id, {', '.join(f'n{j}' for j in range(k)) + ', ' if k else ''}len(regexp_extract_all(t, '{p}')) AS n{k}, regexp_replace(t, '{p}', '*', 'g') AS t FROM r{k - 1 if k else ''})" for k, p in enumerate(SPANS.values())) + " SELECT doc_id, " + ", ".join(f"n{k}::INT AS {name}" for k, name in enumerate(SPANS)) + f" FROM r{len(SPANS) - 1}")
def f17_dynamic_spans(spark, sf_dir):
    """Spans of each text that change from call to call, each counted under the first kind that claims it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for name, pattern in SPANS.items():
        rows = rows.withColumn(name, F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))).withColumn("t", F.regexp_replace("t", pattern, "*"))
    return rows.drop("t")


_CHAT = "c AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN coalesce(text, '') || ' [Document 3]' WHEN 1 THEN 'Can you REVIEW this? ' || left(coalesce(text, ''), 50) WHEN 2 THEN 'see CVE-2024-' || (1000 + conv_id) ELSE coalesce(text, '') END AS text FROM conversations)"


def _chat(spark, sf_dir):
    turn, text = F.col("turn") % 5, F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(turn == 0, F.concat(text, F.lit(" [Document 3]"))).when(turn == 1, F.concat(F.lit("Can you REVIEW this? "), F.substring(text, 1, 50))).when(turn == 2, F.concat(F.lit("see CVE-2024-"), (F.col("conv_id") + 1000).cast("string"))).otherwise(text).alias("text"))


@query(f"WITH {_CHAT} SELECT conv_id, turn, regexp_matches(text, '{RAG}') AS rag, regexp_matches(text, '{SECURITY}') AS security, role = 'assistant' AND length(text) >= 200 AS dedup FROM c")
def f19_f20_f23_message_flags(spark, sf_dir):
    """Messages with retrieved documents, with security warnings, and long enough to be deduplicated."""
    text = F.col("text")
    return _chat(spark, sf_dir).select("conv_id", "turn", text.rlike(RAG).alias("rag"), text.rlike(SECURITY).alias("security"), ((F.col("role") == "assistant") & (F.length(text) >= 200)).alias("dedup"))


@query(f"WITH {_CHAT}, u AS (SELECT conv_id, arg_max(text, turn) AS text FROM c WHERE role = 'user' GROUP BY 1) SELECT conv_id, regexp_matches(lower(text), '{'|'.join(ANALYSIS)}') AS analysis FROM u")
def f22_analysis_intent(spark, sf_dir):
    """Whether the last user message of a conversation asks for an analysis."""
    last = _chat(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", F.lower("text").rlike("|".join(ANALYSIS)).alias("analysis"))


def redact_images(text: Column, least: int = 100) -> Column:
    return F.regexp_replace(text, f"data:image/[a-z]+;base64,[A-Za-z0-9+/=]{{{least},}}", "[image removed]")


@query("SELECT event_id, regexp_replace('{\"img\": \"data:image/png;base64,' || repeat('QUJD', CAST(floor(value) AS INT) % 60) || '\", \"k\": ' || props || '}', 'data:image/[a-z]+;base64,[A-Za-z0-9+/=]{100,}', '[image removed]', 'g') AS payload FROM events")
def f25_redacted_images(spark, sf_dir):
    """Payloads whose embedded images over a length are replaced."""
    payload = F.concat(F.lit('{"img": "data:image/png;base64,'), F.expr("repeat('QUJD', cast(value as int) % 60)"), F.lit('", "k": '), "props", F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", redact_images(payload).alias("payload"))


def query_anchors(text: Column) -> Column:
    """UUIDs, numbers of four digits or more, quoted strings and e-mail addresses of a query, in lower case."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((UUID, 0), ("[0-9]{4,}", 0), ("['\"]([^'\"]{2,50})['\"]", 1), (SPANS["email"], 0))]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), F.lower))


_QUERY = """why did order 5979 of "1-URGENT" fail? mail a.b@c.org or see 12"""


@query(f"SELECT o_orderkey FROM orders WHERE len(list_filter(list_transform(list_concat(regexp_extract_all('{_QUERY}', '{UUID}'), regexp_extract_all('{_QUERY}', '[0-9]{{4,}}'), regexp_extract_all('{_QUERY}', '[\"]([^\"]{{2,50}})[\"]', 1), regexp_extract_all('{_QUERY}', '{SPANS['email']}')), lambda a: lower(a)), lambda a: contains(lower(concat_ws(' ', o_orderkey, o_orderstatus, o_orderpriority)), a))) > 0")
def f26_anchor_matches(spark, sf_dir):
    """Orders whose text holds an anchor of a query."""
    item = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return read(spark, sf_dir, "orders").where(F.exists(query_anchors(F.lit(_QUERY)), lambda a: F.instr(item, a) > 0)).select("o_orderkey")


@query("SELECT p_partkey, p_brand FROM part WHERE left(sha256('p_brand'), 8) IN (left(sha256('p_brand'), 8)) AND contains('parts of brand#13 and Brand#7', p_brand)")
def f27_preserved_fields(spark, sf_dir):
    """Parts whose learned field, known by the hash of its name, has a value that the query names."""
    learned = spark.createDataFrame([("p_brand",)], "name string").select(F.substring(F.sha2("name", 256), 1, 8).alias("hash"))
    fields = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type"))).alias("name", "value"))
    named = fields.withColumn("hash", F.substring(F.sha2("name", 256), 1, 8)).join(F.broadcast(learned), "hash", "left_semi")
    return named.where(F.contains(F.lit("parts of brand#13 and Brand#7"), F.col("value"))).select("p_partkey", "p_brand")


QUERIES, ORACLES = query.queries, query.oracles
