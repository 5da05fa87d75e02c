"""Line reducers: classify, score and select the lines of logs, search results, diffs and build output.

A table of lines has `doc`, `idx` (0, 1, ...) and `line`. Reducers are windows over `doc`, so that very many documents
are reduced at once, and return the kept lines with their places. Text functions are Columns over one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.operators.text import ERROR_KEYWORDS, LEVELS
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

# Windows need a session: they are made where they are used.
def _by():
    return Window.partitionBy("doc")


def _in_order():
    return _by().orderBy("idx")


def _upto():
    return _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)

# Line patterns that open a stack trace, and that mark a summary.
STACK_STARTS = [r"^\s*Traceback \(most recent call last\)", r'^\s*File ".+", line [0-9]+', r"^\s*at .+\(.+:[0-9]+:[0-9]+\)", r"^\s+at [A-Za-z0-9_.$]+\(", r"^\s*--> .+:[0-9]+:[0-9]+", r"^\s*[0-9]+:\s+0x[0-9a-f]+"]
SUMMARIES = ["^={3,}", "^-{3,}", "^[0-9]+ (passed|failed|skipped|error|warning)", r"^(?:Tests?|Suites?):?\s+[0-9]+", "^(?:TOTAL|Total|Summary)", "^(?:Build|Compile|Test).*(?:succeeded|failed|complete)"]
# The score of each level.
SCORES = {"ERROR": 1.0, "FAIL": 1.0, "WARN": 0.5, "INFO": 0.1, "DEBUG": 0.05, "TRACE": 0.02}
# Markers of log formats, in order.
FORMATS = {
    "pytest": ["=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "],
    "npm": ["npm ERR!", "npm WARN", "npm info", "npm http"],
    "cargo": ["Compiling ", "Finished ", "Running ", "warning: ", "error[E"],
    "jest": ["PASS ", "FAIL ", "Test Suites:"],
    "make": ["make[", "make:", "gcc ", "g++ ", "clang "],
}
# Words of importance by category.
SIGNAL_WORDS = {
    "error": "error exception fail failed failure fatal critical crash panic abort timeout denied rejected".split(),
    "warning": "warn warning".split(),
    "importance": "important note todo fixme hack xxx bug fix".split(),
    "security": "security auth password secret".split(),
}
SIGNAL_PRIORITY = {"error": 0.95, "warning": 0.75, "security": 0.85, "importance": 0.6}
MARKDOWN = ["# ", "## ", "### ", "#### ", "**", "> "]
INDICATORS = "error fail exception traceback fatal panic crash".split()
# Terminal control sequences, in the order of their removal.
ESCAPES = ["\x1b\\[[0-9;]*m", "\x1b\\[[0-9;]*[A-HJKSTfh-l]", "\x1b\\].*?(?:\x07|\x1b\\\\)", "\x1b\\[[0-9;]*[a-zA-Z]"]
PROGRESS = "[▓▒░█▌▍▎▏■□●○◐◑◒◓⣾⣽⣻⢿⡿⣟⣯⣷⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\\\-]+\\s*[0-9]+%"
SPINNER = "^[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏⣾⣽⣻⢿⡿⣟⣯⣷◐◑◒◓]+$"
# Paths of frames that belong to a framework, and to the user.
FRAMES = ["node_modules/", r"at\s+Module\._compile", r"at\s+Function\._load", r"at\s+Object\.<anonymous>", "site-packages/", "lib/python[0-9]", "importlib/", r"java\.lang\.reflect\.", r"sun\.reflect\.", r"org\.springframework\.", "runtime/", r"net/http\.", "std::", "core::", "alloc::"]
SECURITY = r"(?i)CVE-[0-9]{4}-[0-9]+|GHSA-|security\s+(?:advisory|vulnerability|warning)"
ANALYSIS = "analyze analyse review audit inspect security vulnerability bug issue problem explain understand debug fix error wrong broken refactor improve optimize".split() + ["how does", "what does", "clean up"]
RAG = r"\[Document\s*[0-9]+\]|\[Source:\s*|<context>|<document>|Retrieved from:"
LOCKFILES = ["package-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock", "pnpm-lock.yaml"]


# --- classification of one line --------------------------------------------------------------------------------------


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def level(line: Column) -> Column:
    """The first level, by precedence, that a line names as a word; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(LEVELS):
        out = F.when(line.rlike(f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"), name).otherwise(out)
    return out


def signal(line: Column, context: str = "text") -> Column:
    """The category of the first signal word: errors and importance, then warnings (diffs: security), then Markdown (text)."""

    def first(*names):
        words = sorted((w for n in names for w in SIGNAL_WORDS[n]), key=len, reverse=True)
        return F.regexp_extract(F.lower(line), f"(?:^|[^a-z0-9_])({'|'.join(words)})(?:[^a-z0-9_]|$)", 1)

    general, second = first("error", "importance"), "security" if context == "diff" else "warning"
    found = F.when(general.isin(SIGNAL_WORDS["error"]), "error").when(general != "", "importance").when(first(second) != "", second)
    return found.when(F.greatest(*[line.startswith(p) for p in MARKDOWN]), "markdown") if context == "text" else found


def priority(category: Column) -> Column:
    out = F.when(category == "markdown", 0.45)
    for name, p in SIGNAL_PRIORITY.items():
        out = out.when(category == name, p)
    return out.otherwise(0.0)


def framework_frame(line: Column) -> Column:
    own = line.rlike("/home/|/workspace/|/project/") | (line.contains("/src/") & ~line.contains("node_modules/"))
    return ~own & any_of(line, FRAMES)


def normalized_warning(line: Column) -> Column:
    """The line up to its first : or =, then with digits, hex numbers and paths replaced, in this order."""
    head = F.regexp_extract(line, "(?s)^[^:=]*", 0)
    rest = F.substring(line, F.length(head) + 1, F.length(line))
    for pattern, name in (("[0-9]+", "N"), ("0x[0-9a-fA-F]+", "ADDR"), ("/[A-Za-z0-9_/]+/", "/PATH/")):
        rest = F.regexp_replace(rest, pattern, name)
    return F.concat(head, rest)


def clean_terminal(text: Column) -> Column:
    """Text without escapes, overwritten parts, progress lines and runs of empty lines."""
    for p in ESCAPES:
        text = F.regexp_replace(text, p, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.element_at(F.split(x, "\r"), -1))
    kept = F.filter(lines, lambda x: ~x.rlike(PROGRESS) & ~F.trim(x).rlike(SPINNER))
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")


def collapse_identical(text: Column) -> Column:
    """Runs of equal trimmed lines become one line with its count."""
    lines = F.split(text, "\n")

    def step(acc, x):
        t = F.trim(x)
        same = (F.size(acc) > 0) & (t != "") & (F.element_at(acc, -1)["t"] == t)
        more = F.struct(t.alias("t"), F.element_at(acc, -1)["raw"].alias("raw"), (F.element_at(acc, -1)["n"] + 1).alias("n"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(F.struct(t.alias("t"), x.alias("raw"), F.lit(1).alias("n")))))

    runs = F.aggregate(lines, F.expr("cast(array() as array<struct<t:string,raw:string,n:int>>)"), step)
    # An empty line has nothing to print but stays where it is not the first of all.
    return F.array_join(F.transform(F.filter(runs, lambda r: (r["n"] > 1) | (r["raw"] != "")), lambda r: F.when(r["n"] > 1, F.format_string("%s (x%d)", r["t"], r["n"])).otherwise(r["raw"])), "\n")


# --- reducers of line tables -----------------------------------------------------------------------------------------


def parse(lines: DataFrame, stack_lines: int = 20) -> DataFrame:
    """Adds level, stack, summary and score. A stack trace runs from its start over `stack_lines` + 1 lines or to a blank one."""
    opens = any_of(F.col("line"), STACK_STARTS)
    start = F.last(F.when(opens, F.col("idx")), ignorenulls=True).over(_upto())
    blank = F.last(F.when(F.trim("line") == "", F.col("idx")), ignorenulls=True).over(_before())
    rows = lines.withColumns({"level": level(F.col("line")), "summary": any_of(F.col("line"), SUMMARIES)})
    inside = start.isNotNull() & (F.col("idx") - start <= stack_lines) & (blank.isNull() | (blank < start))
    rows = rows.withColumn("stack", inside)
    base = F.lit(0.1)
    for name, s in SCORES.items():
        base = F.when(F.col("level") == name, s).otherwise(base)
    score = F.least(F.lit(1.0), base + F.when(F.col("stack"), 0.3).otherwise(0.0) + F.when(F.col("summary"), 0.4).otherwise(0.0))
    return rows.withColumn("score", F.round(score, 4))


def select_log(
    lines: DataFrame, limit: int, max_errors: int = 10, max_warnings: int = 5, max_stacks: int = 3, stack_lines: int = 20, context: int = 3
) -> DataFrame:
    """The lines that stay: errors, failures (first, last, best), distinct warnings, stacks, summaries and their context."""
    rows = parse(lines, stack_lines).withColumn("normal", F.when(F.col("level") == "WARN", normalized_warning(F.col("line"))))
    same = Window.partitionBy("doc", "level")
    first, last = F.row_number().over(same.orderBy("idx")), F.row_number().over(same.orderBy(F.desc("idx")))
    rows = rows.withColumns({"edge": (first == 1) | (last == 1), "of_level": F.count(F.lit(1)).over(same)})
    rank = F.row_number().over(same.orderBy(F.desc("edge"), F.desc("score"), "idx"))
    fresh = (F.col("level") == "WARN") & (F.row_number().over(Window.partitionBy("doc", "level", "normal").orderBy("idx")) == 1)
    rows = rows.withColumns({"rank": rank, "fresh": fresh, "opens": F.col("stack") & ~F.coalesce(F.lag("stack").over(_in_order()), F.lit(False))})
    rows = rows.withColumns({"warning": F.row_number().over(Window.partitionBy("doc", "fresh").orderBy("idx")), "trace": F.count_if("opens").over(_upto())})
    rows = rows.withColumn("depth", F.row_number().over(Window.partitionBy("doc", "stack", "trace").orderBy("idx")))
    chosen = (
        (F.col("level").isin("ERROR", "FAIL") & (F.col("rank") <= max_errors)) | (F.col("fresh") & (F.col("warning") <= max_warnings))
        | (F.col("stack") & (F.col("trace") <= max_stacks) & (F.col("depth") <= stack_lines)) | F.col("summary")
    )
    rows = rows.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    near = F.max("chosen").over(_in_order().rowsBetween(-context, context))
    kept = rows.withColumn("near", near).where("near")
    best = F.row_number().over(_by().orderBy(F.desc("score"), "idx"))
    return kept.withColumn("best", best).where(F.col("best") <= limit).select("doc", "idx", "line", "score")


def select_search(matches: DataFrame, words: list[str], limit: int, per_file: int = 5, max_files: int = 10) -> DataFrame:
    """(doc, file, line_no, idx, line) matches that stay: the files of most score; of each the first, the last and the best."""
    low = F.lower("line")
    score = sum((F.when(low.contains(w), 0.3).otherwise(0.0) for w in words), F.lit(0.0))
    boost = F.lit(0.0)
    for i, name in reversed(list(enumerate(("error", "warning", "importance")))):
        terms = SIGNAL_WORDS[name] if name != "importance" else [w for n in ("error", "importance", "warning") for w in SIGNAL_WORDS[n]]
        boost = F.when(low.rlike(f"(^|[^a-z0-9_])({'|'.join(terms)})([^a-z0-9_]|$)"), 0.5 - 0.1 * i).otherwise(boost)
    rows = matches.withColumn("score", F.round(F.least(F.lit(1.0), score + boost), 4))
    file = Window.partitionBy("doc", "file")
    rows = rows.withColumns({"total": F.round(F.sum("score").over(file), 4), "began": F.min("idx").over(file)})
    rows = rows.withColumn("place", F.dense_rank().over(_by().orderBy(F.desc("total"), "began"))).where(F.col("place") <= max_files)
    first, last = F.row_number().over(file.orderBy("idx")), F.row_number().over(file.orderBy(F.desc("idx")))
    rows = rows.withColumn("edge", F.when(first == 1, 0).when(last == 1, 1).otherwise(2))
    rows = rows.withColumn("r", F.row_number().over(file.orderBy("edge", F.desc("score"), "idx"))).where(F.col("r") <= per_file)
    # File by file until the limit; inside a file in the order of choice.
    turn = F.row_number().over(_by().orderBy("place", "r"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).select("doc", "file", "line_no", "idx", "line", "score")


def build_groups(lines: DataFrame, shown: int = 5) -> DataFrame:
    """(doc, text) of errors that two files or more share: the message, their number, and the first of them."""
    rows = lines.select("doc", "idx", F.regexp_extract("line", r"^(.+?):\s*(error TS[0-9]+:\s*.+)$", 1).alias("file"), F.trim(F.regexp_extract("line", r"^(.+?):\s*(error TS[0-9]+:\s*.+)$", 2)).alias("message"))
    grouped = rows.where("message <> ''").groupBy("doc", "message").agg(F.array_sort(F.collect_list(F.struct("idx", "file"))).alias("f"))
    names = F.transform("f", lambda s: s["file"])
    more = F.when(F.size("f") > shown, F.format_string(", ... +%d more", F.size("f") - shown)).otherwise("")
    return grouped.where(F.size("f") >= 2).select("doc", F.concat("message", F.format_string(" (%d files: ", F.size("f")), F.array_join(F.slice(names, 1, shown), ", "), more, F.lit(")")).alias("text"))


def docker_lines(lines: DataFrame) -> DataFrame:
    """Adds `kept`: not a download or progress line, nor a layer that came before."""
    fetch = F.col("line").rlike("^(?:Downloading|Extracting|Pulling fs layer|Waiting|Download complete|Pull complete|Verifying Checksum|Already exists)")
    progress = F.col("line").rlike("[0-9]+\\.[0-9]+\\s*[kMG]B/[0-9]+\\.[0-9]+\\s*[kMG]B|[0-9.]+%")
    layer = F.trim(F.regexp_extract("line", "^#[0-9]+\\s+\\[[A-Za-z0-9_]+\\s+[0-9]+/[0-9]+\\]\\s+(.+)$", 1))
    rows = lines.withColumns({"noise": fetch | progress, "layer": layer})
    again = (F.col("layer") != "") & (F.row_number().over(Window.partitionBy("doc", "layer", "noise").orderBy("idx")) > 1)
    return rows.withColumn("kept", ~F.col("noise") & ~again).drop("layer")


def compiler_lines(lines: DataFrame) -> DataFrame:
    """Lines without home paths and times; a warning stands twice, then once as a marker, then no more."""
    plain = F.regexp_replace("line", "(?:/home/[A-Za-z0-9_]+/[A-Za-z0-9_.-]+/|/Users/[A-Za-z0-9_]+/[A-Za-z0-9_.-]+/|/workspace/[A-Za-z0-9_.-]+/)", "")
    plain = F.regexp_replace(plain, "\\[[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?\\]\\s*|\\[[0-9]{2}:[0-9]{2}:[0-9]{2}\\]\\s*", "")
    rows = lines.withColumn("line", plain)
    rows = rows.withColumn("warning", F.trim(F.regexp_extract("line", "^.+?:[0-9]+:[0-9]+:\\s*(warning:\\s*.+)$", 1)))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc", "warning").orderBy("idx")))
    text = F.when((F.col("warning") != "") & (F.col("r") == 3), F.concat(F.lit("  ... (repeated warning: "), "warning", F.lit(")"))).otherwise(F.col("line"))
    return rows.where("warning = '' or r <= 3").select("doc", "idx", text.alias("line"))


# --- line tables made of the test tables -----------------------------------------------------------------------------


def _k():
    return F.get_json_object("props", "$.k").try_cast("long")


def log_lines(spark, sf_dir) -> DataFrame:
    """A log of each user: every event as a line of some kind."""
    k = F.col("k").cast("string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("k", _k())
    digit = F.col("k") % 10
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR worker "), F.col("user_id").cast("string"), F.lit(": timeout after "), k, F.lit(" ms at /srv/app/"), k, F.lit("/run")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("WARNING cache "), (F.col("k") % 4).cast("string"), F.lit(": entry "), k, F.lit(" is stale in /var/tmp/x/")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("INFO order "), F.col("event_id").cast("string"), F.lit(" done")))
        .when((F.col("event_type") == "click") & (digit == 0), F.lit("Traceback (most recent call last)"))
        .when((F.col("event_type") == "click") & (digit == 1), F.concat(F.lit('  File "/app/main.py", line '), k))
        .when((F.col("event_type") == "click") & (digit == 2), F.lit("===== summary ====="))
        .when((F.col("event_type") == "click") & (digit == 3), F.concat(F.lit("FAILED test_"), k))
        .when(F.col("event_type") == "click", F.concat(F.lit("DEBUG tick "), k)).when(digit == 0, F.lit("")).otherwise(F.concat(F.lit("note "), k))
    )
    return rows.select(F.col("user_id").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("idx"), line.alias("line"))


_KSQL = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"
_G = f"""g AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_type = 'error' THEN 'ERROR worker ' || user_id || ': timeout after ' || k || ' ms at /srv/app/' || k || '/run' WHEN event_type = 'signup' THEN 'WARNING cache ' || k % 4 || ': entry ' || k || ' is stale in /var/tmp/x/' WHEN event_type = 'purchase' THEN 'INFO order ' || event_id || ' done' WHEN event_type = 'click' AND k % 10 = 0 THEN 'Traceback (most recent call last)' WHEN event_type = 'click' AND k % 10 = 1 THEN '  File "/app/main.py", line ' || k WHEN event_type = 'click' AND k % 10 = 2 THEN '===== summary =====' WHEN event_type = 'click' AND k % 10 = 3 THEN 'FAILED test_' || k WHEN event_type = 'click' THEN 'DEBUG tick ' || k WHEN k % 10 = 0 THEN '' ELSE 'note ' || k END AS line FROM (SELECT *, {_KSQL} AS k FROM events))"""


def _sql_any(patterns, text="line"):
    return f"regexp_matches({text}, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(line, '(^|[^A-Za-z0-9_])({w})([^A-Za-z0-9_]|$)') THEN '{n}'" for n, w in LEVELS) + " END"
_SCORE = "CASE level " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in SCORES.items()) + " ELSE 0.1 END"
_NORMAL = "(regexp_extract(line, '^[^:=]*') || regexp_replace(regexp_replace(regexp_replace(substr(line, length(regexp_extract(line, '^[^:=]*')) + 1), '[0-9]+', 'N', 'g'), '0x[0-9a-fA-F]+', 'ADDR', 'g'), '/[A-Za-z0-9_/]+/', '/PATH/', 'g'))"
_PARSED = f"""{_G}, o AS (SELECT *, {_LEVEL} AS level, {_sql_any(SUMMARIES)} AS summary, max(CASE WHEN {_sql_any(STACK_STARTS)} THEN idx END) OVER w AS s, max(CASE WHEN trim(line) = '' THEN idx END) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g WINDOW w AS (PARTITION BY doc ORDER BY idx)),
p AS (SELECT *, coalesce(s IS NOT NULL AND idx - s <= 20 AND (b IS NULL OR b < s), false) AS stack FROM o), q AS (SELECT *, round(least(1.0::DOUBLE, {_SCORE} + CASE WHEN stack THEN 0.3 ELSE 0 END + CASE WHEN summary THEN 0.4 ELSE 0 END), 4) AS score FROM p)"""


@query(f"WITH {_PARSED} SELECT coalesce(level, 'OTHER') AS level, count(*) AS n FROM q GROUP BY 1")
def f9_line_levels(spark, sf_dir):
    """Lines by level, six of them and others."""
    return log_lines(spark, sf_dir).groupBy(F.coalesce(level(F.col("line")), F.lit("OTHER")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PARSED} SELECT doc AS user_id, idx FROM q WHERE stack")
def f10_stack_lines(spark, sf_dir):
    """Lines inside a stack trace."""
    return parse(log_lines(spark, sf_dir)).where("stack").select(F.col("doc").alias("user_id"), "idx")


@query(f"WITH {_PARSED} SELECT doc AS user_id, idx, score FROM q WHERE summary")
def f11_summary_lines(spark, sf_dir):
    """Summary lines with their scores."""
    return parse(log_lines(spark, sf_dir)).where("summary").select(F.col("doc").alias("user_id"), "idx", "score")


@query(f"WITH {_G} SELECT doc AS user_id, idx FROM g WHERE regexp_matches(lower(line), '{'|'.join(ERROR_KEYWORDS)}')")
def f12_error_lines(spark, sf_dir):
    """Lines that hold an error keyword anywhere."""
    return log_lines(spark, sf_dir).where(F.lower("line").rlike("|".join(ERROR_KEYWORDS))).select(F.col("doc").alias("user_id"), "idx")


def _sql_first(*names):
    words = sorted((w for n in names for w in SIGNAL_WORDS[n]), key=len, reverse=True)
    return f"regexp_extract(lower(line), '(?:^|[^a-z0-9_])({'|'.join(words)})(?:[^a-z0-9_]|$)', 1)"


def _sql_signal(context):
    second = "security" if context == "diff" else "warning"
    errors = ", ".join(f"'{w}'" for w in SIGNAL_WORDS["error"])
    marks = " OR ".join(f"starts_with(line, '{m}')" for m in MARKDOWN)
    return f"CASE WHEN {_sql_first('error', 'importance')} IN ({errors}) THEN 'error' WHEN {_sql_first('error', 'importance')} <> '' THEN 'importance' WHEN {_sql_first(second)} <> '' THEN '{second}'" + (f" WHEN {marks} THEN 'markdown'" if context == "text" else "") + " END"


_H = f"{_G}, h AS (SELECT doc, idx, line FROM g UNION ALL SELECT doc, idx + 1000, CASE idx % 5 WHEN 0 THEN '# head ' || idx WHEN 1 THEN 'the auth secret ' || idx WHEN 2 THEN 'a bug, then an error' WHEN 3 THEN 'prefixed error_code' ELSE '> quoted' END FROM g WHERE idx < 10)"


def _mixed_lines(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    n = F.col("idx")
    other = F.when(n % 5 == 0, F.concat(F.lit("# head "), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("the auth secret "), n.cast("string"))).when(n % 5 == 2, "a bug, then an error").when(n % 5 == 3, "prefixed error_code").otherwise("> quoted")
    return lines.unionByName(lines.where("idx < 10").select("doc", (n + 1000).alias("idx"), other.alias("line")))


@query(f"WITH {_H}, s AS (SELECT {_sql_signal('text')} AS text, {_sql_signal('log')} AS log, {_sql_signal('diff')} AS diff FROM h) SELECT text, log, diff, CASE text WHEN 'markdown' THEN 0.45 WHEN 'error' THEN 0.95 WHEN 'warning' THEN 0.75 WHEN 'importance' THEN 0.6 ELSE 0 END::DOUBLE AS priority, count(*) AS n FROM s GROUP BY ALL")
def f13_line_signals(spark, sf_dir):
    """Lines by their signal in prose, logs and diffs."""
    s = _mixed_lines(spark, sf_dir).select(*[signal(F.col("line"), c).alias(c) for c in ("text", "log", "diff")])
    return s.groupBy("text", "log", "diff", priority(F.col("text")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_H}, s AS (SELECT {_sql_signal('log')} AS first, CASE WHEN regexp_matches(lower(line), '{'|'.join(INDICATORS)}') THEN 'error' END AS second FROM h) SELECT coalesce(first, second, 'none') AS category, CASE WHEN first IS NOT NULL THEN 1 WHEN second IS NOT NULL THEN 2 ELSE 0 END AS tier, count(*) AS n FROM s GROUP BY ALL")
def f14_tiered_signals(spark, sf_dir):
    """The answer of the first tier that has one: words, then substrings."""
    low, first = F.lower("line"), signal(F.col("line"), "log")
    second = F.when(low.rlike("|".join(INDICATORS)), "error")
    s = _mixed_lines(spark, sf_dir).select(first.alias("first"), second.alias("second"))
    tier = F.when(F.col("first").isNotNull(), 1).when(F.col("second").isNotNull(), 2).otherwise(0)
    return s.groupBy(F.coalesce("first", "second", F.lit("none")).alias("category"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def indicators(text: Column) -> Column:
    """How many of the error indicators a text holds: 1 is a weak sign, 2 a strong one."""
    return sum((F.lower(text).contains(w).cast("int") for w in INDICATORS), F.lit(0))


@query(f"WITH {_G}, t AS (SELECT doc, idx // 8 AS part, string_agg(line, chr(10) ORDER BY idx) AS text FROM g GROUP BY ALL), c AS (SELECT {' + '.join(f'CAST(contains(lower(text), {w!r}) AS INT)' for w in INDICATORS)} AS k FROM t) SELECT k >= 1 AS weak, k >= 2 AS strong, count(*) AS n FROM c GROUP BY ALL")
def f15_error_triage(spark, sf_dir):
    """Parts of eight lines with a weak and with a strong sign of errors."""
    parts = log_lines(spark, sf_dir).groupBy("doc", F.floor(F.col("idx") / 8).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda s: s["line"]), "\n").alias("text"))
    k = indicators(F.col("text"))
    return parts.groupBy((k >= 1).alias("weak"), (k >= 2).alias("strong")).agg(F.count(F.lit(1)).alias("n"))


_LIMIT = 30


@query(f"""WITH {_PARSED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, level ORDER BY idx) = 1 OR row_number() OVER (PARTITION BY doc, level ORDER BY idx DESC) = 1 AS edge, CASE WHEN level = 'WARN' THEN {_NORMAL} END AS normal, stack AND NOT coalesce(lag(stack) OVER (PARTITION BY doc ORDER BY idx), false) AS opens FROM q),
s AS (SELECT *, row_number() OVER (PARTITION BY doc, level ORDER BY edge DESC, score DESC, idx) AS rank, coalesce(level = 'WARN', false) AND row_number() OVER (PARTITION BY doc, level, normal ORDER BY idx) = 1 AS fresh, sum(CAST(opens AS INT)) OVER (PARTITION BY doc ORDER BY idx) AS trace FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY doc, fresh ORDER BY idx) AS warning, row_number() OVER (PARTITION BY doc, stack, trace ORDER BY idx) AS depth FROM s),
u AS (SELECT *, coalesce(level IN ('ERROR', 'FAIL') AND rank <= 10, false) OR (fresh AND warning <= 5) OR (stack AND trace <= 3 AND depth <= 20) OR summary AS chosen FROM t),
v AS (SELECT *, bool_or(chosen) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM u), w AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, idx) AS best FROM v WHERE near) SELECT doc AS user_id, idx, line FROM w WHERE best <= {_LIMIT}""")
def t5_log_selection(spark, sf_dir):
    """The lines of each log that stay, 30 at most."""
    return select_log(log_lines(spark, sf_dir), _LIMIT).select(F.col("doc").alias("user_id"), "idx", "line")


@query(f"WITH {_PARSED} SELECT {_NORMAL} AS warning, count(*) AS n, min(line) AS example FROM q WHERE level = 'WARN' GROUP BY 1")
def t6_normalized_warnings(spark, sf_dir):
    """Warnings by their normal form."""
    warnings = log_lines(spark, sf_dir).where(level(F.col("line")) == "WARN")
    return warnings.groupBy(normalized_warning(F.col("line")).alias("warning")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("example"))


def log_format(lines: DataFrame) -> DataFrame:
    """(doc, format): the one that most of the first 100 lines show, the first of equal ones; generic if none."""
    hits = lines.where("idx < 100").groupBy("doc").agg(*[F.count_if(F.greatest(*[F.col("line").contains(m) for m in marks])).alias(name) for name, marks in FORMATS.items()])
    best, score = F.lit("generic"), F.lit(0)
    for name in FORMATS:
        best, score = F.when(F.col(name) > score, name).otherwise(best), F.greatest(F.col(name), score)
    return hits.select("doc", best.alias("format"))


_B = "b AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CASE (o_orderkey + o_custkey // 7) % 9 WHEN 0 THEN 'npm WARN ' || o_orderkey WHEN 1 THEN '   Compiling app ' || o_orderkey WHEN 2 THEN 'PASS src/' || o_orderkey WHEN 3 THEN 'gcc -c ' || o_orderkey WHEN 4 THEN '=== test session' WHEN 5 THEN 'warning: unused' ELSE 'plain ' || o_orderkey END AS line FROM orders)"


def _build_lines(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    key, kind = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + F.floor(F.col("o_custkey") / 7)) % 9
    text = F.when(kind == 0, F.concat(F.lit("npm WARN "), key)).when(kind == 1, F.concat(F.lit("   Compiling app "), key)).when(kind == 2, F.concat(F.lit("PASS src/"), key)).when(kind == 3, F.concat(F.lit("gcc -c "), key)).when(kind == 4, "=== test session").when(kind == 5, "warning: unused").otherwise(F.concat(F.lit("plain "), key))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.row_number().over(w) - 1).alias("idx"), text.alias("line"))


_HITS = ", ".join("count(*) FILTER (" + " OR ".join(f"contains(line, '{m}')" for m in marks) + f") AS {name}" for name, marks in FORMATS.items())


@query(f"WITH {_B}, c AS (SELECT doc, {_HITS} FROM b WHERE idx < 100 GROUP BY 1), m AS (SELECT *, greatest(pytest, npm, cargo, jest, make) AS top FROM c) SELECT doc AS o_custkey, CASE WHEN top = 0 THEN 'generic' WHEN pytest = top THEN 'pytest' WHEN npm = top THEN 'npm' WHEN cargo = top THEN 'cargo' WHEN jest = top THEN 'jest' ELSE 'make' END AS format FROM m")
def t7_log_formats(spark, sf_dir):
    """The format of each customer's build log."""
    return log_format(_build_lines(spark, sf_dir)).select(F.col("doc").alias("o_custkey"), "format")


_S = "s AS (SELECT user_id AS doc, 'src/mod' || k % 14 || '.py' AS file, k * 3 + 1 AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type || CASE WHEN k % 6 = 0 THEN ' todo fix' WHEN k % 6 = 1 THEN ' warning here' ELSE '' END || ' cart ' || k AS line FROM (SELECT *, " + _KSQL + " AS k FROM events))"


def _matches(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("k", _k())
    more = F.when(F.col("k") % 6 == 0, " todo fix").when(F.col("k") % 6 == 1, " warning here").otherwise("")
    return rows.select(F.col("user_id").alias("doc"), F.format_string("src/mod%d.py", F.col("k") % 14).alias("file"), (F.col("k") * 3 + 1).alias("line_no"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.concat("event_type", more, F.lit(" cart "), F.col("k").cast("string")).alias("line"))


_IMPORTANT = "|".join(w for n in ("error", "importance", "warning") for w in SIGNAL_WORDS[n])


@query(f"""WITH {_S}, c AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN contains(line, 'purchase') THEN 0.3 ELSE 0 END + CASE WHEN contains(line, 'cart 9') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(line, '(^|[^a-z0-9_])({'|'.join(SIGNAL_WORDS['error'])})([^a-z0-9_]|$)') THEN 0.5 WHEN regexp_matches(line, '(^|[^a-z0-9_])(warn|warning)([^a-z0-9_]|$)') THEN 0.4 WHEN regexp_matches(line, '(^|[^a-z0-9_])({_IMPORTANT})([^a-z0-9_]|$)') THEN 0.3 ELSE 0 END), 4) AS score FROM s),
d AS (SELECT *, round(sum(score) OVER (PARTITION BY doc, file), 4) AS total, min(idx) OVER (PARTITION BY doc, file) AS began FROM c), e AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY total DESC, began) AS place FROM d) WHERE place <= 10),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc, file ORDER BY idx) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY doc, file ORDER BY idx DESC) = 1 THEN 1 ELSE 2 END AS edge FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY doc, file ORDER BY edge, score DESC, idx) AS r FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place, r) AS turn FROM g WHERE r <= 5) SELECT doc AS user_id, file, line_no, idx, score FROM h WHERE turn <= 20""")
def t9_search_selection(spark, sf_dir):
    """The search results of each user that stay, 20 at most, for the words purchase and "cart 9"."""
    return select_search(_matches(spark, sf_dir), ["purchase", "cart 9"], 20).select(F.col("doc").alias("user_id"), "file", "line_no", "idx", "score")


_D = "d AS (SELECT l_orderkey AS doc, l_linenumber AS part, CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'diff --git a/package-lock.json b/package-lock.json' WHEN 1 THEN 'diff --git a/src/f' || l_suppkey || '.py b/src/f' || l_suppkey || '.py' ELSE 'diff --git a/lib/g' || l_suppkey || '.c b/lib/g' || l_suppkey || '.c' END AS file, '-' || l_returnflag || '  ' || l_linestatus AS old, '+' || CASE WHEN l_partkey % 3 = 0 THEN l_returnflag || ' ' || l_linestatus ELSE l_linestatus || ' ' || l_returnflag END AS new FROM lineitem)"


def diff_noise(hunks: DataFrame) -> DataFrame:
    """Adds `noise`: the file is a lock file, or the old and the new line differ in white space alone."""
    lock = F.greatest(*[F.col("file").contains(f"/{name} ") | F.col("file").endswith(name) for name in LOCKFILES])
    bare = lambda c: F.regexp_replace(F.substring(c, 2, 1_000_000), r"\s+", "")
    return hunks.withColumn("noise", lock | (bare("old") == bare("new")))


@query(f"WITH {_D} SELECT doc AS l_orderkey, part, contains(file, '/package-lock.json ') OR ends_with(file, 'package-lock.json') OR regexp_replace(substr(old, 2), '\\s+', '', 'g') = regexp_replace(substr(new, 2), '\\s+', '', 'g') AS noise FROM d")
def t11_diff_noise(spark, sf_dir):
    """Hunks of lock files, and those that change white space alone."""
    kind, key = (F.col("l_partkey") + F.col("l_linenumber")) % 6, F.col("l_suppkey")
    path = lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f)
    file = F.when(kind == 0, path(F.lit("package-lock.json"))).when(kind == 1, path(F.format_string("src/f%d.py", key))).otherwise(path(F.format_string("lib/g%d.c", key)))
    new = F.when(F.col("l_partkey") % 3 == 0, F.concat_ws(" ", "l_returnflag", "l_linestatus")).otherwise(F.concat_ws(" ", "l_linestatus", "l_returnflag"))
    hunks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").alias("part"), file.alias("file"), F.concat(F.lit("-"), "l_returnflag", F.lit("  "), "l_linestatus").alias("old"), F.concat(F.lit("+"), new).alias("new"))
    return diff_noise(hunks).select("l_orderkey", "part", "noise")


_ESC = "chr(27) || '[3' || (doc_id % 8) || 'm'"


@query(f"""WITH t AS (SELECT doc_id, {_ESC} || left(coalesce(text, ''), 200) || chr(27) || '[0m' || chr(10) || 'load 10%' || chr(13) || 'load done' || chr(10) || '███ 40%' || chr(10) || '⠋⠙' || chr(10) || chr(10) || chr(10) || chr(10) || chr(27) || '[2Kend' AS text FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g'), '\\x1b\\[[0-9;]*[A-HJKSTfh-l]', '', 'g'), '\\x1b\\].*?(?:\\x07|\\x1b\\\\)', '', 'g'), '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g') AS text FROM t),
v AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: string_split(x, chr(13))[-1]), lambda x: NOT regexp_matches(x, '[▓▒░█▌▍▎▏■□●○◐◑◒◓⣾⣽⣻⢿⡿⣟⣯⣷⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\\\-]+\\s*[0-9]+%') AND NOT regexp_matches(trim(x), '{SPINNER}')) AS l FROM u) SELECT doc_id, regexp_replace(array_to_string(l, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM v""")
def t12_clean_terminal(spark, sf_dir):
    """Terminal output around each text without escapes, overwritten parts and progress."""
    esc = F.lit("\x1b")
    raw = F.concat(esc, F.lit("[3"), (F.col("doc_id") % 8).cast("string"), F.lit("m"), F.substring(F.coalesce("text", F.lit("")), 1, 200), esc, F.lit("[0m\nload 10%\rload done\n███ 40%\n⠋⠙\n\n\n\n\x1b[2Kend"))
    return read(spark, sf_dir, "documents").select("doc_id", clean_terminal(raw).alias("text"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
m AS (SELECT *, trim(raw, ' ') AS t, lag(trim(raw, ' ')) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l), g AS (SELECT *, sum(CASE WHEN t <> '' AND t = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
r AS (SELECT doc_id, run, count(*) AS n, min(t) AS t, first(raw ORDER BY i) AS raw FROM g GROUP BY ALL) SELECT d.doc_id, coalesce(md5(x.text), md5('')) AS text_md5 FROM documents d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN n > 1 THEN t || ' (x' || n || ')' ELSE raw END, chr(10) ORDER BY run) AS text FROM r WHERE n > 1 OR raw <> '' GROUP BY 1) x USING (doc_id)""")
def t15_collapsed_texts(spark, sf_dir):
    """Each text with runs of equal lines as one line and its count, as a digest."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(collapse_identical(F.coalesce("text", F.lit("")))).alias("text_md5"))


_TS = "t AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS idx, 'src/p' || l_partkey || '.ts: error TS' || (2300 + CAST(l_quantity AS INT)) || ': bad ' || l_returnflag AS line FROM lineitem)"


def _typed_lines(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    line = F.format_string("src/p%d.ts: error TS%d: bad %s", "l_partkey", F.lit(2300) + F.col("l_quantity").cast("int"), "l_returnflag")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.row_number().over(w).alias("idx"), line.alias("line"))


@query(f"WITH {_TS}, p AS (SELECT doc, idx, regexp_extract(line, '^(.+?):\\s*(error TS[0-9]+:\\s*.+)$', 1) AS file, trim(regexp_extract(line, '^(.+?):\\s*(error TS[0-9]+:\\s*.+)$', 2)) AS message FROM t), g AS (SELECT doc, message, count(*) AS n, list(file ORDER BY idx) AS f FROM p GROUP BY ALL) SELECT doc AS l_suppkey, message || ' (' || n || ' files: ' || array_to_string(f[1:5], ', ') || CASE WHEN n > 5 THEN ', ... +' || (n - 5) || ' more' ELSE '' END || ')' AS text FROM g WHERE n >= 2")
def t16_build_groups(spark, sf_dir):
    """Build errors that several files share, each as one line."""
    return build_groups(_typed_lines(spark, sf_dir)).select(F.col("doc").alias("l_suppkey"), "text")


_DK = "k AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'Downloading layer ' || o_orderkey WHEN 1 THEN '#' || o_orderkey || ' [build 1/4] RUN step ' || o_orderkey % 3 WHEN 2 THEN 'push 1.5MB/3.25MB' WHEN 3 THEN 'copied ' || o_orderkey % 100 || '%' ELSE 'done ' || o_orderkey END AS line FROM orders)"


@query(f"WITH {_DK}, n AS (SELECT *, regexp_matches(line, '^(?:Downloading|Extracting|Pulling fs layer|Waiting|Download complete|Pull complete|Verifying Checksum|Already exists)') OR regexp_matches(line, '[0-9]+\\.[0-9]+\\s*[kMG]B/[0-9]+\\.[0-9]+\\s*[kMG]B|[0-9.]+%') AS noise, trim(regexp_extract(line, '^#[0-9]+\\s+\\[[A-Za-z0-9_]+\\s+[0-9]+/[0-9]+\\]\\s+(.+)$', 1)) AS layer FROM k), m AS (SELECT *, NOT noise AND NOT (layer <> '' AND row_number() OVER (PARTITION BY doc, layer, noise ORDER BY idx) > 1) AS kept FROM n) SELECT doc AS o_custkey, count(*) FILTER (noise) AS removed, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (kept), '') AS text FROM m GROUP BY 1")
def t17_docker_output(spark, sf_dir):
    """Build output of images without downloads, progress and repeated layers, and how many such lines went."""
    w, key, kind = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey"), F.col("o_orderkey") % 5
    line = F.when(kind == 0, F.format_string("Downloading layer %d", key)).when(kind == 1, F.format_string("#%d [build 1/4] RUN step %d", key, key % 3)).when(kind == 2, "push 1.5MB/3.25MB").when(kind == 3, F.concat(F.lit("copied "), (key % 100).cast("string"), F.lit("%"))).otherwise(F.format_string("done %d", key))
    lines = docker_lines(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("idx"), line.alias("line")))
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("idx", "line"))))
    return lines.groupBy(F.col("doc").alias("o_custkey")).agg(F.count_if("noise").alias("removed"), F.array_join(F.transform(kept, lambda s: s["line"]), "\n").alias("text"))


_CC = "c AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS idx, '/home/dev/my-app/src/f' || l_partkey || '.c:' || l_linenumber || ':1: ' || CASE WHEN l_quantity < 25 THEN 'warning: unused ' || l_returnflag ELSE 'note [2024-01-0' || l_linenumber || 'T10:00:00Z] ' || l_linestatus END AS line FROM lineitem)"


@query(f"WITH {_CC}, d AS (SELECT doc, idx, regexp_replace(regexp_replace(line, '(?:/home/[A-Za-z0-9_]+/[A-Za-z0-9_.-]+/|/Users/[A-Za-z0-9_]+/[A-Za-z0-9_.-]+/|/workspace/[A-Za-z0-9_.-]+/)', '', 'g'), '\\[[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+Z?\\]\\s*|\\[[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\]\\s*', '', 'g') AS line FROM c), e AS (SELECT *, trim(regexp_extract(line, '^.+?:[0-9]+:[0-9]+:\\s*(warning:\\s*.+)$', 1)) AS w FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY doc, w ORDER BY idx) AS r FROM e) SELECT doc AS l_suppkey, idx, CASE WHEN w <> '' AND r = 3 THEN '  ... (repeated warning: ' || w || ')' ELSE line END AS line FROM f WHERE w = '' OR r <= 3")
def t18_compiler_lines(spark, sf_dir):
    """Compiler output without home paths and times, repeated warnings cut short."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    text = F.when(F.col("l_quantity") < 25, F.concat(F.lit("warning: unused "), "l_returnflag")).otherwise(F.concat(F.lit("note [2024-01-0"), F.col("l_linenumber").cast("string"), F.lit("T10:00:00Z] "), "l_linestatus"))
    line = F.concat(F.format_string("/home/dev/my-app/src/f%d.c:%d:1: ", "l_partkey", "l_linenumber"), text)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.row_number().over(w).cast("long").alias("idx"), line.alias("line"))
    return compiler_lines(lines).withColumnRenamed("doc", "l_suppkey")


def prefilter(lines: DataFrame, strategy: str, limit: int, head: int, tail: int, important: str = "error|Error|ERROR|failed|FAILED") -> DataFrame:
    """Lines that a tool profile keeps: `search` and `log` prefer important lines, `code` strides, `list` takes distinct ones."""
    n = F.count(F.lit(1)).over(_by())
    rows = lines.withColumn("n", n)
    if strategy == "list":
        fresh = (F.trim("line") != "") & (F.row_number().over(Window.partitionBy("doc", F.trim("line")).orderBy("idx")) == 1)
        rows = rows.withColumn("fresh", fresh).where("fresh")
        return rows.withColumn("r", F.row_number().over(_in_order())).where(F.col("r") <= limit).select("doc", "idx", "line")
    edge = (F.col("idx") < head) | (F.col("idx") >= F.col("n") - tail)
    if strategy == "code":
        step = F.greatest(F.lit(1), F.floor((F.col("n") - head - tail) / F.greatest(F.lit(1), F.lit(limit - head - tail))))
        keep = (F.col("n") <= limit) | edge | ((F.col("idx") - head) % step == 0)
        return rows.where(keep).select("doc", "idx", "line")
    order = F.when(edge, 0).when(F.col("line").rlike(important), 1).otherwise(2)
    rows = rows.withColumn("order", order).withColumn("r", F.row_number().over(_by().orderBy("order", "idx")))
    return rows.where((F.col("n") <= limit) | (F.col("r") <= limit)).select("doc", "idx", "line")


@query(f"""WITH {_G}, a AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN idx < 5 OR idx >= n - 3 THEN 0 WHEN regexp_matches(line, 'error|Error|ERROR|failed|FAILED') THEN 1 ELSE 2 END, idx) AS r FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY doc, trim(line) ORDER BY idx) = 1 AND trim(line) <> '' AS fresh FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS r FROM c WHERE fresh)
SELECT 'search' AS profile, doc AS user_id, idx FROM b WHERE n <= 20 OR r <= 20 UNION ALL SELECT 'code', doc, idx FROM a WHERE n <= 30 OR idx < 8 OR idx >= n - 4 OR (idx - 8) % greatest(1, (n - 12) // 18) = 0 UNION ALL SELECT 'list', doc, idx FROM d WHERE r <= 25""")
def t19_prefiltered_lines(spark, sf_dir):
    """The lines of each log under three tool profiles."""
    lines = log_lines(spark, sf_dir)
    parts = [prefilter(lines, "search", 20, 5, 3), prefilter(lines, "code", 30, 8, 4), prefilter(lines, "list", 25, 0, 0)]
    out = [p.select(F.lit(name).alias("profile"), F.col("doc").alias("user_id"), "idx") for p, name in zip(parts, ("search", "code", "list"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_FR = "f AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '  at Module._compile (node:1)' WHEN 1 THEN '  File \"/usr/lib/python3/x.py\", line 3' WHEN 2 THEN '  at run (/home/me/node_modules/a.js:1:2)' WHEN 3 THEN '  std::panic at lib.rs' WHEN 4 THEN '  at main (/app/src/core::x.rs)' WHEN 5 THEN '  File \"/app/a.py\", line 9' ELSE '  site-packages/flask/app.py' END AS line FROM events)"


@query(f"WITH {_FR} SELECT event_id, NOT (regexp_matches(line, '/home/|/workspace/|/project/') OR (contains(line, '/src/') AND NOT contains(line, 'node_modules/'))) AND {_sql_any(FRAMES)} AS framework FROM f")
def f24_framework_frames(spark, sf_dir):
    """Which stack frames belong to a framework."""
    kind = F.col("event_id") % 7
    texts = ["  at Module._compile (node:1)", '  File "/usr/lib/python3/x.py", line 3', "  at run (/home/me/node_modules/a.js:1:2)", "  std::panic at lib.rs", "  at main (/app/src/core::x.rs)", '  File "/app/a.py", line 9', "  site-packages/flask/app.py"]
    line = F.element_at(F.array(*map(F.lit, texts)), (kind + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", framework_frame(line).alias("framework"))


@query(f"WITH {_FR}, n AS (SELECT event_id, event_id // 10 AS trace, line, NOT (regexp_matches(line, '/home/|/workspace/|/project/') OR (contains(line, '/src/') AND NOT contains(line, 'node_modules/'))) AND {_sql_any(FRAMES)} AS framework FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY event_id) AS r FROM n WHERE NOT framework) SELECT trace, string_agg(trim(line), ' < ' ORDER BY r) AS frames FROM r WHERE r <= 3 GROUP BY 1")
def t14_stack_traces(spark, sf_dir):
    """Stack traces of ten frames: framework frames go, the first three of the user's stay."""
    kind = F.col("event_id") % 7
    texts = ["  at Module._compile (node:1)", '  File "/usr/lib/python3/x.py", line 3', "  at run (/home/me/node_modules/a.js:1:2)", "  std::panic at lib.rs", "  at main (/app/src/core::x.rs)", '  File "/app/a.py", line 9', "  site-packages/flask/app.py"]
    rows = read(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("trace"), F.element_at(F.array(*map(F.lit, texts)), (kind + 1).cast("int")).alias("line")).where(~framework_frame(F.col("line")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("trace").orderBy("event_id"))).where("r <= 3")
    return rows.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.trim("line").alias("t")))), lambda s: s["t"]), " < ").alias("frames"))


def error_card(text: Column) -> Column:
    """[Error: type] message at file:line, from the first line of an error text."""
    first = F.substring(F.element_at(F.split(F.trim(text), "\n"), 1), 1, 100)
    named = F.regexp_extract(first, r"^([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*(?:Error|Exception|Warning))", 1)
    code = F.regexp_extract(F.lower(first), r"exit(?:ed)?\s+(?:with\s+)?(?:code\s+)?([0-9]+)", 1)
    kind = (
        F.when(named != "", F.element_at(F.split(named, r"\."), -1)).when(first.contains("Error:"), "Error").when(code == "127", "CommandNotFound").when(code == "1", "GenericError")
        .when(code == "137", "OOMKilled").when(code == "139", "Segfault").when(code != "", F.concat(F.lit("ExitCode"), code)).otherwise("Error")
    )
    place = F.regexp_extract(text, r"([A-Za-z0-9_./\\-]+\.[A-Za-z0-9_]+):([0-9]+)", 0)
    return F.concat(F.lit("[Error: "), kind, F.lit("] "), F.substring(first, 1, 120), F.when(place != "", F.concat(F.lit("\n  at "), place)).otherwise(""))


_EC = "t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pkg.ValueError: bad ' || user_id || chr(10) || 'at src/a.py:' || user_id WHEN 1 THEN 'exited with code 137' WHEN 2 THEN 'Fatal Error: x in lib/b.c:12' WHEN 3 THEN 'exit code ' || user_id || chr(10) || 'more' WHEN 4 THEN 'Exit 127 sh' ELSE 'something odd' END AS text FROM events WHERE event_type = 'error')"


@query(f"""WITH {_EC}, f AS (SELECT event_id, text, left(string_split(trim(text), chr(10))[1], 100) AS first FROM t), c AS (SELECT *, regexp_extract(first, '^([A-Za-z0-9_]+(?:\\.[A-Za-z0-9_]+)*(?:Error|Exception|Warning))', 1) AS named, regexp_extract(lower(first), 'exit(?:ed)?\\s+(?:with\\s+)?(?:code\\s+)?([0-9]+)', 1) AS code, regexp_extract(text, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9_]+):([0-9]+)') AS place FROM f)
SELECT event_id, '[Error: ' || CASE WHEN named <> '' THEN string_split(named, '.')[-1] WHEN contains(first, 'Error:') THEN 'Error' WHEN code = '127' THEN 'CommandNotFound' WHEN code = '1' THEN 'GenericError' WHEN code = '137' THEN 'OOMKilled' WHEN code = '139' THEN 'Segfault' WHEN code <> '' THEN 'ExitCode' || code ELSE 'Error' END || '] ' || first || CASE WHEN place <> '' THEN chr(10) || '  at ' || place ELSE '' END AS card FROM c""")
def t13_error_cards(spark, sf_dir):
    """Error outputs as cards: type, message and place."""
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("pkg.ValueError: bad "), u, F.lit("\nat src/a.py:"), u)).when(kind == 1, "exited with code 137").when(kind == 2, "Fatal Error: x in lib/b.c:12")
        .when(kind == 3, F.concat(F.lit("exit code "), u, F.lit("\nmore"))).when(kind == 4, "Exit 127 sh").otherwise("something odd")
    )
    return read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", error_card(text).alias("card"))


QUERIES, ORACLES = query.queries, query.oracles
