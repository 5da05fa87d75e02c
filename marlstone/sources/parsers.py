"""Parsers of lines and texts into columns: key=value pairs, performance logs, delimited, Markdown and fixed-width tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()


def key_values(text: Column) -> Column:
    """A map of k=v pairs; `transforms=` comes last and takes the rest of the line, blanks and commas included."""
    rest = F.regexp_extract(text, r"(?:^|\s)transforms=(.*)$", 1)
    head = F.regexp_replace(text, r"(?:^|\s)transforms=.*$", "")
    pairs = F.regexp_extract_all(head, F.lit(r"([A-Za-z0-9_]+=[^\s]*)"), F.lit(1))
    known = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value"))))
    return F.when(rest != "", F.map_concat(known, F.create_map(F.lit("transforms"), rest))).otherwise(known)


def perf_records(lines: DataFrame, hours: int | None = None, now: Column | None = None) -> DataFrame:
    """(ts, request, kind, pairs) of log lines (value): lines of the last `hours`; those whose time cannot be read stay."""
    ts = F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)).cast("timestamp_ntz")
    rows = lines.select(ts.alias("ts"), F.regexp_extract("value", r"\[([A-Za-z0-9_-]+)\] (PERF|STAGE_TIMINGS|ROUTER)\b", 1).alias("request"), F.regexp_extract("value", r"\[[A-Za-z0-9_-]+\] (PERF|STAGE_TIMINGS|ROUTER)\b", 1).alias("kind"), key_values(F.regexp_extract("value", r"(?:PERF|STAGE_TIMINGS|ROUTER)\s+(.*)$", 1)).alias("pairs"))
    rows = rows.where("kind <> ''")
    if hours is not None:
        rows = rows.where(F.col("ts").isNull() | (F.col("ts") >= (now if now is not None else F.localtimestamp()) - F.make_dt_interval(hours=F.lit(hours))))
    return rows


def delimited(text: Column, delimiter: str = ",") -> Column:
    """The rows of a delimited text as arrays; quoted fields may hold the delimiter and doubled quotes."""
    d = {",": ",", "\t": "\t", ";": ";", "|": "\\|"}[delimiter]
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    field = f'(?:^|{d})("(?:[^"]|"")*"|[^{delimiter}]*)'

    def clean(x):
        inner = F.substr(x, F.lit(2), F.length(x) - 2)
        return F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(x)

    return F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(field), F.lit(1)), clean))


def markdown_table(text: Column) -> Column:
    """The rows of a Markdown table as arrays of trimmed cells, without the separator."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.contains("|") & ~x.rlike(r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def fixed_width(text: Column) -> Column:
    """The rows of a text whose columns are two blanks or more apart."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.split(F.trim(x), r"\s{2,}"))


def records(rows: Column) -> Column:
    """Maps of header and cell for all rows but the first; short rows are padded with null, long ones cut."""
    header = F.element_at(rows, 1)

    def record(row):
        n = F.size(header)
        padded = F.slice(F.concat(row, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)
        return F.map_from_arrays(header, padded)

    return F.when(F.size(rows) > 0, F.transform(F.slice(rows, F.lit(2), F.size(rows)), record)).otherwise(F.array().cast("array<map<string,string>>"))


_KV = "l AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'broken' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ',123 INFO [r' || event_id || '] PERF model=' || event_type || ' before=' || CAST(floor(value) AS INT) || ' after=7 transforms=a, b ' || user_id AS value FROM events)"


def _lines(spark, sf_dir):
    i = F.col("event_id").cast("string")
    head = F.when(F.col("event_id") % 9 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read(spark, sf_dir, "events").select(F.concat(head, F.lit(",123 INFO [r"), i, F.lit("] PERF model="), "event_type", F.lit(" before="), F.floor("value").cast("string"), F.lit(" after=7 transforms=a, b "), F.col("user_id").cast("string")).alias("value"))


@query(f"WITH {_KV} SELECT regexp_extract(value, '\\[(r[0-9]+)\\]', 1) AS request, try_cast(regexp_extract(value, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1) AS TIMESTAMP) AS ts, regexp_extract(value, 'model=([^ ]*)', 1) AS model, CAST(regexp_extract(value, 'before=([0-9]+)', 1) AS BIGINT) AS before, regexp_extract(value, 'transforms=(.*)$', 1) AS transforms FROM l WHERE NOT starts_with(value, '2') OR try_cast(regexp_extract(value, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1) AS TIMESTAMP) >= TIMESTAMP '2024-01-20'")
def s4_s5_perf_logs(spark, sf_dir):
    """Performance records of log lines of the last days; lines without a readable time stay."""
    rows = perf_records(_lines(spark, sf_dir), 240, F.lit("2024-01-30").cast("timestamp_ntz"))
    return rows.select("request", "ts", F.col("pairs")["model"].alias("model"), F.col("pairs")["before"].cast("long").alias("before"), F.col("pairs")["transforms"].alias("transforms"))


_TAB = "t AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)"


@query("SELECT p_partkey, 'csv' AS format, 2 AS n_records, p_name || ', \"x\"' AS name, p_brand AS brand, NULL::VARCHAR AS last FROM part UNION ALL SELECT p_partkey, 'markdown', 2, p_name, p_brand, NULL FROM part UNION ALL SELECT p_partkey, 'fixed', 2, p_name, p_brand, NULL FROM part")
def s8_s9_s10_s11_tables(spark, sf_dir):
    """Tables of three formats read back into records."""
    n, b = F.col("p_name"), F.col("p_brand")
    csv = F.concat(F.lit('name,brand,last\n"'), n, F.lit(', ""x""",'), b, F.lit("\n\nz,y,x,too,many"))
    mark = F.concat(F.lit("| name | brand | last |\n|---|:--:|---|\n| "), n, F.lit(" | "), b, F.lit(" |\n| z | y | x |"))
    fixed = F.concat(F.lit("name   brand  last\n"), n, F.lit("    "), b, F.lit("\n\nz  y   x"))
    parts = F.array(*[F.struct(F.lit(k).alias("format"), records(r).alias("r")) for k, r in (("csv", delimited(csv)), ("markdown", markdown_table(mark)), ("fixed", fixed_width(fixed)))])
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(parts).alias("t")).select("p_partkey", "t.format", F.size("t.r").alias("n_records"), F.element_at("t.r", 1).alias("first"))
    return rows.select("p_partkey", "format", "n_records", F.col("first")["name"].alias("name"), F.col("first")["brand"].alias("brand"), F.col("first")["last"].alias("last"))


QUERIES, ORACLES = query.queries, query.oracles
