"""Stores and sinks: metrics by URL, transcripts, content-addressed entries, memories, reports and exports.

A store is a folder of append-only tables that any executor can reach. An update appends a newer row and readers take the
latest one of a key, so that concurrent readers never see a half-written state; compact() rewrites a store by itself.
"""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marlstone.functions.text import escaped_label

METRICS = "id string, ts timestamp, model string, mode string, tokens_before long, tokens_after long, extra map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# --- metrics ---------------------------------------------------------------------------------------------------------


class MetricsStore:
    """Metrics in JSON lines or Parquet; blank and broken lines are skipped."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "jsonl"):
        self.spark, self.path, self.kind = spark, path, kind

    def save(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append")
        writer.json(self.path) if self.kind == "jsonl" else writer.parquet(self.path)

    def all(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], METRICS)
        if self.kind == "parquet":
            return self.spark.read.schema(METRICS).parquet(self.path)
        rows = self.spark.read.schema(f"{METRICS}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(self.path)
        return rows.where("_broken is null and id is not null").drop("_broken")

    def get(self, id_: str) -> DataFrame:
        return self.all().where(F.col("id") == id_)

    def query(self, start=None, end=None, model: str | None = None, mode: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Newest first; both ends of the range are included."""
        rows = self.all()
        for test, value in (("ts >= '{}'", start), ("ts <= '{}'", end), ("model = '{}'", model), ("mode = '{}'", mode)):
            if value is not None:
                rows = rows.where(test.format(str(value).replace("'", "''")))
        rows = rows.orderBy(F.desc("ts"), "id").offset(offset)
        return rows if limit is None else rows.limit(limit)


_SCHEMES: dict[str, Callable[[SparkSession, str], MetricsStore]] = {
    "jsonl": lambda spark, path: MetricsStore(spark, path, "jsonl"), "parquet": lambda spark, path: MetricsStore(spark, path, "parquet")
}


def register_scheme(scheme: str, make: Callable[[SparkSession, str], MetricsStore]) -> None:
    _SCHEMES[scheme] = make


def open_store(spark: SparkSession, url: str) -> MetricsStore:
    """The store that a URL such as jsonl:///folder names."""
    scheme, _, path = url.partition("://")
    if not path or scheme not in _SCHEMES:
        raise ValueError(f"unknown store: {url}; known schemes: {', '.join(sorted(_SCHEMES))}")
    return _SCHEMES[scheme](spark, path)


# --- transcripts -----------------------------------------------------------------------------------------------------


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, role, text, tool, call_id) of JSON-lines transcripts; lines that are no JSON are skipped."""
    schema = "role string, content string, tool string, tool_call_id string, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null and role is not null").select(F.input_file_name().alias("file"), "role", F.col("content").alias("text"), "tool", F.col("tool_call_id").alias("call_id"))


def markdown_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(file, turn, role, text) of Markdown sessions whose turns begin with '#### ' (user) or '> ' (tool)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    lines = text.select("file", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    role = F.when(F.col("line").startswith("#### "), "user").when(F.col("line").startswith("> "), "tool").when(F.trim("line") == "", None).otherwise("assistant")
    lines = lines.withColumn("role", role).where("role is not null")
    w = Window.partitionBy("file").orderBy("i")
    lines = lines.withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")).withColumn("turn", F.sum("new").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("line", "^(#### |> )", "").alias("t")))), lambda s: s["t"]), "\n")
    return lines.groupBy("file", "turn", "role").agg(body.alias("text"))


def json_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(file, turn, role, text) of JSON documents with a list `messages`."""
    rows = spark.read.option("multiLine", True).schema("messages array<struct<role:string,content:string>>").json(path)
    return rows.select(F.input_file_name().alias("file"), F.posexplode("messages").alias("turn", "m")).select("file", "turn", "m.role", F.col("m.content").alias("text"))


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"jsonl": transcripts, "md": markdown_sessions, "json": json_sessions}


def sessions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sessions of several formats, by the ending of each path, as one table."""
    out = None
    for path in paths:
        part = ADAPTERS[path.rsplit(".", 1)[-1]](spark, path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load_spreadsheet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook without trailing empty rows; needs a pandas Excel engine, which is optional."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None, dtype=str)  # raises ImportError where no engine is installed
    return {name: spark.createDataFrame(sheet[: sheet.dropna(how="all").index.max() + 1 if len(sheet.dropna(how="all")) else 0]) for name, sheet in sheets.items()}


# --- keyed stores ----------------------------------------------------------------------------------------------------


class LatestStore:
    """A keyed table: put() appends rows with a version, current() has the latest live one of each key."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = f"{schema}, _version long, _deleted boolean"

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        version = self.version() + 1
        for c in names:
            if c not in rows.columns and not c.startswith("_"):
                rows = rows.withColumn(c, F.lit(None))
        schema = self.spark.createDataFrame([], self.schema).schema
        rows = rows.withColumns({"_version": F.lit(version), "_deleted": F.lit(deleted)}).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows.write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def version(self) -> int:
        return self.log().agg(F.max("_version")).first()[0] or 0

    def put(self, rows: DataFrame) -> None:
        self._append(rows, False)

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select(*self.key).distinct(), True)

    def clear(self, condition: Column) -> None:
        """Delete all current rows of a scope."""
        self.delete(self.current().where(condition))

    def current(self) -> DataFrame:
        w = Window.partitionBy(*self.key).orderBy(F.desc("_version"))
        rows = self.log().withColumn("_r", F.row_number().over(w)).where("_r = 1 and not _deleted")
        return rows.drop("_r", "_version", "_deleted")


class ContentStore(LatestStore):
    """Content-addressed entries: the key is 24 digits of the SHA-256 of the original; entries expire."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 300):
        super().__init__(spark, path, ["hash"], "hash string, original string, compressed string, tool string, stored timestamp")
        self.ttl = ttl_seconds

    def store(self, rows: DataFrame) -> None:
        """rows: original, compressed, tool."""
        self.put(rows.dropDuplicates(["original"]).withColumns({"hash": F.substring(F.sha2("original", 256), 1, 24), "stored": F.current_timestamp()}))

    def live(self) -> DataFrame:
        return self.current().where(F.col("stored") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.ttl)))

    def get(self, hashes: DataFrame) -> DataFrame:
        return self.live().join(hashes.select("hash").distinct(), "hash", "left_semi")


# --- reports and exports ---------------------------------------------------------------------------------------------


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in a fixed order, with a header."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def prometheus(rows: DataFrame, name: str, kind: str, help_: str, labels: list[str], value: str) -> DataFrame:
    """Lines (at, line) of one metric in the Prometheus text format, with label values escaped."""
    parts = [F.concat(F.lit(f'{c}="'), escaped_label(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels]
    line = F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string"))
    head = rows.sparkSession.createDataFrame([(0, f"# HELP {name} {help_}"), (1, f"# TYPE {name} {kind}")], "at long, line string")
    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(*labels)) + 1).cast("long").alias("at"), line.alias("line")))


def html_report(title: str, tables: dict[str, DataFrame], limit: int = 100) -> str:
    """A page of small tables: at most `limit` rows of each reach the driver; everything is escaped."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in tables.items():
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.limit(limit).collect()]
        out.append("</table>")
    return "".join([*out, "</body></html>"])


def markdown_memories(texts: DataFrame) -> DataFrame:
    """(file, heading, content, hash) of the bullets and paragraphs of Markdown texts (file, text), under their headings."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("line").rlike("^#{1,6} "), F.regexp_replace("line", "^#{1,6} ", ""))
    lines = lines.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).where(~F.col("line").rlike("^#{1,6} ") & (F.trim("line") != ""))
    content = F.trim(F.regexp_replace("line", r"^\s*[-*+] ", ""))
    return lines.select("file", F.coalesce("heading", F.lit("")).alias("heading"), content.alias("content"), F.sha2(F.concat_ws("\x00", F.coalesce("heading", F.lit("")), content), 256).alias("hash"))


def import_new(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Sections that the store does not hold yet, by their hash."""
    return parsed.dropDuplicates(["hash"]).join(stored.select("hash").distinct(), "hash", "left_anti")


def export_markdown(rows: DataFrame) -> DataFrame:
    """(file, text): memories (file, heading, content) as headings and bullets."""
    section = rows.groupBy("file", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list("content")), lambda c: F.concat(F.lit("- "), c)), "\n").alias("body"))
    parts = section.withColumn("part", F.concat(F.lit("## "), "heading", F.lit("\n"), "body"))
    return parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heading", "part"))), lambda s: s["part"]), "\n\n").alias("text"))


def refresh_summary(spark: SparkSession, path: str, summary: DataFrame) -> None:
    """Replace the one row of a summary table: the row is made first, so that a table may be summed up into itself."""
    row = summary.withColumn("updated", F.current_timestamp())
    if row.count() != 1:
        raise ValueError("a summary has one row")
    local = spark.createDataFrame(row.collect(), row.schema)  # one row
    local.write.mode("overwrite").parquet(path)


def scheduled_refresh(stream: DataFrame, path: str, summarize: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "1 hour"):
    """Refresh a summary from a stream's source table at an interval; stop the returned query to end it."""
    return stream.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: refresh_summary(batch.sparkSession, path, summarize(batch))).start()
