"""Stores, parsers, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import parsers, stores
from marlstone.streaming import stateful, windows


def test_metrics_store(spark, tmp_path):
    store = stores.open_store(spark, f"jsonl://{tmp_path}/m")
    assert store.all().count() == 0
    rows = spark.sql("select cast(id as string) id, timestamp'2024-01-01' + make_dt_interval(cast(id as int)) ts, if(id % 2 = 0, 'a', 'b') model, 'x' mode, id tokens_before, id tokens_after, map('k', 'v') extra from range(10)")
    store.save(rows)
    (tmp_path / "m" / "part-broken.json").write_text("\n\nnot json\n")
    assert store.all().count() == 10 and store.get("3").first().tokens_before == 3
    got = store.query(start="2024-01-03", end="2024-01-09", model="a", limit=2, offset=1).collect()
    assert [r.id for r in got] == ["6", "4"]
    with pytest.raises(ValueError):
        stores.open_store(spark, "nosuch://x")
    stores.register_scheme("other", lambda s, p: stores.MetricsStore(s, p, "parquet"))
    assert stores.open_store(spark, f"other://{tmp_path}/n").kind == "parquet"


def test_sessions_of_several_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role": "user", "content": "hi"}\nbroken\n{"role": "tool", "content": "x", "tool_call_id": "1"}\n')
    (tmp_path / "b.md").write_text("#### do it\nfine\nand more\n\n> out\n")
    (tmp_path / "c.json").write_text(json.dumps({"messages": [{"role": "user", "content": "one"}, {"role": "assistant", "content": "two"}]}))
    got = stores.sessions(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.md", "c.json")]).collect()
    assert sorted((r.role, r.text) for r in got) == sorted([("user", "hi"), ("tool", "x"), ("user", "do it"), ("assistant", "fine\nand more"), ("tool", "out"), ("user", "one"), ("assistant", "two")])


def test_latest_store(spark, tmp_path):
    store = stores.LatestStore(spark, str(tmp_path / "s"), ["k"], "k string, v long")
    store.put(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v long"))
    store.put(spark.createDataFrame([("a", 9)], "k string, v long"))
    store.delete(spark.createDataFrame([("b",)], "k string"))
    assert sorted(map(tuple, store.current().collect())) == [("a", 9), ("c", 3)]
    store.clear(F.col("v") > 5)
    assert [tuple(r) for r in store.current().collect()] == [("c", 3)]


def test_content_store(spark, tmp_path):
    store = stores.ContentStore(spark, str(tmp_path / "c"))
    store.store(spark.createDataFrame([("one", "o", "t"), ("one", "o", "t"), ("two", "w", "t")], "original string, compressed string, tool string"))
    assert store.live().count() == 2
    key = store.live().where("original = 'two'").select("hash")
    assert store.get(key).first().compressed == "w"
    assert stores.ContentStore(spark, str(tmp_path / "c"), ttl_seconds=-10).live().count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([('a"b\\', 1), ("c\nd", 2)], "k string, v long")
    lines = [r.line for r in stores.prometheus(rows, "hits", "counter", "Hits.", ["k"], "v").orderBy("at").collect()]
    assert lines == ["# HELP hits Hits.", "# TYPE hits counter", 'hits{k="a\\"b\\\\"} 1', 'hits{k="c\\nd"} 2']
    assert "&lt;b&gt;" in stores.html_report("<b>", {"t": rows}) and "c\nd" in stores.html_report("x", {"t": rows})
    stores.export_csv(rows, str(tmp_path / "csv"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "k"]
    for n in (1, 2):
        stores.refresh_summary(spark, str(tmp_path / "sum"), rows.agg((F.sum("v") * n).alias("total")))
    assert [r.total for r in spark.read.parquet(str(tmp_path / "sum")).collect()] == [6]


def test_markdown_memories(spark):
    text = spark.createDataFrame([("f", "intro\n# One\n- a\n- b\n## Two\npara\n")], "file string, text string")
    parsed = stores.markdown_memories(text)
    assert sorted((r.heading, r.content) for r in parsed.collect()) == [("", "intro"), ("One", "a"), ("One", "b"), ("Two", "para")]
    assert stores.import_new(parsed, parsed.where("heading = 'One'")).count() == 2
    assert stores.export_markdown(parsed.where("heading <> ''")).first().text == "## One\n- a\n- b\n\n## Two\n- para"


def test_parsers(spark):
    csv = spark.createDataFrame([('a,b\n"x, ""y""",2\n\n3',)], "t string").select(parsers.records(parsers.delimited(F.col("t"))).alias("r")).first().r
    assert csv == [{"a": 'x, "y"', "b": "2"}, {"a": "3", "b": None}]
    kv = spark.createDataFrame([("a=1 b=x=y transforms=p, q r",), ("none",)], "t string").select(parsers.key_values(F.col("t")).alias("m")).collect()
    assert kv[0].m == {"a": "1", "b": "x=y", "transforms": "p, q r"} and kv[1].m == {}


ROWS = [("k", i, f"2024-01-01 00:00:{i:02d}") for i in range(12)]


def folded(spark, step, schema, sql):
    rows = spark.createDataFrame(ROWS, "key string, id long, ts string").selectExpr("key", "id", "cast(ts as timestamp) ts", *sql)
    return [tuple(r) for r in stateful.fold(rows, "key", ["ts", "id"], step, schema).orderBy("id").collect()]


def test_stateful_steps(spark):
    allowed = folded(spark, stateful.token_bucket(0.5, 2), "id long, allowed boolean", [])
    assert [a for _, a in allowed] == [True, True, True] + [False, True] * 4 + [False]
    fired = folded(spark, stateful.alerts(0.8, 5, 4), "id long, value double", ["cast(id * 2 as double) value", "cast(12 as double) limit"])
    assert [i for i, _ in fired] == [5, 9]
    assert folded(spark, stateful.prefix_tracker(), "id long, frozen long, before long", ["id * 10 cache_read", "0L cache_write", "array(15L, 15L, 100L) tokens"])[:5] == [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 2, 1), (4, 2, 2)]
    assert [d for _, d in folded(spark, stateful.drift(["mode"]), "id long, drifted boolean", ["id div 5 mode"])] == [i in (5, 10) for i in range(12)]
    assert folded(spark, stateful.every(5), "id long, n long", []) == [(4, 5), (9, 10)]
    assert folded(spark, stateful.flush(4), "id long, total double", ["cast(id as double) value"]) == [(3, 6.0), (7, 22.0), (11, 38.0)]
    states = [s for _, s in folded(spark, stateful.circuit_breaker(2, 3), "id long, state string", ["id not in (1, 2) ok"])]
    assert states[:7] == ["closed", "closed", "opened", "open", "open", "closed", "closed"]


def test_sse():
    state, events = {}, []
    data = 'event: a\ndata: {"delta": {"text": "né"}}\n\n: note\n\ndata: {"delta": {"text": "e"}, "usage": {"out": 3}}\r\n\r\ndata: [DONE]\n\n'.encode()
    for i in range(0, len(data), 7):
        state, got = stateful.sse_events(state, data[i : i + 7])
        events += got
    assert [e["event"] for e in events] == ["a", "message", "message"]
    assert stateful.fold_deltas(events) == {"text": "née", "usage": {"out": 3}}


def test_streams_equal_tables(spark, tmp_path):
    rows = spark.sql("select id event_id, timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id * 7 as int)) ts, id % 3 user_id, cast(id as double) value from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for n, make in enumerate((lambda e: windows.tumbling(e, "1 hour", ["user_id"]), lambda e: windows.sliding(e, "2 hours", "1 hour", []), lambda e: windows.first_of(e.withColumn("k", F.col("event_id") % 7), ["k"]).select("k"))):
        mode = "append" if n == 2 else "complete"
        q = make(stream).writeStream.format("memory").queryName(f"s{n}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(f"s{n}").collect())) == sorted(map(str, make(rows).collect()))
    step = stateful.every(20)
    q = stateful.run(stream.withColumn("id", F.col("event_id")), "user_id", ["ts"], step, "id long, n long").writeStream.format("memory").queryName("st").outputMode("append").option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("st").collect()) == [57, 58, 59]
