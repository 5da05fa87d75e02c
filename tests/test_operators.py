"""Operators that SQL cannot tell, and plug-ins, against brute force or worked examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import budgets, text as T
from marlstone.operators import crusher, dedup, graphs, lines, memories, quality, requests, search
from marlstone.plans import transforms


def test_minhash_finds_similar_texts(spark):
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefghij "), 400))
    rows = [(i, base[:i] + "#" + base[i:]) for i in range(20)] + [(20 + i, "".join(rng.choice(list("klmnopqrst "), 400))) for i in range(20)] + [(40, None), (41, ""), (42, "ab")]
    found = dedup.minhash_pairs(spark.createDataFrame(rows, "id long, text string"), 0.85).collect()
    grams = {i: {(t or "")[k : k + 3] for k in range(len(t or "") - 2)} for i, t in rows}
    pairs = {(r.a, r.b) for r in found if r.b < 40}
    assert pairs >= {(0, b) for b in range(1, 20)} and all(b < 20 for _, b in pairs)
    for r in found:
        if r.b < 40:
            a, b = grams[r.a], grams[r.b]
            assert abs(r.estimate - len(a & b) / len(a | b)) < 0.15


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {i: set(rng.choice([f"w{k}" for k in range(12)], rng.integers(1, 9)).tolist()) for i in range(60)}
    table = spark.createDataFrame([("g", i, sorted(s)) for i, s in sets.items()], "group string, id long, s array<string>")
    for share in (0.5, 0.7, 0.9):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > share}
        assert {(r.a, r.b) for r in dedup.similar_pairs(table, share).collect()} == want


def test_rouge_equals_dynamic_programming(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcde"), rng.integers(0, 80))) for _ in range(60)]
    rows = [(i, texts[i], texts[-1 - i]) for i in range(60)] + [(60, None, "a")]

    def lcs(x, y):
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]

    got = spark.createDataFrame(rows, "id long, a string, b string").select("id", quality.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        x, y = (rows[r.id][1] or "").split(), (rows[r.id][2] or "").split()
        n = lcs(x, y)
        p, q = (n / len(y), n / len(x)) if x and y else (0, 0)
        assert r.r == pytest.approx(2.5625 * p * q / (1.5625 * p + q) if n else 0.0)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, 3.0], 40), "c": np.array([7.0]), "d": rng.exponential(size=31) ** 4}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    table = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for buckets in (1, 7, 1024):
        for r in requests.quantiles(table, "k", "v", [0.0, 0.25, 0.5, 0.95, 1.0], buckets).collect():
            assert r.quantile == pytest.approx(np.quantile(values[r.k], r.share)), (r, buckets)


def test_prioritize_equals_plain_loop(spark):
    rng = np.random.default_rng(6)
    for limit in (5, 12, 40):
        n = 30
        items = [f"t{rng.integers(0, 14)}" for _ in range(n)]
        keep, critical = rng.random(n) < 0.4, rng.random(n) < 0.2
        keep |= critical
        current, seen = [], set()
        for i in range(n):
            if keep[i] and items[i] not in seen:
                seen.add(items[i])
                current.append(i)
        want = set(current)
        if len(current) < limit:
            left = [i for i in range(n) if i not in want]
            step, free = max(1, len(left) // (limit - len(current) + 1)), limit - len(current)
            for offset in range(step):
                for i in left[offset::step]:
                    if free and items[i] not in seen:
                        seen.add(items[i])
                        want.add(i)
                        free -= 1
        if len(current) > limit:
            want = {i for i in range(n) if critical[i]}
            for i in [0, 1, 2, n - 2, n - 1, *sorted(set(current))]:
                if len(want) < max(limit, critical.sum()):
                    want.add(i)
        table = spark.createDataFrame([(1, i, n, items[i], bool(keep[i]), bool(critical[i])) for i in range(n)], "arr long, idx long, n long, item string, keep boolean, critical boolean")
        assert {r.idx for r in crusher.prioritize(table, limit).where("final").collect()} == want


def test_array_class(spark):
    cases = {"[]": "empty", "[1, 2.5]": "number", '["a"]': "string", "[true]": "bool", "[[1]]": "nested", '[{"a": 1}]': "dict", '[1, "a"]': "mixed"}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", crusher.array_class(F.col("j")).alias("c")).collect()
    assert {r.j: r.c for r in rows} == cases


def test_reach_follows_directions_and_types(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "y"), ("d", "a", "x"), ("e", "f", "x")], "source string, target string, type string")
    start = spark.createDataFrame([("a",)], "start string")
    depth = lambda **k: {r.node: r.depth for r in graphs.reach(edges, start, 3, **k).collect()}
    assert depth(direction="out") == {"a": 0, "b": 1, "c": 2}
    assert depth(direction="in", types=["x"]) == {"a": 0, "d": 1}
    assert depth() == {"a": 0, "b": 1, "c": 1, "d": 1}
    pairs = spark.createDataFrame([("a", "c"), ("a", "f")], "start string, goal string")
    assert {(r.goal, r.length) for r in graphs.shortest(edges, pairs, 5, "out").collect()} == {("c", 2), ("f", None)}


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 4))
    table = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)] + [(40, [0.0] * 4)], "doc long, v array<double>")
    asked = table.where("doc % 10 = 0 and doc < 40").select(F.col("doc").alias("query"), "v")
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 4 * 2)
    got = {(r.query, r["rank"]): r.doc for r in search.nearest(table, asked, 3, dims=4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 10, 20, 30):
        order = [d for d in np.argsort(-(unit @ unit[q]), kind="stable") if d != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_memory_filter_ignores_unsafe_keys(spark):
    rows = spark.sql("select 1L id, 1L user_id, cast(null as long) session_id, cast(null as long) agent_id, cast(null as long) turn_id, timestamp_ntz'2024-01-01' created, timestamp_ntz'2024-01-01' valid_from, cast(null as timestamp_ntz) valid_until, cast(null as timestamp_ntz) expires, 0.5D importance, array('a') entities, '{\"k\": \"v\"}' metadata, cast(null as long) supersedes")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    count = lambda **k: rows.where(memories.MemoryFilter(**k).condition(now)).count()
    assert count(metadata={"k": "v", "k'] OR 1=1": "x"}) == 1 and count(metadata={"k": "w"}) == 0
    assert count(levels=["user"]) == 1 and count(levels=["turn"]) == 0 and count(entities=["b"]) == 0


def test_normal_cdf_and_budgets(spark):
    from statistics import NormalDist

    xs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(NormalDist().cdf(r.x), abs=1e-6) for r in rows)
    r = spark.range(1).select(budgets.net_gain(F.lit(None).cast("double"), F.lit(1), F.lit(1), F.lit(1)).alias("g"), budgets.frozen_prefix(F.array(F.lit(False), F.lit(True), F.lit(False))).alias("f")).first()
    assert r.g == float("-inf") and r.f == 2


def test_transforms_accept_only_smaller_texts(spark):
    class Grow(transforms.Transform):
        name = "grow"

        def apply(self, text):
            return F.concat(text, F.lit("more"))

    rows = spark.createDataFrame([(1, "a  b"), (2, "<<ccr:x>>  a"), (3, None)], "id long, t string")
    got = {r.id: (r.t, r.applied) for r in transforms.run(rows, "t", [Grow(), *transforms.REFORMATS]).collect()}
    assert got == {1: ("a b", ["squeeze_blanks"]), 2: ("<<ccr:x>>  a", []), 3: (None, [])}
    transforms.register("scorer", "length", lambda c: F.length(c))
    with pytest.raises(ValueError):
        transforms.register("nothing", "x", lambda c: c)


def test_clean_terminal_and_collapse(spark):
    text = "\x1b[31mred\x1b[0m\nload\rdone\n██ 40%\n⠋\n\n\n\nend"
    r = spark.createDataFrame([(text, "a\na\n\nb\n b\nb")], "t string, u string").select(lines.clean_terminal(F.col("t")).alias("a"), lines.collapse_identical(F.col("u")).alias("b")).first()
    assert r.a == "red\ndone\n\nend" and r.b == "a (x2)\nb (x3)"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_of_copies_and_long_sets(spark):
    rng = np.random.default_rng(14)
    common = [f"c{i}" for i in range(400)]
    bases = [[*rng.choice(common, n, replace=False), *(f"b{j}.{i}" for i in range(n // 2))] for j, n in enumerate((2, 5, 20, 60, 300))]
    rows = [(g, [w for w in base if rng.random() > cut] if cut else list(base)) for base in bases for g in "xy" for cut in (0, 0, 0.02, 0.08, 0.15, 0.3) for _ in range(2)]
    rows = [(g, i, list(map(str, s))) for i, (g, s) in enumerate(rows)] + [("x", 900, []), ("x", 901, []), ("x", 902, None), (None, 903, ["b0.0"]), (None, 904, ["b0.0"])]
    rows += [("y", 0, rows[0][2]), ("x", 905, ["b0.0"])]  # an id of two rows
    sets = [(g, i, frozenset(s)) for g, i, s in rows if g and s]
    table = spark.createDataFrame(rows, "group string, id long, s array<string>").repartition(3)
    for share in (0.6, 0.7, 0.9):
        found = dedup.similar_pairs(table, share)
        assert "explode(s#" not in plan(found)
        want = sorted((g, a, b, len(s & t) / len(s | t)) for g, a, s in sets for h, b, t in sets if g == h and a < b and len(s & t) / len(s | t) > share)
        assert sorted(map(tuple, found.collect())) == want


def test_pairs_of_a_word_go_on_in_the_next_batch():
    import pyarrow as pa

    rng = np.random.default_rng(15)
    rows = sorted((int(w), int(n), int(k), 1) for k, (w, n) in enumerate(zip(rng.integers(-2, 3, 200), rng.integers(5, 30, 200))))
    batches = [pa.record_batch([pa.array([r[c] for r in rows[i : i + 7]]) for c in (0, 2, 1, 3)], ["w", "k", "n", "p"]) for i in range(0, 200, 7)]
    got = {}
    for r in (r for b in dedup._paired(0.7)(iter(batches)) for r in zip(*b.to_pydict().values())):
        got[r[:2]] = (got.get(r[:2], (0,))[0] + r[2], r[3])
    fit = lambda m, n: (need := int(np.ceil(0.7 / 1.7 * (m + n) - 1e-6))) and min(m, n) + min(dedup.EXTRA, need - 1) >= need
    assert got.keys() == {(a, b) for w, m, a, _ in rows for x, n, b, _ in rows if w == x and a < b and fit(m, n) and min(m, n) >= 0.7 * max(m, n)}
    assert {c for c, _ in got.values()} == {1} and {x for _, x in got.values()} == {dedup.EXTRA + 1}


def test_nearest_meets_no_pairs_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, (3000, 3)).astype(float)
    v[:2500] = v[0]  # ties by doc
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)]
    table = spark.createDataFrame(rows + [(3000, None), (3001, [1.0, None, 2.0]), (3002, [1.0]), (None, [1.0, 1.0, 1.0])], "doc long, v array<float>").repartition(3)
    asked = table.where("doc % 100 = 0 and doc < 3000").select(F.col("doc").alias("query"), "v")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    for size in (32 << 20, 8 * 3 * 7):
        monkeypatch.setattr(search, "BLOCK_BYTES", size)
        found = search.nearest(table, asked, 5, 0.1, dims=3)
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
        got = {}
        for r in found.collect():
            got.setdefault(r.query, {})[r["rank"]] = (r.doc, r.score)
        for q in range(0, 3000, 100):
            s = np.round(unit @ unit[q], 6)
            want = sorted(((-s[d], d) for d in range(3000) if d != q and s[d] >= 0.1))[:5]
            assert [got[q][k + 1] for k in range(len(want))] == [(d, pytest.approx(-x)) for x, d in want]


def nearest_of(ids, q, v, k):
    import pyarrow as pa

    types = pa.schema([("query", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])
    batches = [pa.record_batch([pa.array(range(i, min(i + 4000, len(v)))), pa.array(list(v[i : i + 4000]))], ["doc", "v"]) for i in range(0, len(v), 4000)]
    return [r for b in search._nearest_of([(ids, q)], k, -1.0, types)(iter(batches)) for r in zip(*b.to_pydict().values())]


def test_nearest_screens_rows_before_it_scores_them():
    import time

    rng = np.random.default_rng(12)
    v = rng.normal(size=(12_000, 64))
    ids = np.arange(1200)

    def seconds(f):
        times = []
        for _ in range(3):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert seconds(lambda: nearest_of(ids, v[ids], v, 1)) < 2 * seconds(lambda: [(x := v[ids] @ v[i : i + 1000].T).argmax(1) + np.round(x).argmax(1) for i in range(0, len(v), 1000)])


def test_nearest_in_tiles_equals_brute_force():
    rng = np.random.default_rng(13)
    v = rng.normal(size=(9000, 8))
    v[rng.choice(9000, 3000)] = v[7]
    v[5000:5040] = v[7] * (1 + 1e-7 * rng.normal(size=(40, 8)))  # differ in the seventh digit
    v[[8, 700, 8999]] = 0
    v[11] *= 1e200  # its norm is no usual number
    for odd in (False, True):
        v[4500] = np.nan if odd else 1.0
        ids = np.arange(0, 9000, 100)
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(1))
            x = v[ids] @ v.T / (norm[ids, None] * norm)
        x[norm[ids, None] * norm == 0] = 0
        x = np.floor(np.abs(x) * 1e6 + 0.5) * np.sign(x)
        got = {}
        for q, d, s in nearest_of(ids, v[ids], v, 3):
            got.setdefault(q, []).append(d)
        for i, q in enumerate(ids):
            want = sorted((-(2e6 if np.isnan(x[i, d]) else x[i, d]), d) for d in range(9000) if d != q)[:3]
            assert got[q] == [d for _, d in want]


def test_semantic_cache_meets_no_pairs_of_rows(spark):
    found = search.r15_semantic_cache(spark, "/root/testdata/sf0.001")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_hybrid_memory_search_meets_no_pairs_of_rows(spark):
    found = memories.m17_hybrid_memory_search(spark, "/root/testdata/sf0.001")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert plan(found.select("query")).count("label") and "label#" not in "".join(x for x in plan(found).splitlines() if "Join" in x)


def test_near_keys_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), int(i)) for g, i in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400))]
    got = memories.near_keys(spark.createDataFrame(rows, "g int, i long"), "g", "i", F.col("i") % 10 == 0, 4).collect()
    found = {}
    for r in got:
        found.setdefault(r.i, []).append((abs(r.other - r.i), r.other))
    for q in {i for _, i in rows if i % 10 == 0}:
        want = sorted((abs(o - i), o) for g, i in rows if i == q for h, o in rows if h == g and o != i)
        assert sorted(found.get(q, []))[:4] == want[:4]


def test_millionths_round_as_the_sql(spark):
    import duckdb

    xs = [0.7 * (i / 1e6) for i in range(999_000, 1_000_000, 5)]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(search.millionths(F.col("x")).alias("y")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]


def test_last_hop_goes_only_where_asked(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("b", "d", "x"), ("a", "e", "x")], "source string, target string, type string")
    found = graphs.reach(edges, spark.createDataFrame([("a",)], "start string"), 2, "out", last=F.col("there") == "d")
    assert {r.node: r.depth for r in found.collect()} == {"a": 0, "b": 1, "e": 1, "d": 2}
    assert "Join" not in plan(found)  # frontiers are cut off from their lineage


def test_trailing_sums_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(int(g), int(t), int(v)) for g, t, v in zip(rng.integers(0, 2, 300), rng.integers(0, 400, 300) * 1_000_000 + rng.integers(0, 2, 300), rng.integers(0, 9, 300))] + [(0, None, 3), (0, None, 4), (None, 5, 2), (0, 7, None)]
    found = requests.trailing_sums(spark.createDataFrame(rows, "g int, at long, v long"), "g", "at", ["v"], [1, 60, 300])
    assert "RangeFrame, -" not in plan(found)  # no frame that moves along with its rows
    got = {(r.g, r.at): (r.v_1, r.v_60, r.v_300) for r in found.collect()}
    assert len(got) == len({r[:2] for r in rows}) and got[0, None] == (7, 7, 7)
    for g, t in got:
        if t is not None:
            assert got[g, t] == tuple(sum(v or 0 for h, u, v in rows if h == g and u is not None and t - s * 1_000_000 <= u < t) for s in (1, 60, 300))


def test_spend_guard_has_no_moving_frames(spark):
    assert "RangeFrame, -" not in plan(requests.g43_w21_spend_guard(spark, "/root/testdata/sf0.001"))


def test_shingles_are_not_broadcast(spark):
    found = dedup.t49_message_scores(spark, "/root/testdata/sf0.001")
    assert not [x for x in plan(found).splitlines() if "BroadcastHashJoin" in x and ", g#" in x]


def test_message_scores_of_copies(spark):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("ab "), 12)) for _ in range(6)] + ["abc", "", None]
    rows = [(c, t, "user", texts[rng.integers(0, len(texts))]) for c in range(6) for t in range(9 if c else 1)]
    found = dedup.message_scores(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r.uniqueness for r in found.collect()}
    sets = {(c, t): {x[i : i + 5] for i in range(max(1, len(x) - 4))} for c, t, _, x in rows if x}
    for c, t, _, x in rows:
        far = [1 - len(s & sets[c, t]) / len(s | sets[c, t]) for (d, u), s in sets.items() if x and d == c and u != t]
        assert got[c, t] == pytest.approx(sum(far) / len(far) if far else (1.0 if x else 0.0))


def test_hybrid_scores_equal_queries_once(spark, monkeypatch):
    asked, bm25 = [], search.bm25
    monkeypatch.setattr(search, "bm25", lambda docs, doc, text, queries: asked.append(queries) or bm25(docs, doc, text, queries))
    assert "NestedLoop" not in plan(search.r9_j18_hybrid(spark, "/root/testdata/sf0.1"))
    texts = [r.text for q in asked for r in q.collect()]
    assert len(texts) == len(set(texts))


def test_context_health_adds_in_the_order_of_ids(spark, tmp_path):
    import duckdb

    # A table in order of ids, and the same rows in five files without order.
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").repartition(5, F.xxhash64("event_id", F.lit(1))).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    want = sorted(con.execute(requests.ORACLES["g38_context_health"]).fetchall())
    for folder in ("/root/testdata/sf0.1", str(tmp_path)):
        got = requests.g38_context_health(spark, folder).select("instance", "n", "health", "state").collect()
        assert sorted(map(tuple, got)) == want


def test_context_health_of_unknown_sizes(spark, tmp_path):
    rows = [(1, 7, "{}"), (2, 7, None), (3, 8, '{"k": 3}'), (4, 8, "{}"), (5, None, '{"k": 5}')]
    table = spark.createDataFrame(rows, "event_id long, user_id long, props string").select("event_id", F.expr("timestamp_ntz'2024-01-01'").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), "props")
    table.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.instance: (r.n, r.health, r.state) for r in requests.g38_context_health(spark, str(tmp_path)).collect()}
    assert got == {7: (2, None, "critical"), 8: (2, 0.566588, "warning"), None: (1, 0.58425, "ok")}  # as in DuckDB


def test_bm25_best_equals_ranked_bm25(spark, monkeypatch):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(40)] + ["a_long_word", "another_long"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(rng.integers(0, 30))) for i in range(400)] + [(i, "w1 w2 a_long_word w3") for i in range(400, 440)]
    rows += [(5, text(9)), (5, text(4)), (7, None), (None, text(5)), (None, text(6)), (441, None), (442, "")]
    asked = [(i, text(rng.integers(1, 6))) for i in range(60)] + [(60, "w1 w1 a_long_word"), (None, "w2 w3"), (61, "unseen"), (62, None), (63, "w1 w1 w1 w2"), (63, "w1 w5")]
    docs, queries = spark.createDataFrame(rows, "id long, text string").repartition(5), spark.createDataFrame(asked, "query long, text string")
    for k, keep in ((3, None), (500, None), (4, spark.range(100, 420).withColumnRenamed("id", "doc"))):
        hits = search.bm25(docs, "id", "text", queries).where("doc is not null").withColumn("score", F.round("score", 6))
        want = search.top(hits if keep is None else hits.join(keep, "doc"), k).select("query", "doc", "score", "rank").collect()
        for terms in (1_000_000, 50):
            monkeypatch.setattr(search, "BLOCK_TERMS", terms)
            got = search.bm25_best(docs, "id", "text", queries, k, keep).select("query", "doc", "score", "rank").collect()
            key = lambda r: (r[0] is None, r[0] or 0, r[3])
            assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    none = search.bm25_best(docs, "id", "text", queries.where("query > 99"), 3)
    assert none.collect() == [] and search.bm25_best(docs.where("id > 999"), "id", "text", queries, 3).collect() == []


def test_message_search_makes_no_pairs_of_messages(spark, monkeypatch):
    monkeypatch.delattr(search, "bm25")
    assert search.r10_r11_j2_message_search(spark, "/root/testdata/sf0.001").count() > 0


def test_message_search_takes_ids_apart_as_its_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, "assistant" if t % 2 else "user", f"red w{c} w{t % 7}") for c in range(0, 30) for t in (0, 1, 2, 3, 999, 1000, 1001, 1003)] + [(10, 1, "assistant", "red red w10"), (20, 3, "user", "w20"), (10, 0, "user", "red w10")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = "query", "doc", "score", "n"  # ranks of equal ids are open
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({search.ORACLES['r10_r11_j2_message_search']})").fetchall()
    assert sorted(map(tuple, search.r10_r11_j2_message_search(spark, str(tmp_path)).select(*columns).collect())) == sorted(want)


def test_bm25_makes_no_pairs_of_documents(spark, monkeypatch):
    monkeypatch.delattr(search, "bm25")
    assert search.r2_bm25(spark, "/root/testdata/sf0.001").count() > 0


def test_subgraph_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(31)
    name = lambda i: None if i == 19 else f"n{i}"
    rows = [(name(a), name(b), t) for a, b, t in zip(rng.integers(0, 20, 90), rng.integers(0, 20, 90), rng.choice(["x", "y"], 90))] + [("n1", "n1", "x"), ("n1", "n2", "x"), ("n1", "n2", "x"), ("n1", "n2", None)]
    rows += [(f"leaf{i}", "n1", "x") for i in range(30)] + [("n1", f"leaf{i}", "y") for i in range(5)]
    edges = spark.createDataFrame(rows, "source string, target string, type string").repartition(3)
    starts = ["n0", "n1", "n1", "n7", "leaf3", "nowhere"]
    table = spark.createDataFrame([(s,) for s in starts], "start string")

    def brute(hops, direction, types):
        want, some = set(), {e for e in rows if types is None or e[2] in types}
        for s in starts:
            near = {s}
            for _ in range(hops - 1):
                near |= {b for a, b, _ in some if a in near and direction != "in"} | {a for a, b, _ in some if b in near and direction != "out"}
                near.discard(None)
            want |= {(s, *e) for e in some if e[0] in near and direction != "in" or e[1] in near and direction != "out"}
        return want

    for hops, direction, types in ((1, "both", None), (2, "both", None), (3, "both", ["x"]), (2, "in", None), (2, "out", None)):
        want = brute(hops, direction, types)
        for few, length in ((200_000, 16), (0, 1)) if direction == "both" else ((200_000, 16), (0, 16)):
            monkeypatch.setattr(graphs, "BROADCAST_ROWS", few)
            monkeypatch.setattr(graphs, "LIST", length)
            got = list(map(tuple, graphs.subgraph(edges, table, hops, direction, types).select("start", "source", "target", "type").collect()))
            assert len(got) == len(set(got)) and set(got) == want


def test_subgraph_does_not_compare_its_rows(spark):
    df = graphs.gr3_j11_subgraph(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Only edges are made distinct, before they meet the starts.
    assert plan.lstrip().startswith("Union") and "Aggregate [source#" in plan and "Aggregate [start" not in plan.split("Join")[0]
