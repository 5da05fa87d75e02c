"""Graphs: relationships, bounded traversal, shortest paths, and file priorities.

Edges are (source, target, type). Traversal is a loop of at most `hops` joins of the frontier with the edges; each round
keeps only nodes that are new, so that a hop costs the edges that it touches. Frontiers are cut off from their lineage by
checkpoints, which are local ones where the session has no checkpoint folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()

#: Rows of (start, node) that are sent to the tasks of the edges; more are joined by Spark's own choice of strategy.
BROADCAST_ROWS = 200_000
#: Near sources of a near node that are kept in one list.
LIST = 16


def directed(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(here, there, type) of the edges along a direction: out, in or both; the type filter holds for both ways."""
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "type")
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def reach(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both", types: list[str] | None = None, last: Column | None = None) -> DataFrame:
    """(start, node, depth) of all nodes within `hops` of each start (start), with their least depth.

    `last` is a condition on `there`: the last hop goes only to such nodes, where the caller has no use for others.
    """
    ways = directed(edges, direction, types).select("here", "there").distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        some = ways if last is None or depth < hops else ways.where(last)
        step = frontier.join(some, frontier.node == some.here).select("start", F.col("there").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, starts: DataFrame, hops: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(start, source, target, type) of the edges that touch a node nearer than `hops` to the start.

    The result can be starts times edges, so that its rows are made once and never compared: nodes and edges are distinct
    before they meet, and an edge between two near nodes comes from its source only.
    """
    inner = _cut((reach(edges, starts, hops - 1, direction, types) if hops > 1 else starts.select("start", F.col("start").alias("node"))).select("start", "node").distinct())
    kept = (edges if types is None else edges.where(F.col("type").isin(types))).select("source", "target", "type").distinct()
    few = inner.count() <= BROADCAST_ROWS
    near = lambda df: F.broadcast(df) if few else df
    columns = "start", "source", "target", "type"
    out = kept.join(near(inner), F.col("node") == F.col("source")).select(*columns)
    if direction == "out":
        return out
    if direction == "in":
        return kept.join(near(inner), F.col("node") == F.col("target")).select(*columns)
    # (start, target, source) of the edges between near nodes: first those between near nodes of any start.
    nodes = near(inner.select("node").distinct())
    within = kept.join(nodes, F.col("source") == F.col("node"), "left_semi").join(nodes, F.col("target") == F.col("node"), "left_semi").select("source", "target").distinct()
    twice = within.join(near(inner), F.col("source") == F.col("node")).select("start", F.col("target").alias("node"), "source").join(inner, ["start", "node"], "left_semi")
    twice = _cut(twice)
    n = twice.groupBy("start", "node").agg(F.count(F.lit(1)).alias("n"))
    # Short lists of such sources go with the node; where they are long, rows are compared with them.
    short = twice.join(n.where(F.col("n") <= LIST), ["start", "node"], "left_semi").groupBy("start", "node").agg(F.collect_list("source").alias("twice"))
    long = n.where(F.col("n") > LIST)
    ends = inner.join(long, ["start", "node"], "left_anti").join(short, ["start", "node"], "left")
    back = kept.join(near(ends), (F.col("node") == F.col("target")) & ~F.coalesce(F.array_contains("twice", F.col("source")), F.lit(False))).select(*columns)
    long = _cut(long)
    if long.isEmpty():
        return out.unionByName(back)
    most = kept.join(near(long), F.col("node") == F.col("target")).select(*columns)
    most = most.join(twice.select("start", F.col("node").alias("target"), "source"), ["start", "target", "source"], "left_anti").select(*columns)
    return out.unionByName(back).unionByName(most)


def shortest(edges: DataFrame, pairs: DataFrame, most: int = 10, direction: str = "both") -> DataFrame:
    """(start, goal, length) of pairs (start, goal): the length of a shortest path, null if none within `most`."""
    found = reach(edges, pairs.select("start").distinct(), most, direction).select("start", F.col("node").alias("goal"), F.col("depth").alias("length"))
    return pairs.join(found, ["start", "goal"], "left").select("start", "goal", "length")


# --- the graph of the test tables ------------------------------------------------------------------------------------


def graph(spark, sf_dir) -> DataFrame:
    """Customers in nations, nations in regions, suppliers in nations; and neighbouring nations."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda df, s, t, kind: df.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"))
    nation = read(spark, sf_dir, "nation")
    return functools.reduce(DataFrame.unionByName, [
        edge(read(spark, sf_dir, "customer"), name("c", "c_custkey"), name("n", "c_nationkey"), "lives_in"),
        edge(read(spark, sf_dir, "supplier"), name("s", "s_suppkey"), name("n", "s_nationkey"), "sells_in"),
        edge(nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "part_of"),
        edge(nation.where("n_nationkey < 20"), name("n", "n_nationkey"), F.concat(F.lit("n"), (F.col("n_nationkey") + 5).cast("string")), "next_to"),
    ])


_E = "e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives_in' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'sells_in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 5), 'next_to' FROM nation WHERE n_nationkey < 20)"
_BOTH = "w AS (SELECT source AS here, target AS there FROM e UNION SELECT target, source FROM e)"


@query(f"WITH {_E}, l AS (SELECT source, target, type, row_number() OVER (PARTITION BY source, target, type ORDER BY source) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM e WHERE type = 'next_to')), k AS (SELECT * FROM l WHERE r = 1 AND source <> 'n7' AND target <> 'n7') SELECT type, count(*) AS n FROM k GROUP BY 1")
def gr1_upsert_and_delete(spark, sf_dir):
    """Edges by type after repeated inserts and after one node went with all of its edges."""
    e = graph(spark, sf_dir)
    kept = e.unionByName(e.where("type = 'next_to'")).dropDuplicates(["source", "target", "type"]).where("source <> 'n7' and target <> 'n7'")
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E} SELECT source, target, type, source = 'n3' AS outgoing FROM e WHERE (source = 'n3' OR target = 'n3') AND type IN ('part_of', 'next_to', 'sells_in')")
def gr2_relationships(spark, sf_dir):
    """All relationships of one node of three types."""
    e = graph(spark, sf_dir)
    return e.where(((F.col("source") == "n3") | (F.col("target") == "n3")) & F.col("type").isin("part_of", "next_to", "sells_in")).withColumn("outgoing", F.col("source") == "n3")


@query(f"WITH RECURSIVE {_E}, {_BOTH}, s AS (SELECT 's' || s_suppkey AS start FROM supplier WHERE s_suppkey % 25 = 0), b AS (SELECT start, start AS node, 0 AS depth FROM s UNION SELECT start, there, depth + 1 FROM b JOIN w ON here = node WHERE depth < 1), i AS (SELECT DISTINCT start, node FROM b) SELECT DISTINCT start, source, target, type FROM i JOIN e ON node = source OR node = target")
def gr3_j11_subgraph(spark, sf_dir):
    """The edges within two hops of some suppliers."""
    starts = read(spark, sf_dir, "supplier").where("s_suppkey % 25 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"))
    return subgraph(graph(spark, sf_dir), starts, 2)


@query(f"WITH RECURSIVE {_E}, {_BOTH}, s AS (SELECT 's' || s_suppkey AS start FROM supplier WHERE s_suppkey % 25 = 0), b AS (SELECT start, start AS node, 0 AS depth FROM s UNION SELECT start, there, depth + 1 FROM b JOIN w ON here = node WHERE depth < 6 AND there NOT LIKE 'c%' AND there NOT LIKE 's%'), d AS (SELECT start, node, min(depth) AS depth FROM b GROUP BY ALL) SELECT s.start, 'r' || r_regionkey AS goal, depth::INT AS length FROM s, region LEFT JOIN d ON d.start = s.start AND d.node = 'r' || r_regionkey")
def gr4_shortest_paths(spark, sf_dir):
    """The length of a shortest path from some suppliers to each region, six steps at most."""
    starts = read(spark, sf_dir, "supplier").where("s_suppkey % 25 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"))
    goals = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("goal"))
    # Customers and suppliers are leaves: no path between others leads through them.
    inner = graph(spark, sf_dir).where(~F.col("source").startswith("c") & (~F.col("source").startswith("s") | F.col("source").isin([r.start for r in starts.collect()])))
    return shortest(inner, starts.join(F.broadcast(goals), F.lit(True)), 6)


def priority(signals: DataFrame, weights: dict[str, float]) -> Column:
    return F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)), 4)


_WEIGHTS = {"frequency": 0.3, "recency": 0.25, "author": 0.15, "branch": 0.1, "kind": 0.1, "centrality": 0.1}


@query("WITH f AS (SELECT l_partkey AS file, count(*) AS n, max(l_shipdate) AS last, avg((l_suppkey % 10 = 3)::INT) AS author, max((l_returnflag = 'R')::INT) AS branch FROM lineitem GROUP BY 1), g AS (SELECT *, n / max(n) OVER () AS frequency, exp(-0.693::DOUBLE * date_diff('day', last, max(last) OVER ()) / 90) AS recency FROM f), c AS (SELECT l_partkey AS file, count(DISTINCT l_suppkey) / 40.0::DOUBLE AS centrality FROM lineitem GROUP BY 1) SELECT file AS p_partkey, round(0.3::DOUBLE * frequency + 0.25::DOUBLE * recency + 0.15::DOUBLE * author + 0.1::DOUBLE * branch + 0.1::DOUBLE * CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0.5 END + 0.1::DOUBLE * least(1, centrality), 4) AS priority FROM g JOIN c USING (file) JOIN part ON p_partkey = file")
def gr5_j16_file_priorities(spark, sf_dir):
    """Files by six weighted signals; a missing one counts as 0."""
    lines = read(spark, sf_dir, "lineitem")
    f = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last"), F.avg((F.col("l_suppkey") % 10 == 3).cast("double")).alias("author"), F.max((F.col("l_returnflag") == "R").cast("double")).alias("branch"),
        F.least(F.lit(1.0), F.countDistinct("l_suppkey") / 40.0).alias("centrality"),
    )
    whole = f.agg(F.max("n").alias("most"), F.max("last").alias("now"))
    rows = f.crossJoin(F.broadcast(whole)).withColumns({"frequency": F.col("n") / F.col("most"), "recency": F.exp(F.lit(-0.693) * F.datediff("now", "last") / 90)})  # one row
    kinds = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", 1.0).otherwise(0.5).alias("kind"))
    rows = rows.join(kinds, "p_partkey")
    return rows.select("p_partkey", priority(rows, _WEIGHTS).alias("priority"))


@query(f"WITH {_E}, d AS (SELECT target AS node, count(*) AS degree FROM e GROUP BY 1) SELECT node, degree, round(degree / max(degree) OVER (), 6) AS centrality FROM d")
def gr6_centrality(spark, sf_dir):
    """In-degree of each node and its share of the largest."""
    d = graph(spark, sf_dir).groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return d.select("node", "degree", F.round(F.col("degree") / F.max("degree").over(Window.partitionBy()), 6).alias("centrality"))


@query("WITH p AS (SELECT DISTINCT l_suppkey % 30 AS a, l_partkey % 30 AS b FROM lineitem WHERE l_quantity > 48) SELECT a, b FROM p WHERE a <> b AND NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)")
def j17_no_contradictions(spark, sf_dir):
    """Learned rules a to b, without those whose reverse was learned as well."""
    p = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select((F.col("l_suppkey") % 30).alias("a"), (F.col("l_partkey") % 30).alias("b")).distinct()
    back = p.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return p.where("a <> b").join(back, ["a", "b"], "left_anti")


_VEC = "v AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 6)"


@query(f"WITH RECURSIVE {_VEC}, g AS (SELECT vec_id AS source, (vec_id * 7 + 1) % 500 AS target FROM embeddings), w AS (SELECT source AS here, target AS there FROM g UNION SELECT target, source FROM g), b AS (SELECT query, doc AS start, doc AS node, 0 AS depth FROM v UNION SELECT query, start, there, depth + 1 FROM b JOIN w ON here = node WHERE depth < 2), x AS (SELECT DISTINCT query, node AS doc, 0.5 AS score FROM (SELECT query, start, node, min(depth) AS depth FROM b GROUP BY ALL) WHERE depth > 0 AND node <> query), u AS (SELECT query, doc, max(score)::DOUBLE AS score FROM (SELECT query, doc, score FROM v UNION ALL SELECT * FROM x) WHERE doc < 500 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM u) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 8")
def m16_graph_expanded_search(spark, sf_dir):
    """The nearest vectors of a query and what is within two hops of them, at a fixed score."""
    from marlstone.operators.search import nearest, top

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    found = _cut(nearest(rows, rows.where("doc % 100 = 0").select(F.col("doc").alias("query"), "v"), 6).select("query", "doc", "score"))
    edges = rows.select(F.col("doc").alias("source"), ((F.col("doc") * 7 + 1) % 500).alias("target"), F.lit("link").alias("type"))
    # Only nodes below 500 are wanted: the second hop goes to no others, which are many for each node.
    near = reach(edges, found.select(F.col("doc").alias("start")).distinct(), 2, last=F.col("there") < 500).where("depth > 0 and node < 500").select(F.col("start").alias("doc"), "node")
    extra = found.select("query", "doc").join(near, "doc").where("node <> query").select("query", F.col("node").alias("doc"), F.lit(0.5).alias("score")).distinct()
    best = found.unionByName(extra).where("doc < 500").groupBy("query", "doc").agg(F.max("score").alias("score"))
    return top(best, 8).select("query", "doc", F.round("score", 6).alias("score"), "rank")


QUERIES, ORACLES = query.queries, query.oracles
