"""Scoped memories: filters, versions, decay, budgets, retrieval, shared context, caches.

A memory has an id, scope ids (user, session, agent, turn), times (created, valid_from, valid_until, expires), importance,
entity references, metadata as JSON, an access count and a content. Packing folds over the sorted entries of one user;
everything else is a filter, a window or a join.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.operators.search import millionths, nearest, tokens, top
from marlstone.plans.registry import Registry
from marlstone.sources.tables import read

query = Registry()
NOW = "1999-01-01 00:00:00"
#: Decay by day that halves importance in a week, and the importance below which a memory expires.
RATE, LEAST = math.log(2) / 7, 0.1


# --- operators -------------------------------------------------------------------------------------------------------


def scope_level(session="session_id", agent="agent_id", turn="turn_id") -> Column:
    return F.when(F.col(turn).isNotNull(), "turn").when(F.col(agent).isNotNull(), "agent").when(F.col(session).isNotNull(), "session").otherwise("user")


@dataclass
class MemoryFilter:
    """What a query of memories asks for; an unset field asks for nothing."""

    user: int | None = None
    session: int | None = None
    agent: int | None = None
    turn: int | None = None
    levels: list[str] = field(default_factory=list)
    created_after: datetime | str | None = None
    created_before: datetime | str | None = None
    valid_at: datetime | str | None = None
    include_superseded: bool = False
    min_importance: float | None = None
    max_importance: float | None = None
    entities: list[str] = field(default_factory=list)
    has_supersedes: bool | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def condition(self, now: Column) -> Column:
        tests = [F.col("expires").isNull() | (F.col("expires") > now)]
        at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
        # A narrower scope counts only inside the wider ones that are set, but for the first.
        chain = [("user_id", self.user), ("session_id", self.session), ("agent_id", self.agent), ("turn_id", self.turn)]
        tests += [F.col(c) == v for c, v in chain if v is not None]
        if self.levels:
            tests.append(scope_level().isin(self.levels))
        if self.created_after is not None:
            tests.append(F.col("created") >= at(self.created_after))
        if self.created_before is not None:
            tests.append(F.col("created") <= at(self.created_before))
        if self.valid_at is not None:
            tests += [F.col("valid_from") <= at(self.valid_at), F.col("valid_until").isNull() | (F.col("valid_until") > at(self.valid_at))]
        if not self.include_superseded:
            tests.append(F.col("valid_until").isNull())
        if self.min_importance is not None:
            tests.append(F.col("importance") >= self.min_importance)
        if self.max_importance is not None:
            tests.append(F.col("importance") <= self.max_importance)
        if self.entities:
            tests.append(F.arrays_overlap("entities", F.array(*map(F.lit, self.entities))))
        if self.has_supersedes is not None:
            tests.append(F.col("supersedes").isNotNull() == self.has_supersedes)
        # Unsafe keys are left out, not refused.
        tests += [F.get_json_object("metadata", f"$.{k}") == v for k, v in self.metadata.items() if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k)]
        out = tests[0]
        for t in tests[1:]:
            out &= t
        return out


def page(rows: DataFrame, order: str = "created", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in the order of an allowed column; ties by id."""
    if order not in ("created", "importance", "access", "valid_from"):
        order = "created"
    return rows.orderBy(F.desc(order) if descending else F.asc(order), "id").offset(offset).limit(limit)


def supersede(rows: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Old rows that `new` supersedes are closed; new rows are open and know what they replace."""
    replaced = new.select(F.col("supersedes").alias("id"), F.col("id").alias("superseded_by"))
    closed = rows.join(replaced, "id", "left").withColumn("valid_until", F.when(F.col("superseded_by").isNotNull(), at).otherwise(F.col("valid_until")))
    opened = new.withColumns({"valid_from": at, "valid_until": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("long")})
    return closed.unionByName(opened.select(closed.columns))


def chains(rows: DataFrame, most: int = 32) -> DataFrame:
    """(id, first, steps) of every memory: the oldest version behind it, by doubling jumps along `supersedes`."""
    known = rows.select("id").distinct()
    jump = rows.select("id", F.col("supersedes").alias("to")).join(known.select(F.col("id").alias("to"), F.lit(True).alias("there")), "to", "left")
    jump = jump.select("id", F.when(F.col("there"), F.col("to")).alias("to"), F.col("there").isNotNull().cast("int").alias("steps"))
    jump = jump.select("id", F.coalesce("to", "id").alias("to"), "steps")
    size = 1
    while size < most:
        nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        jump = jump.join(nxt, "to").select("id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        size *= 2
    return jump.select("id", F.col("to").alias("first"), "steps")


def lifespan_days(importance: Column) -> Column:
    """Days until importance decays to LEAST; null if it is there already."""
    return F.when(importance > LEAST, -F.ln(F.lit(LEAST) / importance) / RATE)


def decayed(importance: Column, days: Column, access: Column, rate: float = 0.1) -> Column:
    boost = F.when(access > 0, F.least(F.lit(0.3), access * 0.05)).otherwise(0.0)
    value = importance * F.exp(-rate * days)
    return F.when(access > 0, F.least(F.lit(1.0), value + boost)).otherwise(value)


def pack_skipping(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, id) of the entries that a greedy packing by `place` takes: one that would overflow is skipped, not the end."""
    entries = F.array_sort(F.collect_list(F.struct("place", "id", "cost")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda acc, e: F.when(acc["used"] + e["cost"] <= budget, F.struct((acc["used"] + e["cost"]).alias("used"), F.concat(acc["ids"], F.array(e["id"])).alias("ids"))).otherwise(acc)
    packed = rows.groupBy(by).agg(entries.alias("e")).select(by, F.aggregate("e", zero, step).alias("p"))
    return packed.select(by, F.explode("p.ids").alias("id"))


def pack_stopping(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """Entries by `place` up to the first one that overflows the budget."""
    w = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("cost").over(w)).where(F.col("upto") <= budget).drop("upto")


# --- the memories of the test tables ---------------------------------------------------------------------------------


def memories(spark, sf_dir) -> DataFrame:
    """Orders as memories of 50 users."""
    i, day = F.col("o_orderkey"), lambda n: F.expr(f"interval {n} days")
    t = F.col("o_orderdate").cast("timestamp_ntz")
    nation = F.format_string("nation-%d", F.col("o_custkey") % 25)
    return read(spark, sf_dir, "orders").select(
        i.alias("id"), (F.col("o_custkey") % 50).alias("user_id"), F.when(i % 4 >= 1, F.col("o_custkey")).alias("session_id"), F.when(i % 4 >= 2, i % 7).alias("agent_id"), F.when(i % 4 == 3, i % 11).alias("turn_id"),
        t.alias("created"), t.alias("valid_from"), F.when(F.col("o_orderstatus") == "F", t + day(400)).alias("valid_until"), F.when(i % 10 == 0, t + day(100)).alias("expires"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("importance"), F.array("o_orderpriority", nation).alias("entities"), F.format_string('{"status": "%s"}', "o_orderstatus").alias("metadata"),
        F.when(i % 5 > 0, i - 1).alias("supersedes"), (i % 20).alias("access"), F.concat_ws(" ", "o_orderpriority", nation, F.lit("order"), (i % 100).cast("string")).alias("content"),
    )


_M = "m AS (SELECT o_orderkey AS id, o_custkey % 50 AS user_id, CASE WHEN o_orderkey % 4 >= 1 THEN o_custkey END AS session_id, CASE WHEN o_orderkey % 4 >= 2 THEN o_orderkey % 7 END AS agent_id, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey % 11 END AS turn_id, o_orderdate::TIMESTAMP AS created, o_orderdate::TIMESTAMP AS valid_from, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::TIMESTAMP + INTERVAL 400 DAY END AS valid_until, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 100 DAY END AS expires, least(1.0::DOUBLE, o_totalprice / 500000) AS importance, [o_orderpriority, 'nation-' || o_custkey % 25] AS entities, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey - 1 END AS supersedes, o_orderkey % 20 AS access, o_orderpriority || ' nation-' || o_custkey % 25 || ' order ' || o_orderkey % 100 AS content FROM orders)"
_ALIVE = f"(expires IS NULL OR expires > TIMESTAMP '{NOW}')"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {_M} SELECT id, importance::DOUBLE AS importance FROM m WHERE {_ALIVE} AND user_id = 7 AND valid_until IS NULL AND importance >= 0.2 AND importance <= 0.9 AND created >= TIMESTAMP '1995-01-01' AND created <= TIMESTAMP '1999-12-31' AND (list_contains(entities, '1-URGENT') OR list_contains(entities, 'nation-7')) AND status = 'O' AND supersedes IS NOT NULL")
def f1_f5_f6_memory_filter(spark, sf_dir):
    """One user's current memories by time, importance, entities, metadata and lineage; an unsafe key is left out."""
    asked = MemoryFilter(user=7, min_importance=0.2, max_importance=0.9, created_after="1995-01-01", created_before="1999-12-31", entities=["1-URGENT", "nation-7"], metadata={"status": "O", "x'] OR 1=1": "y"}, has_supersedes=True)
    return memories(spark, sf_dir).where(asked.condition(_now())).select("id", "importance")


@query(f"WITH {_M} SELECT CASE WHEN turn_id IS NOT NULL THEN 'turn' WHEN agent_id IS NOT NULL THEN 'agent' WHEN session_id IS NOT NULL THEN 'session' ELSE 'user' END AS level, count(*) AS n FROM m WHERE {_ALIVE} AND valid_until IS NULL AND ((session_id IS NULL AND agent_id IS NULL AND turn_id IS NULL) OR (agent_id IS NOT NULL AND turn_id IS NULL) OR turn_id IS NOT NULL) GROUP BY 1")
def f2_f3_scope_levels(spark, sf_dir):
    """Current memories of three scope levels."""
    rows = memories(spark, sf_dir).where(MemoryFilter(levels=["user", "agent", "turn"]).condition(_now()))
    return rows.groupBy(scope_level().alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_M} SELECT user_id, count(*) AS n, round(sum(importance), 4) AS importance FROM m WHERE {_ALIVE} AND valid_from <= TIMESTAMP '1997-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-06-01') GROUP BY 1")
def f4_as_of(spark, sf_dir):
    """Memories that were valid at a time, superseded ones included."""
    rows = memories(spark, sf_dir).where(MemoryFilter(valid_at="1997-06-01", include_superseded=True).condition(_now()))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 4).alias("importance"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09' AND event_type = 'view' AND user_id % 2 = 1")
def f7_metrics_filter(spark, sf_dir):
    """Metrics of a time range, a model and a mode, both ends included."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").where(F.col("ts").between(t("2024-01-05"), t("2024-01-09")) & (F.col("event_type") == "view") & (F.col("user_id") % 2 == 1)).select("event_id", "event_type")


@query(f"WITH {_M} SELECT id, round(importance, 6) AS importance FROM m WHERE {_ALIVE} AND valid_until IS NULL ORDER BY m.importance DESC, id LIMIT 20 OFFSET 40")
def m2_page(spark, sf_dir):
    """The third page of 20 current memories by importance."""
    rows = memories(spark, sf_dir).where(MemoryFilter().condition(_now()))
    return page(rows, "importance", True, 20, 40).select("id", F.round("importance", 6).alias("importance"))


@query(f"WITH {_M}, n AS (SELECT id + 1000000 AS id, id AS supersedes FROM m WHERE id % 50 = 3) SELECT m.id, n.id AS superseded_by, CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE valid_until END AS valid_until, m.supersedes FROM m LEFT JOIN n ON n.supersedes = m.id UNION ALL SELECT id, NULL, NULL, supersedes FROM n")
def m3_superseded(spark, sf_dir):
    """Every 50th memory replaced by a new version."""
    rows = memories(spark, sf_dir)
    new = rows.where("id % 50 = 3").withColumn("supersedes", F.col("id")).withColumn("id", F.col("id") + 1_000_000)
    return supersede(rows, new, _now()).select("id", "superseded_by", "valid_until", "supersedes")


@query(f"WITH RECURSIVE {_M}, c AS (SELECT id, id AS first, 0 AS steps FROM m UNION ALL SELECT c.id, p.id, steps + 1 FROM c JOIN m x ON x.id = c.first JOIN m p ON p.id = x.supersedes) SELECT id, arg_max(first, steps) AS first, max(steps)::INT AS steps FROM c GROUP BY 1")
def m4_history_chains(spark, sf_dir):
    """The oldest version behind each memory, and how many steps back it is."""
    return chains(memories(spark, sf_dir)).select("id", "first", F.col("steps").cast("int").alias("steps"))


@query(f"WITH {_M} SELECT id, id + 5000000 AS promoted, user_id, CASE WHEN turn_id IS NOT NULL THEN 'turn' WHEN agent_id IS NOT NULL THEN 'agent' ELSE 'session' END || '>user' AS chain FROM m WHERE importance >= 0.7 AND session_id IS NOT NULL AND valid_until IS NULL")
def m5_bubble_up(spark, sf_dir):
    """Important memories below the user's scope, copied to it."""
    rows = memories(spark, sf_dir).where((F.col("importance") >= 0.7) & (scope_level() != "user") & F.col("valid_until").isNull())
    return rows.select("id", (F.col("id") + 5_000_000).alias("promoted"), "user_id", F.concat(scope_level(), F.lit(">user")).alias("chain"))


@query(f"WITH {_M} SELECT id, CASE WHEN importance > {LEAST} THEN round(-ln({LEAST}::DOUBLE / importance) / {RATE!r}::DOUBLE, 4) END AS days FROM m")
def m6_lifespans(spark, sf_dir):
    """Days until each memory expires."""
    return memories(spark, sf_dir).select("id", F.round(lifespan_days(F.col("importance")), 4).alias("days"))


@query(f"WITH {_M}, d AS (SELECT *, CASE WHEN importance > {LEAST} THEN -ln({LEAST}::DOUBLE / importance) / {RATE!r}::DOUBLE ELSE 1 END AS days FROM m) SELECT id, CASE WHEN access >= 15 THEN 'reinforced' WHEN expires IS NULL THEN 'backfilled' ELSE 'kept' END AS action, round(CASE WHEN access >= 15 THEN days * 1.2 WHEN expires IS NULL THEN days ELSE date_diff('day', created, expires) END, 3)::DOUBLE AS lifespan FROM d WHERE {_ALIVE}")
def m7_reinforced(spark, sf_dir):
    """Expired memories go; often used ones live 1.2 times as long from now, those without an end get one."""
    days = F.coalesce(lifespan_days(F.col("importance")), F.lit(1.0))
    used = F.col("access") >= 15
    action = F.when(used, "reinforced").when(F.col("expires").isNull(), "backfilled").otherwise("kept")
    span = F.when(used, days * 1.2).when(F.col("expires").isNull(), days).otherwise(F.datediff("expires", "created"))
    return memories(spark, sf_dir).where(F.col("expires").isNull() | (F.col("expires") > _now())).select("id", action.alias("action"), F.round(span, 3).alias("lifespan"))


_AGE = f"date_diff('day', created, TIMESTAMP '{NOW}')"


@query(f"WITH {_M}, s AS (SELECT user_id, id, importance * CASE WHEN {_AGE} < 0 THEN 1 ELSE exp(-{_AGE} / 30.0::DOUBLE) END AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT user_id, id, rank FROM r WHERE rank <= 10")
def m8_recency_rank(spark, sf_dir):
    """The ten best memories of each user by importance and recency; a future age counts as none."""
    age = F.datediff(_now(), "created")
    score = F.col("importance") * F.when(age < 0, 1.0).otherwise(F.exp(-age / 30.0))
    rows = memories(spark, sf_dir).select("user_id", "id", F.round(score, 9).alias("score"))
    return top(rows, 10, "user_id", "id").select("user_id", "id", "rank")


@query(f"WITH {_M}, s AS (SELECT user_id, id, importance AS score, ceil(length(content) / 4.0::DOUBLE)::BIGINT AS cost FROM m WHERE importance >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS place FROM s), t AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY place) AS upto FROM r WHERE place <= 10) SELECT user_id, id, place FROM t WHERE upto <= 60")
def m9_injection(spark, sf_dir):
    """Memories to inject: a score of .3 or more, ten at most, within a token budget."""
    rows = memories(spark, sf_dir).where("importance >= 0.3").select("user_id", "id", F.col("importance").alias("score"), F.ceil(F.length("content") / 4.0).alias("cost"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "id")).cast("long")).where("place <= 10")
    return pack_stopping(ranked, "user_id", 60).select("user_id", "id", "place")


_DECAY = f"CASE WHEN access > 0 THEN least(1.0::DOUBLE, importance * exp(-0.001::DOUBLE * {_AGE}) + least(0.3::DOUBLE, access * 0.05::DOUBLE)) ELSE importance * exp(-0.001::DOUBLE * {_AGE}) END"


@query(f"WITH {_M}, s AS (SELECT user_id, id, round({_DECAY}, 9) AS score, (length(content) // 4 + 10 + (id % 9) * 40)::BIGINT AS cost FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.15), f AS (SELECT user_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'ids': []::BIGINT[]}}, list({{'used': cost, 'ids': [id]}} ORDER BY place)), lambda a, b: CASE WHEN a.used + b.used <= 1500 THEN {{'used': a.used + b.used, 'ids': list_concat(a.ids, b.ids)}} ELSE a END) AS p FROM r GROUP BY 1) SELECT user_id, unnest(p.ids) AS id FROM f")
def m10_budget_packing(spark, sf_dir):
    """Each user's memories packed into 1,500 tokens by decayed importance, skipping what does not fit."""
    rows = memories(spark, sf_dir)
    score = F.round(decayed(F.col("importance"), F.datediff(_now(), "created"), F.col("access"), 0.001), 9)
    cost = (F.floor(F.length("content") / 4) + 10 + (F.col("id") % 9) * 40).cast("long")
    ranked = rows.select("user_id", "id", score.alias("score"), cost.alias("cost")).where("score >= 0.15")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "id")))
    return pack_skipping(ranked, "user_id", 1500)


@query(f"WITH {_M}, s AS (SELECT user_id, id, (contains(lower(content), 'urgent')::INT + contains(lower(content), 'order')::INT + 2 * list_contains(entities, 'nation-3')::INT) * (access / 2.0::DOUBLE) / 10 + 0.5::DOUBLE * greatest(0, 1 - (id % 9000) / 7200.0::DOUBLE) AS score, (length(content) // 4)::BIGINT AS cost FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS place FROM s), t AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY place) AS upto FROM r) SELECT user_id, id, round(score, 6) AS score FROM t WHERE upto <= 100")
def m14_agent_retrieval(spark, sf_dir):
    """Memories for two words and a tag: hits by priority, and freshness, up to the first that overflows the budget."""
    low = F.lower("content")
    hits = low.contains("urgent").cast("int") + low.contains("order").cast("int") + 2 * F.array_contains("entities", "nation-3").cast("int")
    score = hits * (F.col("access") / 2.0) / 10 + 0.5 * F.greatest(F.lit(0.0), 1 - (F.col("id") % 9000) / 7200.0)
    rows = memories(spark, sf_dir).select("user_id", "id", score.alias("score"), F.floor(F.length("content") / 4).alias("cost"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return pack_stopping(ranked, "user_id", 100).select("user_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_M}, s AS (SELECT user_id, id, round(0.5::DOUBLE * (id % 11) / 10 + 0.3::DOUBLE * greatest(0, 1 - (id % 5000) / 3600.0::DOUBLE) + 0.2::DOUBLE * least(1, access / 10.0::DOUBLE), 6) AS retention FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retention, id) AS r FROM s) SELECT user_id, id, retention FROM r WHERE r <= 3")
def m15_sc3_eviction(spark, sf_dir):
    """The three memories of each user to evict first: the least retention score."""
    score = 0.5 * (F.col("id") % 11) / 10 + 0.3 * F.greatest(F.lit(0.0), 1 - (F.col("id") % 5000) / 3600.0) + 0.2 * F.least(F.lit(1.0), F.col("access") / 10.0)
    rows = memories(spark, sf_dir).select("user_id", "id", F.round(score, 6).alias("retention"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("retention", "id"))).where("r <= 3").drop("r")


def eviction_order(rows: DataFrame, policy: str, scope: str) -> DataFrame:
    """Adds `turn`: 1 goes first. lru: last used, lfu: least used, fifo: oldest, ttl: expires first."""
    key = {"lru": ["used"], "lfu": ["access", "used"], "fifo": ["created"], "ttl": [F.asc_nulls_last("expires")]}[policy]
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(scope).orderBy(*key, "id")).cast("long"))


@query(f"WITH {_M}, u AS (SELECT *, created + access * INTERVAL 1 DAY AS used FROM m), o AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY used, id) AS lru, row_number() OVER (PARTITION BY user_id ORDER BY access, used, id) AS lfu, row_number() OVER (PARTITION BY user_id ORDER BY created, id) AS fifo, row_number() OVER (PARTITION BY user_id ORDER BY expires NULLS LAST, id) AS ttl FROM u) SELECT * FROM o WHERE least(lru, lfu, fifo, ttl) <= 2")
def sc3_eviction_orders(spark, sf_dir):
    """Which memories each of four policies evicts first."""
    rows = memories(spark, sf_dir).withColumn("used", F.col("created") + F.make_dt_interval(F.col("access").cast("int")))
    out = rows
    for p in ("lru", "lfu", "fifo", "ttl"):
        out = eviction_order(out, p, "user_id").withColumnRenamed("turn", p)
    return out.where("least(lru, lfu, fifo, ttl) <= 2").select("user_id", "id", "lru", "lfu", "fifo", "ttl")


@query("WITH e AS (SELECT l_partkey AS key, l_orderkey AS at, l_suppkey AS agent, l_discount AS confidence, l_returnflag AS text, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem), a AS (SELECT key, arg_max(k, k) AS last_write, arg_max(k, (confidence, k)) AS confidence, arg_min(k, (agent, -k)) AS agent, string_agg(DISTINCT text, '+' ORDER BY text) AS merged, count(*) AS n FROM e GROUP BY 1) SELECT key AS l_partkey, last_write, confidence, agent, merged, n AS kept_both FROM a")
def sc2_conflicts(spark, sf_dir):
    """What five strategies make of conflicting values: the last, the surest, the first agent's, the merged text, all."""
    k = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")).cast("long")
    rows = read(spark, sf_dir, "lineitem").withColumn("k", k)
    return rows.groupBy("l_partkey").agg(
        F.max("k").alias("last_write"), F.max_by("k", F.struct("l_discount", "k")).alias("confidence"), F.min_by("k", F.struct("l_suppkey", -F.col("k"))).alias("agent"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("merged"), F.count(F.lit(1)).alias("kept_both"),
    )


@query(f"WITH {_M}, p AS (SELECT user_id AS key, id, created, expires, content FROM m WHERE id % 3 > 0), l AS (SELECT *, row_number() OVER (PARTITION BY key, content ORDER BY created DESC, id DESC) AS r FROM p), d AS (SELECT DISTINCT user_id AS key, content FROM m WHERE id % 30 = 0) SELECT key AS user_id, l.id FROM l LEFT JOIN d USING (key, content) WHERE r = 1 AND d.content IS NULL AND {_ALIVE} AND contains(content, 'nation-7')")
def sc1_shared_context(spark, sf_dir):
    """A shared store after puts (latest wins), deletes and expiry, searched for a word."""
    rows = memories(spark, sf_dir)
    puts = rows.where("id % 3 > 0").withColumn("r", F.row_number().over(Window.partitionBy("user_id", "content").orderBy(F.desc("created"), F.desc("id")))).where("r = 1")
    alive = puts.join(rows.where("id % 30 = 0").select("user_id", "content").distinct(), ["user_id", "content"], "left_anti")
    return alive.where((F.col("expires").isNull() | (F.col("expires") > _now())) & F.col("content").contains("nation-7")).select("user_id", "id")


@query(f"WITH {_M}, a AS (SELECT id, user_id, CASE id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'get' ELSE 'delete' END AS action, created, row_number() OVER (ORDER BY created DESC, id DESC) AS r FROM m) SELECT id, user_id, created FROM a WHERE r <= 5000 AND action = 'put' AND user_id < 10")
def sc4_audit_log(spark, sf_dir):
    """Audit entries of some users and one action, among the latest 5,000."""
    i = F.col("id")
    rows = memories(spark, sf_dir).withColumn("action", F.when(i % 3 == 0, "put").when(i % 3 == 1, "get").otherwise("delete"))
    latest = rows.orderBy(F.desc("created"), F.desc("id")).limit(5000)
    return latest.where("action = 'put' and user_id < 10").select("id", "user_id", "created")


@query(f"WITH {_M}, c AS (SELECT user_id, content, id, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id DESC) AS recent FROM m WHERE {_ALIVE}) SELECT user_id, id FROM c WHERE recent <= 8")
def m11_cache(spark, sf_dir):
    """What a cache of eight entries for each user holds after all writes: the latest that have not expired."""
    rows = memories(spark, sf_dir).where(F.col("expires").isNull() | (F.col("expires") > _now()))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created"), F.desc("id")))).where("r <= 8").select("user_id", "id")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'header-' || conv_id WHEN conv_id % 3 = 1 THEN 'repo' || conv_id ELSE 'default' END AS project FROM (SELECT DISTINCT conv_id FROM conversations)")
def m13_project_scope(spark, sf_dir):
    """The project of a conversation: its header, else the last part of its folder, else a default."""
    c = F.col("conv_id")
    header, folder = F.when(c % 3 == 0, F.format_string("header-%d", c)).otherwise(""), F.when(c % 3 == 1, F.format_string("/home/me/repo%d", c)).otherwise("")
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumns({"header": header, "folder": folder})
    return rows.select("conv_id", F.coalesce(F.nullif("header", F.lit("")), F.nullif(F.element_at(F.split("folder", "/"), -1), F.lit("")), F.lit("default")).alias("project"))


@query("WITH s AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND b.vec_id % 3 <> 1), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc AS memory_id, rank, score FROM r WHERE rank <= 5 AND score >= 0.0")
def m1_semantic_search(spark, sf_dir):
    """The five current memories nearest to each query vector."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    found = nearest(rows.where("doc % 3 <> 1"), rows.where("doc % 100 = 0").select(F.col("doc").alias("query"), "v"), 5, 0.0)
    return found.select("query", F.col("doc").alias("memory_id"), "rank", "score")


def near_keys(rows: DataFrame, by: str, key: str, asked: Column, k: int) -> DataFrame:
    """(key, other) of the rows `asked`: the k keys before and the k after it among those of its group, in order of key.

    The k rows nearest to a key are among them. Rows of one key are counted and given as often as they occur, up to k
    times; they are no neighbours of each other.
    """
    counted = rows.groupBy(by, key).agg(F.count(F.lit(1)).alias("c"))
    around = F.collect_list(F.struct(F.col(key).alias("other"), F.col("c").alias("n"))).over(Window.partitionBy(by).orderBy(key).rowsBetween(-k, k))
    pairs = counted.withColumn("o", around).where(asked).select(key, "c", F.explode("o").alias("o")).where(F.col("o.other") != F.col(key))
    return pairs.select(key, "o.other", F.explode(F.sequence(F.lit(1), F.least(F.col("c") * F.col("o.n"), F.lit(k)))).alias("_")).drop("_")


_M17 = "v AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM v) WHERE r <= 15)"


@query(f"WITH {_M17}, t AS (SELECT a.vec_id AS query, b.vec_id AS doc, 1.0 / (1 + abs(a.vec_id - b.vec_id))::DOUBLE AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), tr AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM t) WHERE r <= 15), f AS (SELECT query, doc, round(0.7::DOUBLE * coalesce(vr.score, 0) + 0.3::DOUBLE * coalesce(tr.score / best, 0), 6) AS score FROM vr FULL JOIN tr USING (query, doc)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) SELECT query, doc, score, rank FROM r WHERE rank <= 5")
def m17_hybrid_memory_search(spark, sf_dir):
    """Vectors and text fused: three times as many from each, text scores by their best, the five best of all."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")
    asked = rows.where("doc % 100 = 0").select(F.col("doc").alias("query"), "v")
    vectors = nearest(rows.select("doc", "v"), asked, 15).select("query", "doc", F.col("score").alias("vs"))
    text = near_keys(rows.where("label is not null"), "label", "doc", F.col("doc") % 100 == 0, 15).select(F.col("doc").alias("query"), F.col("other").alias("doc"), (1.0 / (1 + F.abs(F.col("other") - F.col("doc")))).alias("score"))
    text = top(text, 15).withColumn("ts", F.col("score") / F.max("score").over(Window.partitionBy("query"))).select("query", "doc", "ts")
    fused = vectors.join(text, ["query", "doc"], "full").select("query", "doc", millionths(0.7 * F.coalesce("vs", F.lit(0.0)) + 0.3 * F.coalesce("ts", F.lit(0.0))).alias("score"))
    return top(fused, 5)


@query("WITH t AS (SELECT conv_id, turn, text, (length(text) // 4)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations), u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM t) SELECT conv_id, count(*) FILTER (upto <= 400) AS kept, count(*) FILTER (upto > 400) AS summarized, CASE WHEN count(*) FILTER (upto > 400) > 0 THEN '[' || count(*) FILTER (upto > 400) || ' earlier messages]' END AS summary FROM u GROUP BY 1")
def m18_history_budget(spark, sf_dir):
    """The newest messages within half of a budget of 800 tokens; older ones become one summary row."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.floor(F.length("text") / 4).alias("cost"), F.sum(F.floor(F.length("text") / 4)).over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("upto"))
    old = F.count_if(F.col("upto") > 400)
    return rows.groupBy("conv_id").agg(F.count_if(F.col("upto") <= 400).alias("kept"), old.alias("summarized"), F.when(old > 0, F.format_string("[%d earlier messages]", old)).alias("summary"))


@query("WITH c AS (SELECT event_id, event_type AS tool, props AS input, ts, sha256(event_type || '|' || props) AS key FROM events), l AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM c) SELECT event_id, coalesce(ts - before <= INTERVAL 1 DAY, false) AS hit FROM l")
def m19_tool_cache(spark, sf_dir):
    """Whether a tool call finds the result of an equal call of the last day."""
    rows = read(spark, sf_dir, "events").withColumn("key", F.sha2(F.concat_ws("|", "event_type", "props"), 256))
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return rows.select("event_id", F.coalesce(F.col("ts") - before <= F.expr("interval 1 day"), F.lit(False)).alias("hit"))


@query("SELECT conv_id + 100000 AS conv_id, turn, role, 'fork of ' || conv_id AS origin FROM conversations WHERE turn <= 2 AND conv_id % 10 = 0 UNION ALL SELECT conv_id, turn, role, NULL FROM conversations")
def m20_forks(spark, sf_dir):
    """Sessions, and forks of some of them from their third turn."""
    chat = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chat.where("turn <= 2 and conv_id % 10 = 0").select((F.col("conv_id") + 100_000).alias("conv_id"), "turn", "role", F.format_string("fork of %d", "conv_id").alias("origin")).unionByName(chat.withColumn("origin", F.lit(None).cast("string")))


_T2 = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[a-z0-9_]+'))"


@query(f"WITH w AS (SELECT doc_id, unnest({_T2}) AS w FROM documents WHERE doc_id % 3 > 0), i AS (SELECT item_id, unnest({_T2}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), c AS (SELECT item_id, doc_id, count(*) AS c FROM i JOIN w USING (w) GROUP BY ALL), r AS (SELECT item_id, max(c / n) AS share FROM c JOIN n USING (item_id) GROUP BY 1) SELECT item_id, round(coalesce(share, 0), 6) AS share, coalesce(share >= 0.8, false) AS duplicate FROM n LEFT JOIN r USING (item_id)")
def dd12_import_duplicates(spark, sf_dir):
    """Items to import that a stored text covers to four fifths of their words."""
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    stored, items = words(read(spark, sf_dir, "documents").where("doc_id % 3 > 0"), "doc_id"), words(read(spark, sf_dir, "benchmark"), "item_id")
    n = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    best = items.join(stored, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("item_id").agg(F.max("c").alias("c"))
    share = F.coalesce(F.col("c") / F.col("n"), F.lit(0.0))
    return n.join(best, "item_id", "left").select("item_id", F.round(share, 6).alias("share"), (share >= 0.8).alias("duplicate"))


QUERIES, ORACLES = query.queries, query.oracles
