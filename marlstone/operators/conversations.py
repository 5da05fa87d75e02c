"""Message lists: turn windows, role breakdowns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from marlstone.sources.tables import read


def role_breakdown(spark, sf_dir):
    """Messages and characters by role."""
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def turn_budget(spark, sf_dir):
    """The newest turns of a conversation that fit a budget of 2000 characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used")).where("used <= 2000")


_FUNCTIONS = (role_breakdown, turn_budget)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "role_breakdown": "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
    "turn_budget": "SELECT * FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM conversations) WHERE used <= 2000",
}
