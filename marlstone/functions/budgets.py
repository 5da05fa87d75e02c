"""Scalar functions over sizes: context zones, budgets, precision risks, and the gain of a change to a cached prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Shares of a smart zone by phase of a task.
PHASES = {"system": 0.10, "plan": 0.20, "work": 0.25, "review": 0.10, "reserve": 0.35}


def smart_zone(window: Column, quality: float, task: Column, model: Column) -> Column:
    """Tokens of a context window that are used well, from factors of quality, task and model."""
    return F.floor(window * quality * task * model).cast("long")


def pressure(used: Column, zone: Column) -> Column:
    """How hard to compress by the share of the zone in use: light, medium, heavy, critical."""
    share = F.try_divide(used, zone)
    return F.when(share < 0.75, "light").when(share < 0.85, "medium").when(share < 1, "heavy").otherwise("critical")


def net_gain(delta: Column, suffix: Column, reads: Column, alive: Column, write: float = 1.25, read: float = 0.1) -> Column:
    """What a change that saves `delta` tokens gains over its expected reads, less what rewriting the cached suffix costs.

    Not a number and null count as a change that must not be made.
    """
    gain = delta * (F.lit(write) + F.lit(read) * (reads - 1)) - alive * F.lit(write - read) * (suffix + delta)
    return F.when(gain.isNull() | F.isnan(gain), F.lit(float("-inf"))).otherwise(gain)


def break_even_reads(delta: Column, suffix: Column, write: float = 1.25, read: float = 0.1) -> Column:
    return F.when(delta > 0, F.lit((write - read) / read) * suffix / delta)


def precision_multiplier(precision: Column, tokens: Column, safe: int = 32_000, critical: int = 128_000) -> Column:
    """How much harder to compress at a lower precision of the key-value cache, more so in long contexts."""
    grade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tokens - safe) / float(critical - safe)))
    most = F.when(precision == "fp16", 1.0).when(precision == "int8", 1.3).when(precision == "int4", 1.8).otherwise(1.0)
    return 1 + (most - 1) * grade


def precision_risk(precision: Column, tokens: Column, safe: int = 32_000, critical: int = 128_000) -> Column:
    low = precision.isin("int8", "int4")
    return F.when(~low | (tokens <= safe), "safe").when(tokens < critical, "elevated").otherwise("critical")


def zone(used: Column, reliable: Column) -> Column:
    share = F.try_divide(used, reliable)
    return F.when(share < 0.5, "green").when(share < 0.75, "yellow").when(share < 0.9, "orange").otherwise("red")


def frozen_prefix(marks: Column) -> Column:
    """How many messages are frozen: up to the last one with a cache mark; 0 if none. marks: array of booleans."""
    return F.coalesce(F.array_max(F.transform(marks, lambda m, i: F.when(m, i + 1).otherwise(0))), F.lit(0))
