"""The registered queries of the engine's relational operators, with DuckDB SQL for the same tables where it can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import agents, arrays, conversations, crusher, dedup, graphs, joins, lines, memories, memory, predicates, profile, quality, relevance, requests, rollups, search, text
from marlstone.plans import transforms
from marlstone.sources import parsers
from marlstone.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (rollups, profile, conversations, relevance, memory, text, arrays, joins, crusher, lines, predicates, search, requests, memories, dedup, graphs, quality, parsers, windows, transforms, agents):
    if QUERIES.keys() & module.QUERIES.keys():
        raise ValueError(f"{module.__name__} repeats the name of a query")
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
