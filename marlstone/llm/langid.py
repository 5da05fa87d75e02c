"""Language identification by rank-order profiles.

A profile is the `top` most frequent 1- to 3-grams of letters (words padded by blanks, lower case), ranked by count.
A text belongs to the language whose profile has the smallest out-of-place distance from the text's own.

Profiles are fitted on at most `fit_rows` labelled rows, the first by a hash of doc_id. Null texts and texts without a
letter are `und` with score 0. Rows with null lang are never learned from. With no labelled rows all are `und`. Ties go
to the language that sorts first. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm import common

FIT_ROWS, TOP = 20_000, 400


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, counts) of a whole text; empty when it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate([[32], points, [32]])
    points = points[~((points == 32) & (np.roll(points, 1) == 32) & (np.arange(len(points)) > 0))]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (points[:-1] << 21) | points[1:]
    codes = np.concatenate([points[points != 32], two, (two[:-1] << 21) | points[2:]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:top]]


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from the text and lang of labelled rows: at most `top` codes for each language reach the driver."""
    rows = rows.where("lang is not null and text is not null")
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).distinct()

    def count(batches):
        for batch in batches:
            for cut in common.slices(batch, "text"):
                for lang, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                    codes, counts = grams(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counted = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), 1, top).alias("best"))
    return {r.lang: np.array([b.code for b in r.best], np.int64) for r in best.orderBy("lang").collect()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """All columns of docs and lang_pred, score. score: how far the distance is below its maximum, as a share."""
    names = sorted(profiles)
    tables = []
    for n in names:
        order = np.argsort(profiles[n])
        tables.append((profiles[n][order], order))

    def guess(text: str | None) -> tuple[str, float]:
        codes, counts = grams(text) if text else ((), ())
        if not len(codes) or not names:
            return "und", 0.0
        own = ranked(codes, counts, top)
        place = np.arange(len(own))
        sums = []
        for known, rank in tables:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            sums.append(int(np.where(known[at] == own, np.abs(rank[at] - place), top).sum()))
        best = int(np.argmin(sums))
        return names[best], 1.0 - sums[best] / (top * len(own))

    def run(batches):
        for batch in batches:
            got = [guess(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.drop("lang_pred", "score").schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.drop("lang_pred", "score").mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
