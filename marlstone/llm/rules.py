"""Text features and a learned decision list, with built-in functions only.

features() computes whole-text statistics. learn() counts labelled rows in cells (features, fold) with one aggregation,
then grows conjunctions of thresholds by sequential covering on the growing fold and prunes each on the other. Every
middle between neighbouring values of a feature is a candidate threshold, however rare the bad rows are. The list
becomes one ordered conditional expression. Labelled rows are bounded by `fit_rows`, taken in the order
of a hash of doc_id.

Null and wordless texts have all counts 0. Null labels and null doc_ids are not learned from; without both label values
the list is empty and keeps everything. Copies are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = ("n_words", "word_len", "symbol_share", "dup_line_share", "repeat_share")
_BLANK = r"[\x20\x09-\x0D]+"
FIT_ROWS = 50_000


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def from_words(w):
        n = F.size(w) - 2
        windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
        return F.when(n < 2, F.lit(0)).otherwise(_let(F.array_sort(windows), from_sorted))

    def from_sorted(s):
        def same(x, k):
            return F.when((k < 0) | (k >= F.size(s)), F.lit(False)).otherwise(F.get(s, k)["s"] == x["s"])

        marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        hits = F.array_compact(marked)
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))

    return _let(words, from_words)


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _BLANK), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, _BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumn("base_failed", failed).withColumns(
        {
            "word_len": per("word_chars", "n_words"),
            "symbol_share": per("n_symbols", "word_chars"),
            "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
        }
    )


#: (feature, True for "at least" or False for "below", threshold)
Condition = tuple[str, bool, float]


def _meets(values: np.ndarray, conditions: list[Condition]) -> np.ndarray:
    out = np.ones(len(values), bool)
    for f, up, threshold in conditions:
        x = values[:, FEATURES.index(f)]
        out &= (x >= threshold) if up else (x < threshold)
    return out


def _best(values: np.ndarray, bad: np.ndarray, good: np.ndarray, min_cover: int) -> Condition | None:
    """The condition of most gain (FOIL) among all thresholds between distinct values of a feature."""
    all_bad, all_good = int(bad.sum()), int(good.sum())
    base, best, found = math.log2(all_bad / (all_bad + all_good)), 1e-9, None
    for i, f in enumerate(FEATURES):
        order = np.argsort(values[:, i], kind="stable")
        x = values[order, i]
        cuts = np.flatnonzero(np.diff(x)) + 1
        if not len(cuts):
            continue
        b_low, g_low = np.cumsum(bad[order])[cuts - 1], np.cumsum(good[order])[cuts - 1]
        for up, b, g in ((True, all_bad - b_low, all_good - g_low), (False, b_low, g_low)):
            gain = np.where(b >= min_cover, b * (np.log2(np.maximum(b, 1) / np.maximum(b + g, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                low, high = float(x[cuts[k] - 1]), float(x[cuts[k]])
                middle = (low + high) / 2
                best, found = float(gain[k]), (f, up, middle if low < middle < high else high)
    return found


def learn(feats: DataFrame, labels: DataFrame, min_cover: int = 5, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.8, fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Conjunctions that tell bad rows (quality 0), in order."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = feats.where(~F.col("base_failed")).select("doc_id", *FEATURES).join(F.broadcast(marks), "doc_id")
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("prune")
    counted = rows.select(*FEATURES, fold, "quality").groupBy(*FEATURES, "prune").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good"))
    # At most a cell for each labelled document.
    cells = np.array([tuple(r) for r in counted.orderBy(*FEATURES, "prune").collect()], float).reshape(-1, len(FEATURES) + 3)
    values, prune, bad, good = cells[:, : len(FEATURES)], cells[:, -3] == 1, cells[:, -2].astype(np.int64), cells[:, -1].astype(np.int64)

    def count(rule, rows):
        hit = _meets(values, rule) & rows
        return int(bad[hit].sum()), int(good[hit].sum())

    def worth(rule):
        b, g = count(rule, prune)
        return (b - g) / (b + g) if b + g else -1.0

    found: list[list[Condition]] = []
    while len(found) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            hit = _meets(values, rule) & ~prune
            if not good[hit].sum() or bad[hit].sum() < min_cover:
                break
            condition = _best(values[hit], bad[hit], good[hit], min_cover)
            if condition is None:
                break
            rule.append(condition)
        if rule:
            rule = rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(rule[:n]), -n))]
        b, g = count(rule, np.ones(len(values), bool))
        if not rule or b < min_cover or b < min_precision * (b + g):
            break
        found.append(rule)
        left = ~_meets(values, rule)
        values, prune, bad, good = values[left], prune[left], bad[left], good[left]
    return found


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule rejects: CASE WHEN rule 1 THEN false WHEN ... ELSE true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for f, up, threshold in rule:
            test &= (F.col(f) >= threshold) if up else (F.col(f) < threshold)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(feats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    return feats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(verdict(rules)).alias("kept"),
    )
