"""Benchmark decontamination with one FM-index for each shard of documents.

Words of a shard become numbers (vocabulary of the benchmark; all others separate). Runs of words whose neighbours
never stand together in the benchmark cannot hold a window and are left out, without loss. The rest is indexed:
suffix order by prefix doubling, its last column in a wavelet tree, and sampled suffix positions. All windows are
searched backward at once, their occurrences located, and the spans merged.

The benchmark is taken in blocks of rows of bounded size, so that the patterns fit in a worker; with more than one, the
passes over a document row are merged by a stored row number, never by doc_id. Null or wordless items
have no windows; null or wordless documents have no hits. Equal item_ids count once; a null item_id counts as ''.
Repeated documents each get a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from marlstone.llm import common

WINDOW = 13
#: Bytes of benchmark text whose windows are searched in one pass over the documents.
BLOCK_BYTES = 32 << 20
_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


class Wavelet:
    """Rank over an integer sequence."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            ones = (values >> b) & 1
            self.levels.append((np.concatenate([[0], np.cumsum(ones)]), int(len(ones) - ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position at."""
        low, high = np.zeros_like(at), at
        for depth, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        """seq ends in symbol 0, which also separates its parts. Inside, symbols move up by 1 and the end alone is 0."""
        n, symbols = len(seq), symbols + 1
        seq = seq.astype(np.int64) + 1
        seq[-1] = 0
        rank = seq
        step = 1
        while True:
            key = rank * (n + symbols + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = new
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.sa_rows = order % sample == 0
        self.sa_values = order[self.sa_rows]
        self.sa_rank = np.concatenate([[0], np.cumsum(self.sa_rows)])
        self.bwt = seq[order - 1]
        self.tree = Wavelet(self.bwt, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns (one in each row), by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j] + 1
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            r = rows[todo]
            done = self.sa_rows[r]
            out[todo[done]] = self.sa_values[self.sa_rank[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            c = self.bwt[r]
            rows[todo] = self.first[c] + self.tree.rank(c, r)
            steps[todo] += 1
        return out


class Patterns:
    """The windows of a block of benchmark rows, as word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        pairs: set[int] = set()
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            pairs.update((a << 32) | b for a, b in zip(w, w[1:]))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(number[name])
        self.pairs = np.array(sorted(pairs), np.int64)
        by_length: dict[int, list] = {}
        for p, owners in found.items():
            by_length.setdefault(len(p), []).append((p, sorted(owners)))
        self.groups = [(n, np.array([p for p, _ in g], np.int64), [o for _, o in g]) for n, g in sorted(by_length.items())]
        self.shortest = self.groups[0][0] if self.groups else 0

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each document of a shard: word count, merged hit spans (in words), numbers of the items found."""
        get, seqs, sizes = self.vocabulary.get, [], []
        for t in texts:
            w = words(t)
            sizes.append(len(w))
            seqs.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            seqs.append(np.zeros(1, np.int64))
        out: list = [(n, [], []) for n in sizes]
        if not self.groups or not texts:
            return out
        seq = np.concatenate(seqs)
        joined = (seq[:-1] << 32) | seq[1:]
        at = np.minimum(np.searchsorted(self.pairs, joined), max(len(self.pairs) - 1, 0))
        linked = (seq[:-1] > 0) & (seq[1:] > 0) & ((self.pairs[at] == joined) if len(self.pairs) else False)
        starts = np.flatnonzero(np.concatenate([[True], ~linked]))
        ends = np.concatenate([starts[1:], [len(seq)]])
        keep = (ends - starts >= self.shortest) & (seq[starts] > 0)
        starts, lengths = starts[keep], (ends - starts)[keep]
        if not len(starts):
            return out
        where = common.ranges(starts, lengths + 1)
        text = seq[np.minimum(where, len(seq) - 1)]
        last = np.cumsum(lengths + 1) - 1
        text[last] = 0
        index = FMIndex(text, len(self.vocabulary))
        bounds = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        for length, patterns, owners in self.groups:
            low, high = index.search(patterns)
            hit = np.flatnonzero(high > low)
            counts = (high - low)[hit]
            place = where[index.locate(common.ranges(low[hit], counts))]
            doc = np.searchsorted(bounds, place, "right") - 1
            for d, p, k in zip(doc.tolist(), (place - bounds[doc]).tolist(), np.repeat(hit, counts).tolist()):
                spans[d].append((p, p + length))
                items[d].update(owners[k])
        for d, got in enumerate(spans):
            if got:
                merged: list[tuple[int, int]] = []
                for a, b in sorted(got):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
                out[d] = (sizes[d], merged, sorted(items[d]))
        return out


_SPANS = "n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], shard_bytes: int) -> DataFrame:
    """All columns of docs but text, then n_words, spans, items."""

    def run(batches):
        patterns = Patterns(items)
        for batch in batches:
            for cut in common.slices(batch, "text", shard_bytes):
                got = patterns.scan(cut.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[cut.column(c) for c in others],
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array([[patterns.names[i] for i in g[2]] for g in got], pa.list_(pa.string())),
                    ],
                    [*others, "n_words", "spans", "items"],
                )

    others = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(run, StructType([*docs.drop("text").schema, *StructType.fromDDL(_SPANS)]))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in lists of (item_id, text) of bounded size, read one partition at a time."""
    part, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        part.append((r.i, r.text))
        held += len(r.text or "")
        if held >= block_bytes:
            yield part
            part, held = [], 0
    yield part


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = 4 << 20, row: Column | None = None) -> DataFrame:
    """doc_id, n_words, merged spans (in words), sorted item names, for every row; and `row`, where given, beside them."""
    parts = list(blocks(benchmark, block_bytes))
    own = [F.col("doc_id").cast("long").alias("doc_id"), *([] if row is None else [row.alias("row")])]
    if len(parts) == 1:
        return _pass(docs.select(*own, "text"), parts[0], shard_bytes)
    numbered = common.stored(docs.select(*own, "text", F.monotonically_increasing_id().alias("number")), "numbered")
    passes = [_pass(numbered.select("number", "text"), b, shard_bytes) for b in parts]
    both = passes[0]
    for p in passes[1:]:
        both = both.unionByName(p)
    grouped = both.groupBy("number").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merge = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(x)))
    empty = F.expr("cast(array() as array<struct<a:long,b:long>>)")
    merged = grouped.select("number", "n_words", F.aggregate("s", empty, merge).alias("spans"), "items")
    return numbered.drop("text").join(merged, "number").drop("number")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"])
    row = ["row"] if "row" in found.columns else []
    return found.select(*row, "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


