"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within 2 bits agree on one of three blocks of bits, so distinct fingerprints are dealt by each block. In a
bucket they are sorted by Gray rank; each node above them keeps the bits that its members share (mask and pattern).
Two nodes whose shared bits already differ in more than 2 places are dropped with everything below them, and so are
nodes that lie whole in one component. A bucket emits a spanning forest of its links, not its pairs, and components are
joined by alternating large- and small-star steps over stored tables.

Null, empty and wordless texts have fingerprint zero. Copies share a fingerprint and cost one node. Null doc_ids take
the component of their fingerprint and never name one unless alone. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import common

SHIFTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS, FAN = 2, 8


def fingerprint(text: str | None, width: int = 3) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - width + 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(width, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return vote(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n))


def vote(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (64 bits in a long) for every row; width: words in a shingle."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a code word in reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


class GrayIndex:
    """Distinct fingerprints of one bucket, searched against themselves."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps))]
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(self.fps, full)]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            cuts = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern & mask, cuts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cuts)
            self.levels.append((ones, ones | zeros))
        self.root = np.arange(len(fps))

    def _find(self, a: int) -> int:
        root = self.root
        while root[a] != a:
            root[a] = root[root[a]]
            a = int(root[a])
        return a

    def _whole(self, level: int) -> np.ndarray:
        """The component that holds all members of a node, or -1."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                break
            self.root = up
        size = FAN**level
        cuts = np.arange(0, len(self.fps), size)
        low, high = np.minimum.reduceat(self.root, cuts), np.maximum.reduceat(self.root, cuts)
        return np.where(low == high, low, -1)

    def link(self, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of all links: (fingerprint, fingerprint of its root)."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                for i in range(0, len(a), chunk):
                    stack.append((level, a[i : i + chunk], b[i : i + chunk]))
                continue
            pattern, mask = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= MAX_BITS
            whole = self._whole(level)
            near &= ~((whole[a] == whole[b]) & (whole[a] >= 0))
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                for x, y in zip(a.tolist(), b.tolist()):
                    x, y = self._find(x), self._find(y)
                    if x != y:
                        self.root[max(x, y)] = min(x, y)
                continue
            below = len(self.levels[level - 1][0])
            ca = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None]).repeat(FAN, 2).ravel()
            cb = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :]).repeat(FAN, 1).ravel()
            ok = (ca < below) & (cb < below) & ((ca < cb) | ((ca == cb) & (level > 1)))
            stack.append((level - 1, ca[ok], cb[ok]))
        self._whole(0)
        child = np.flatnonzero(self.root != np.arange(len(self.fps)))
        return self.fps[child], self.fps[self.root[child]]


def bucket_edges(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints, as forests of all buckets."""

    def run(batches):
        held: np.ndarray = np.zeros((0, 3), np.int64)

        def solve(rows: np.ndarray):
            change = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0) != 0, axis=1)) + 1
            cuts = np.concatenate([[0], change, [len(rows)]])
            us, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    u, v = GrayIndex(rows[a:b, 2].copy().view(np.uint64)).link()
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        waiting: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            waiting.append(rows)
            if np.array_equal(rows[0, :2], rows[-1, :2]) and np.array_equal(waiting[0][0, :2], rows[-1, :2]):
                continue
            held = np.concatenate(waiting)
            last = int(np.flatnonzero(np.any(held[:, :2] != held[-1, :2], axis=1))[-1]) + 1
            yield from solve(held[:last])
            waiting = [held[last:]]
        if waiting:
            yield from solve(np.concatenate(waiting))

    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (s, n) in enumerate(SHIFTS)]))
    dealt = distinct.select(blocks.alias("k"), "fp").select("k.b", "k.v", "fp")
    return dealt.repartition("b", "v").sortWithinPartitions("b", "v", "fp").mapInArrow(run, "u long, v long")


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u > v: a forest of the links between distinct doc_ids, by their fingerprints (doc_id, fp)."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    equal = fps.join(least, "fp").where("doc_id > least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    edges = bucket_edges(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}")) for x in ("u", "v"))
    near = edges.join(a, "u").join(b, "v").select(F.greatest("of_u", "of_v").alias("u"), F.least("of_u", "of_v").alias("v"))
    return equal.unionByName(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; edges are (u, v) with u > v."""
    edges = common.stored(edges.distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = common.stored(small, "small")
        same = small.count() == edges.count() and small.exceptAll(edges).isEmpty()
        edges = small
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    fps = common.stored(fingerprints(docs), "fingerprints")
    names = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(bucket_edges(names.select("fp")))
    named = names.join(roots, names.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(of_root, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
