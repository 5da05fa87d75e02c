"""SimHash near-duplicates made whole: exact Jaccard similarity of word shingles.

Texts whose sets of 5-word shingles reach a similarity of SHARE differ in about 5 to 12 of 64 fingerprint bits, which no
index by blocks of bits can promise to find. So the links of the SimHash index (simhash.links, 5 words) come first, each
checked on the whole sets, and a prefix filter completes them: sets whose similarity reaches SHARE have a common member
among the first n - ceil(SHARE * n) + 1 of each in any one order of all shingles, so texts are dealt by those and no pair
is missed. The order puts shingles that a sample of texts often holds last; it decides the work, not the result. In a
bucket texts are first checked against some leads of their size, in rounds (STARS), then the pairs that are still in different components
are checked: a bucket of near copies costs its size, not its pairs. A pair counts in a bucket only if what stands behind
the bucket's shingle in both sets can still reach SHARE (positional filter): for the first shingle that both have, that
bounds their whole overlap. Shingles and texts are known by 64-bit hashes.

One pass over the texts stores of each its prefix, fingerprint and sketch: a quarter of its set, and how many of the rest
fall into each of twelve parts. The sketches of two sets bound their overlap from above, so that most candidates go
before whole sets are read again; those of the others are compared exactly.

Words are lower-cased in ASCII and split at ASCII blanks. A text of fewer words than a shingle is one shingle, null,
empty and wordless texts are one text. Columns other than text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm import common, simhash

WIDTH = 5
#: SHARE is 4 / 5, in whole numbers.
UP, DOWN = 4, 5
SAMPLE, COMMON = 20_000, 200_000
BROADCAST_BYTES = 64 << 20
#: Rounds of stars: leads in a bucket, one bucket of so many, salt of the choice.
STARS = ((10, 2, 0), (64, 1, 7))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(parts) - width + 1)].tolist()
    ends = ends[min(width, len(parts)) - 1 :].tolist() if parts else [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends)).view(np.int64))


def text_key(text: str = "text") -> Column:
    """Equal for texts of equal words."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds three times or more, sorted, and their counts."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], ["h"])

    every = max(1, texts.count() // SAMPLE)
    seen = texts.where(F.pmod("k", F.lit(every)) == 0).select("k", "text").mapInArrow(run, "h long").groupBy("h").count()
    got = seen.where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    pairs = np.array(sorted((r["h"], r["count"]) for r in got), np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


_FEATURES = "k long, n int, fp long, prefix array<long>, sketch binary"
#: Parts of a set by the low bits of its hashes: the first ones are sampled, the others counted.
_PARTS, _SAMPLED = 16, 4


def sketch(h: np.ndarray) -> bytes:
    part = h & (_PARTS - 1)
    counts = np.bincount(part, minlength=_PARTS)[_SAMPLED:].astype("<u4")
    return counts.tobytes() + np.sort((h[part < _SAMPLED] >> 32).astype("<i4")).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """An upper bound of the common members of two sets, by their sketches."""
    at = 4 * (_PARTS - _SAMPLED)
    rest = np.minimum(np.frombuffer(a, "<u4", _PARTS - _SAMPLED), np.frombuffer(b, "<u4", _PARTS - _SAMPLED)).sum()
    x, y = np.frombuffer(a, "<i4", offset=at), np.frombuffer(b, "<i4", offset=at)
    if not len(x) or not len(y):
        return int(rest)
    # Members cut to 32 bits: equal ones may be counted too often, never too rarely.
    return int(rest) + int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _features(texts: DataFrame) -> DataFrame:
    """One row for each distinct text; copies in one task are read once."""
    often, counts = _common(texts)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k in seen:
                    continue
                seen.add(k)
                h = shingles(t)
                n = len(h)
                weight = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    weight = np.where(often[at] == h, counts[at], 0)
                prefix = h[np.lexsort((h, weight))[: n - -(-UP * n // DOWN) + 1]]
                out.append((k, n, simhash.vote(h.view(np.uint64)), prefix, sketch(h)))
            if out:
                k, n, fp, prefix, sketches = zip(*out)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix))), pa.array(sketches, pa.binary()),
                    ],
                    ["k", "n", "fp", "prefix", "sketch"],
                )

    return texts.select("k", "text").mapInArrow(run, _FEATURES).dropDuplicates(["k"])


def _buckets(batches):
    """Buckets (rows of equal first column, sorted to the third) of two texts or more as arrays, each text once."""
    held: list[np.ndarray] = []

    def whole(rows):
        rows = rows[np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)])]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
        big = np.flatnonzero(np.diff(cuts) > 1)
        for a, b in zip(cuts[big].tolist(), cuts[big + 1].tolist()):
            yield rows[a:b]

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        if not len(rows):
            continue
        held.append(rows)
        if held[0][0, 0] == rows[-1, 0]:
            continue
        rows = np.concatenate(held)
        last = int(np.flatnonzero(np.diff(rows[:, 0]))[-1]) + 1
        yield from whole(rows[:last])
        held = [rows[last:]]
    if held:
        yield from whole(np.concatenate(held))


_BUCKET = "h long, n long, k long, p long"


def _shared(batches):
    """The rows of buckets of two texts or more."""
    held: list[np.ndarray] = []
    size = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in np.concatenate(held).T], ["h", "n", "k", "p"])

    for rows in _buckets(batches):
        held.append(rows)
        size += len(rows)
        if size >= 1 << 14:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _reaches(rows: np.ndarray, i: int, others: slice) -> np.ndarray:
    """Which others of a bucket can be similar to row i, with nothing in common before the bucket's shingle."""
    left = rows[others, 1] - rows[others, 3]
    return (UP + DOWN) * np.minimum(left, rows[i, 1] - rows[i, 3]) >= UP * (rows[others, 1] + rows[i, 1])


def _emit(parts):
    """Record batches of (u, v), u > v, from pairs of arrays."""
    held, size = [], 0
    for a, b in parts:
        held.append(np.stack([np.maximum(a, b), np.minimum(a, b)], 1))
        size += len(a)
        if size >= 1 << 18:
            rows = np.unique(np.concatenate(held), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["u", "v"])
            held, size = [], 0
    if held:
        rows = np.unique(np.concatenate(held), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["u", "v"])


def _stars(leads: int, one_in: int, salt: int):
    """Texts of a bucket (h, n, k, p, c) with `leads` others of other components c whose sizes allow a link.

    Leads are those of the smallest hash, so that the buckets of one group of near copies have the same ones. One bucket
    in `one_in` is enough, for the texts of such a group meet in many; what is missed is left to _rest.
    """

    def parts(batches):
        for rows in _buckets(batches):
            n, k, c = rows[:, 1], rows[:, 2], rows[:, 4]
            if rows[0, 0] % one_in or np.all(c == c[0]):
                continue
            order = k * np.int64(2 * salt + 1) ^ np.int64(salt)
            start = 0
            while start < len(rows) - 1:
                end = int(np.searchsorted(n, DOWN * n[start] // UP, "right"))
                first = np.argpartition(order[start:end], leads - 1)[:leads] if end - start > leads else np.arange(end - start)
                for lead in (start + first).tolist():
                    span = slice(start, min(len(rows), int(np.searchsorted(n, DOWN * n[lead] // UP, "right"))))
                    near = _reaches(rows, lead, span) & (DOWN * n[span] >= UP * n[lead]) & (c[span] != c[lead])
                    other = k[span][near]
                    if len(other):
                        yield np.full(len(other), k[lead]), other
                start = max(end, start + 1)

    return lambda batches: _emit(parts(batches))


def _rest(batches):
    """All pairs of a bucket (h, n, k, p, c) of different components c that can be similar."""

    def parts():
        for rows in _buckets(batches):
            n, k, c = rows[:, 1], rows[:, 2], rows[:, 4]
            if np.all(c == c[0]):
                continue
            ends = np.searchsorted(n, DOWN * n // UP, "right")
            for i in range(len(rows) - 1):
                span = slice(i + 1, int(ends[i]))
                other = k[span][(c[span] != c[i]) & _reaches(rows, i, span)]
                if len(other):
                    yield np.full(len(other), k[i]), other

    yield from _emit(parts())


def _possible(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a similarity of SHARE."""

    def check(batches):
        for batch in batches:
            n = (batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()).tolist()
            sketches = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            mask = pa.array([(UP + DOWN) * overlap_bound(a, b) >= UP * m for m, (a, b) in zip(n, sketches)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    of = lambda x: features.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(check, "u long, v long")


def _linked(pairs: DataFrame, texts: DataFrame, features: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs whose similarity reaches SHARE."""

    def hashed(batches):
        for batch in batches:
            got = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["k", "s"])

    def check(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(DOWN * both >= UP * (len(a) + len(b) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    possible = common.stored(_possible(pairs, features), "possible")
    ks = possible.select(F.col("u").alias("k")).unionByName(possible.select(F.col("v").alias("k"))).distinct()
    rows = common.stored(first.join(ks, "k", "left_semi").select("row"), "checked")
    # A row number takes 8 bytes; beyond the bound the texts are dealt to them.
    wanted = F.broadcast(rows) if 8 * rows.count() <= BROADCAST_BYTES else rows
    sets = common.stored(texts.join(wanted, "row", "left_semi").select("k", "text").mapInArrow(hashed, "k long, s binary"), "sets")
    joined = possible.join(sets.select(F.col("k").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("k").alias("v"), F.col("s").alias("sv")), "v")
    return common.stored(joined.select("u", "v", "su", "sv").mapInArrow(check, "u long, v long"), "linked")


def components(texts: DataFrame, first: DataFrame) -> DataFrame:
    """(node, root) of every text with a link; texts have (k, row, text), first one (k, row) of each k."""
    spark = texts.sparkSession
    begun = common.mark(spark)
    by_bucket = lambda rows: rows.repartition("h").sortWithinPartitions("h", "n", "k")
    features = common.stored(_features(texts), "features")
    common.tidy(spark)
    dealt = features.select(F.posexplode("prefix").alias("p", "h"), F.col("n").cast("long").alias("n"), "k").select("h", "n", "k", F.col("p").cast("long").alias("p"))
    shared = common.stored(by_bucket(dealt).mapInArrow(_shared, _BUCKET), "shared")
    common.tidy(spark)
    found = simhash.links(features.select(F.col("k").alias("doc_id"), "fp"))

    def compare(candidates, tried, links, name):
        """(pairs tried, links) with the candidates that were not tried before."""
        new = candidates.distinct() if tried is None else candidates.distinct().join(tried, ["u", "v"], "left_anti")
        new = common.stored(new, name)
        linked = _linked(new, texts, features, first)
        common.tidy(spark)
        return (new, linked) if tried is None else (tried.unionByName(new), links.unionByName(linked))

    def named(links):
        roots = simhash.components(links)
        return by_bucket(shared.join(roots, shared.k == roots.node, "left").select("h", "n", "k", "p", F.coalesce("root", "k").alias("c")))

    pairs = "u long, v long"
    start = by_bucket(shared).withColumn("c", F.col("k")).mapInArrow(_stars(*STARS[0]), pairs)
    tried, links = compare(start.unionByName(found), None, None, "stars")
    for k, star in enumerate(STARS[1:]):
        tried, links = compare(named(links).mapInArrow(_stars(*star), pairs), tried, links, f"stars{k}")
    _, links = compare(named(links).mapInArrow(_rest, pairs), tried, links, "rest")
    # The result is one small table more; all others of this search go.
    roots = common.stored(simhash.components(links), "roots")
    common.release(spark, begun, keep=("roots",))
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: the smallest doc_id (null last), among equal ids any one row."""
    base = common.stored(docs.withColumn("_k", text_key()).withColumn("_row", F.monotonically_increasing_id()), "rows")
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_row").alias("row")))
    heads = common.stored(base.groupBy("_k").agg(rank.alias("head")).select(F.col("_k").alias("k"), "head"), "heads")
    texts = base.select(F.col("_k").alias("k"), F.col("_row").alias("row"), "text")
    roots = components(texts, heads.select("k", "head.row"))
    kept = heads.join(roots, heads.k == roots.node, "left").groupBy(F.coalesce("root", "k").alias("c")).agg(F.min("head").alias("head"))
    return base.join(kept.select(F.col("head.row").alias("_row")), "_row", "left_semi").select(docs.columns)
