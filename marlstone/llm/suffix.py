"""Removal of repeated byte strings by suffix arrays.

Texts are cut into segments: stretches of windows (`width` bytes) that have the same smallest inner piece, by a hash of
it. Equal windows have equal smallest pieces, so windows can only repeat between segments of one key. Of segments of equal
content the first stays and all others go whole. Segments alone with their key are dropped. The rest are brought
together, and blocks of them are suffix-sorted in two stages: suffixes smaller than their successors are sorted directly,
all others are induced by one scan over the buckets. Common prefixes of neighbours then give the groups of equal windows,
whose first member stays.

Frequent pieces rank last, so that a key is frequent only where nothing rarer stands in a window: a bitmap from a sample
of `SAMPLE` texts says which; it moves work, never results. Copies meet in the map tasks first. A key with more than
`KEY_ROWS` different segments is cut once more, into single windows, which need no sorting.

Null text is empty. Order is (doc_id, start), null doc_id first. Rows that share a doc_id are told apart by their text;
equal rows are one document for the order and lose the same bytes, and only one of them is searched. Texts shorter than
a window lose nothing. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm import common

WIDTH, PIECE = 100, 32
#: Texts of the sample that ranks pieces, and the share of them (one in so many) that makes a piece frequent.
SAMPLE, SHARE = 4096, 200
_RANK_BITS = 20
#: Different segments of one key that are sorted together.
KEY_ROWS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_SIGNED = np.int64(_BASE - (1 << 64))


def _hash_pieces(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of raw[i : i + length] for every i that has one."""
    with np.errstate(over="ignore"):
        one = (raw.astype(np.uint64) + np.uint64(1)) * _MIX
        one ^= one >> np.uint64(29)
        powers, size = {1: one}, 1
        while size * 2 <= length:
            h = powers[size]
            h = h[: max(0, len(h) - size)] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
            powers[size] = h
        n, done, out = max(0, len(raw) - length + 1), 0, None
        for size in sorted(powers, reverse=True):
            if length - done >= size:
                part = powers[size][done : done + n]
                out = part.copy() if out is None else out * np.uint64(0x94D049BB133111EB) + part
                done += size
        out = out * _MIX
        return out ^ (out >> np.uint64(32))


def _window_min(h: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while step * 2 <= size:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = size - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2^64 to the powers 0 .. n - 1."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, x, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def segments(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, piece: int = PIECE, frequent: np.ndarray | None = None):
    """(document, key, content, start, length, times) of the segments of documents laid end to end.

    content: a hash of the segment. times: 2 if the key's piece stands in several places of the segment; in periodic text
    a segment can repeat its own windows.
    """
    if len(raw) < width:
        return (np.zeros(0, np.int64),) * 6
    pieces = _hash_pieces(raw, piece)
    # The order of pieces in a window: frequent ones last, then by hash, then the last place first.
    place = np.uint64(max(20, len(raw).bit_length()))
    low = np.uint64((1 << int(place)) - 1)
    rank = pieces >> np.uint64(1)
    if frequent is not None:
        rank |= frequent[pieces & np.uint64((1 << _RANK_BITS) - 1)].astype(np.uint64) << np.uint64(63)
    rank |= low
    rank ^= np.arange(len(pieces), dtype=np.uint64)
    at = (_window_min(rank, width - piece + 1) & low ^ low).astype(np.int64)
    key = pieces[at].view(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[: len(key)] == doc[width - 1 :]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1]) | (doc[1 : len(key)] != doc[: len(key) - 1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    up, down = _powers(1 << len(pieces).bit_length())
    total = np.zeros(len(pieces) + 1, np.uint64)
    np.cumsum(pieces * up[: len(pieces)], out=total[1:])
    content = (total[last + width - piece + 1] - total[first]) * down[first] + (last - first).astype(np.uint64) * _MIX
    return doc[first], key[first], content.view(np.int64), first - offsets[doc[first]], last - first + width, 1 + (at[first] != at[last])


def _columns(text: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first `depth` symbols behind each place, as big-endian numbers of 8 symbols."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : j + len(eight)]
    return [eight[at + d] for d in range(0, depth, 8)]


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of text, right to at least `depth` symbols."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the next different symbol is larger; the end counts as smallest.
    change = np.flatnonzero(text[1:] != text[:-1]) if n > 1 else np.zeros(0, np.int64)
    run_end = np.concatenate([change, [n - 1]])
    rising = np.concatenate([text[change + 1] > text[change], [False]]) if n > 1 else np.array([False])
    small = np.repeat(rising, np.diff(np.concatenate([[-1], run_end])))
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort(_columns(text, direct, -(-depth // 8) * 8)[::-1])]
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def give(done: np.ndarray, symbol: int) -> np.ndarray:
        """Put the predecessors of sorted suffixes behind their buckets; return those of this bucket."""
        before = done[done > 0] - 1
        before = before[~small[before]]
        symbols = text[before]
        same = before[symbols == symbol]
        more = symbols > symbol
        before, symbols = before[more], symbols[more]
        if len(before):
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            edges = np.flatnonzero(np.diff(symbols)) + 1
            for part in np.split(before, edges):
                induced[int(text[part[0]])].append(part)
        return same

    induced[int(text[n - 1])].append(np.array([n - 1]))
    for symbol in range(256):
        wave = np.concatenate(induced[symbol]) if induced[symbol] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = give(wave, symbol)
        part = direct[cuts[symbol] : cuts[symbol + 1]]
        if len(part):
            out.append(part)
            give(part, symbol)
    return np.concatenate(out)


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares `depth` symbols with the one before it in order."""
    same = np.zeros(len(order), bool)
    alive = np.arange(1, len(order))
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : j + len(eight)]
    for d in [*range(0, depth - 7, 8), depth - 8]:
        alive = alive[eight[order[alive] + d] == eight[order[alive - 1] + d]]
    same[alive] = True
    return same


def repeated(parts: list[bytes], rank: np.ndarray, starts: np.ndarray, width: int = WIDTH):
    """(part, first, end) byte runs, within each part, of windows that also start earlier. rank orders documents."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no 0xff: separators become 0
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.arange(len(text)) - begin[part]
    order = two_stage_sort(text, width)
    order = order[inside[order] + width <= sizes[part[order]]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    group = np.cumsum(~common_prefix_reaches(text, order, width))
    p = part[order]
    by = np.lexsort((starts[p] + inside[order], rank[p], group))
    g, o = group[by], order[by]
    r, s = rank[part[o]], starts[part[o]] + inside[o]
    head = np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
    lead = np.repeat(head, np.diff(np.concatenate([head, [len(g)]])))
    later = np.sort(o[(r != r[lead]) | (s != s[lead])])
    if not len(later):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (np.diff(later) > 1) | (part[later[1:]] != part[later[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(later)]]) - 1
    return part[later[first]], inside[later[first]], inside[later[last]] + width


_SPAN = "struct<a:long,b:long>"
#: times 0: the segment repeats an earlier one as a whole.
_PLACE = "key long, content long, id long, h long, start int, length int, times int"
#: kind 0: goes whole; 1: to be sorted; 2: to be cut into windows.
_MARKED = "key long, id long, h long, start int, length int, kind int"


def frequent_pieces(docs: DataFrame, piece: int = PIECE, sample: int = SAMPLE) -> np.ndarray | None:
    """A bitmap over hashes of the pieces that a bounded sample of texts often holds."""

    def count(batches):
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            raw, offsets = common.byte_view(common.text_or_empty(batch.column(0)))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found.append(np.unique(_hash_pieces(raw[a:b], piece)))
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["piece", "n"])

    total = docs.count()
    every, enough = max(1, total // sample), max(8, min(total, sample) // SHARE)
    taken = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").repartition(4)
    seen = taken.mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= enough)
    cells = seen.select(F.col("piece").bitwiseAND(F.lit((1 << _RANK_BITS) - 1)).cast("int").alias("cell")).distinct().toPandas()["cell"].to_numpy()
    if not len(cells):
        return None
    out = np.zeros(1 << _RANK_BITS, bool)
    out[cells] = True
    return out


def _mark(key_rows: int):
    """Rows come sorted by key, content and place: tell those that repeat an earlier one, that are shared, or too many."""

    def marked(rows: dict[str, np.ndarray], which: np.ndarray, kind: np.ndarray):
        cols = [rows["key"], rows["id"], rows["h"], rows["start"].astype(np.int32), rows["length"].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c[which]) for c in cols] + [pa.array(kind[which].astype(np.int32))], ["key", "id", "h", "start", "length", "kind"])

    def firsts(rows):
        key, content, length = rows["key"], rows["content"], rows["length"]
        out = np.ones(len(key), bool)
        out[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (length[1:] != length[:-1])
        return out

    def take(rows, which):
        return {c: v[which] for c, v in rows.items()}

    def whole_keys(rows):
        """All rows of some keys, one for each content."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows["key"])) + 1])
        sizes = np.diff(np.concatenate([cuts, [len(rows["key"])]]))
        shared = (sizes > 1) | (np.maximum.reduceat(rows["times"], cuts) > 1)
        return marked(rows, np.repeat(shared, sizes), np.where(np.repeat(sizes, sizes) > key_rows, 2, 1))

    def run(batches):
        held, many = None, False  # held: the different contents of the last key; many: it has gone out in part
        for batch in batches:
            rows = {c: batch.column(k).to_numpy().astype(np.int64) for k, c in enumerate(batch.schema.names)}
            done = rows["times"] == 0
            if done.any():
                yield marked(rows, done, np.zeros(len(done), np.int64))
                rows = take(rows, ~done)
            if not len(rows["key"]):
                continue
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            first = firsts(rows)
            yield marked(rows, ~first, np.zeros(len(first), np.int64))
            rows = take(rows, first)
            if many:
                old = rows["key"] == rows["key"][0]
                if old.all():  # its last row waits, for others of its content may follow
                    yield marked(rows, np.arange(len(old)) < len(old) - 1, np.full(len(old), 2))
                    held = take(rows, slice(-1, None))
                    continue
                yield marked(rows, old, np.full(len(old), 2))
                rows, many = take(rows, ~old), False
            last = int(np.searchsorted(rows["key"], rows["key"][-1]))
            if last:
                yield whole_keys(take(rows, slice(0, last)))
            held = take(rows, slice(last, None))
            if len(held["key"]) > key_rows:
                many = True
                yield marked(held, np.arange(len(held["key"])) < len(held["key"]) - 1, np.full(len(held["key"]), 2))
                held = take(held, slice(-1, None))
        if held is not None:
            yield marked(held, np.ones(len(held["key"]), bool), np.full(len(held["key"]), 2)) if many else whole_keys(held)

    return run


def _cut(batches, width: int, piece: int, frequent: np.ndarray | None):
    """The segments of (id, h, text) rows; of equal ones in a slice all but the first are known to go."""
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 19):
            part = part.take(pa.array(np.lexsort((part.column(1).to_numpy(), part.column(0).to_numpy()))))
            raw, offsets = common.byte_view(common.text_or_empty(part.column(2)))
            doc, key, content, start, length, times = segments(raw, offsets, width, piece, frequent)
            order = np.argsort(key ^ (content * np.int64(31)), kind="stable")
            k, c, n = key[order], content[order], length[order]
            again = order[1:][(k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])]
            # Those go out under a random key.
            times[again], key[again] = 0, content[again] ^ (start[again] * _BASE_SIGNED) ^ doc[again]
            take = pa.array(doc)
            small = [pa.array(x.astype(np.int32)) for x in (start, length, times)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), part.column(0).take(take), part.column(1).take(take), *small], ["key", "content", "id", "h", "start", "length", "times"])


def _windows(starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray, begin: np.ndarray, width: int):
    """(segment, hash, other hash, start) of every window of some segments."""
    count = sizes - width + 1
    which = np.repeat(np.arange(len(sizes)), count)
    inside = common.ranges(np.zeros(len(sizes), np.int64), count)
    at = begin[which] + inside
    return which, _hash_pieces(raw, width)[at].view(np.int64), _hash_pieces(raw ^ np.uint8(0x5A), width)[at], starts[which] + inside


def _load(batches, width: int):
    """(id, h, text, cuts) rows to the bytes of their cuts; or to their windows, each with 8 bytes of another hash."""
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 18):
            raw, offsets = common.byte_view(common.text_or_empty(part.column(2)))
            lists = part.column(3)
            cuts, doc = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            key, start, length, kind = (cuts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "start", "length", "kind"))
            one, begin = kind == 1, offsets[doc] + start
            data = np.ascontiguousarray(raw[common.ranges(begin[one], length[one])])
            ends = np.concatenate([[0], np.cumsum(length[one])]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), int(one.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            names = ["key", "id", "h", "start", "part"]

            def rows(k, d, s, p):
                return pa.RecordBatch.from_arrays([pa.array(k), part.column(0).take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array(s.astype(np.int32)), p], names)

            yield rows(key[one], doc[one], start[one], parts)
            if not one.all():
                which, hashed, other, at = _windows(start[~one], length[~one], raw, begin[~one], width)
                yield rows(hashed, doc[~one][which], at, pa.Array.from_buffers(pa.binary(8), len(at), [None, pa.py_buffer(other.tobytes())]).cast(pa.binary()))


def _solve(width: int, block_bytes: int):
    """Rows come sorted by key and place: the spans to remove."""

    def spans(ids, hs, a, b):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hs), pa.array(a), pa.array(b)], ["id", "h", "a", "b"])

    def sort(table: pa.Table):
        ids, hs, starts = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "h", "start"))
        order = np.lexsort((hs, ids))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((np.diff(ids[order]) != 0) | (np.diff(hs[order]) != 0))])
        part, a, b = repeated(table.column("part").to_pylist(), rank, starts, width)
        return spans(ids[part], hs[part], starts[part] + a, starts[part] + b)

    def run(batches):
        held, size, window = [], 0, (None, None)
        for batch in batches:
            alone = pc.equal(pc.binary_length(batch.column(4)), 8)
            if pc.any(alone).as_py():
                # Windows of one key and hash are equal: all but the first go.
                table = batch.filter(alone)
                key, ids, hs, start = (table.column(k).to_numpy().astype(np.int64) for k in range(4))
                other = np.frombuffer(b"".join(table.column(4).to_pylist()), np.int64)
                again = np.ones(len(key), bool)
                again[1:] = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
                again[0] = (key[0], other[0]) == window
                window = (key[-1], other[-1])
                yield spans(ids[again], hs[again], start[again], start[again] + width)
                batch = batch.filter(pc.invert(alone))
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < block_bytes or held[0].column("key")[0] == batch.column(0)[-1]:
                continue
            table = pa.concat_tables(held)
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield sort(table.slice(0, last))
            held = [table.slice(last)]
            size = held[0].nbytes
        if held:
            yield sort(pa.concat_tables(held))

    return run


def find(
    docs: DataFrame, width: int = WIDTH, piece: int = PIECE, block_bytes: int = 2 << 20, row: Column | None = None, key_rows: int = KEY_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, text (null: empty) and merged byte spans to remove, for every row; and `row`, where given, beside them.

    All joins with the texts are on (id, h), the place of a document, so that they share one shuffle of the texts. A text
    that also stands in an earlier document goes whole and takes no further part.
    """
    none = -(1 << 63)
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), *([] if row is None else [row.alias("row")]))
    long = base.where(F.octet_length("text") >= width)
    first = long.select("id", "h", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("digest").agg(F.min("id").alias("id"), F.min("h").alias("h"))
    first = common.stored(first.select("id", "h").distinct(), "first")
    frequent = frequent_pieces(docs.select(text.alias("text")), piece, sample)

    texts = base.join(first, ["id", "h"]).select("id", "h", "text").dropDuplicates(["id", "h"])
    segs = texts.mapInArrow(lambda batches: _cut(batches, width, piece, frequent), _PLACE)
    marks = segs.repartition("key").sortWithinPartitions("key", "content", "length", "id", "h", "start").mapInArrow(_mark(key_rows), _MARKED)
    marks = common.stored(marks, "marks")
    cuts = marks.where("kind > 0").groupBy("id", "h").agg(F.collect_list(F.struct("key", "start", "length", "kind")).alias("cuts"))
    loaded = texts.join(cuts, ["id", "h"]).select("id", "h", "text", "cuts").mapInArrow(lambda batches: _load(batches, width), "key long, id long, h long, start int, part binary")
    spans = loaded.repartition("key").sortWithinPartitions("key", "id", "h", "start").mapInArrow(_solve(width, block_bytes), "id long, h long, a long, b long")
    whole = marks.where("kind = 0").select("id", "h", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("length")).cast("long").alias("b"))
    merged = spans.unionByName(whole).groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    known = first.join(merged, ["id", "h"], "left").select("id", "h", "spans", F.lit(True).alias("first"))
    size = F.octet_length("text").cast("long")
    copy = F.col("first").isNull() & (size >= width)
    return base.join(known, ["id", "h"], "left").select(
        F.nullif("id", F.lit(none)).alias("doc_id"),
        "text",
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))).otherwise(F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)"))).alias("spans"),
        *([] if row is None else ["row"]),
    )


def kept_bytes(text: str, spans: list[dict]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    raw, out, at, runs = text.encode("utf-8", "surrogatepass"), [], 0, 0
    end = -1
    for s in spans:
        if s["a"] > end:
            out.append(raw[at : s["a"]])
            runs += 1
        end = max(end, s["b"])
        at = end
    out.append(raw[at:])
    kept = b"".join(out)
    return kept, len(raw) - len(kept), runs


def digest(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            got = [(len(t.encode("utf-8", "surrogatepass")), *kept_bytes(t, s)) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                    pa.array([g[3] for g in got], pa.int64()), pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(found: DataFrame) -> DataFrame:
    """doc_id, text without the repeated spans, and `row` where found has it; code points cut by a span go with it."""

    def run(batches):
        for batch in batches:
            texts = [kept_bytes(t, s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], ["doc_id", "text", *batch.schema.names[3:]])

    return found.mapInArrow(run, found.drop("spans").schema)
