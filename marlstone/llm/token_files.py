"""Token-ID output: concatenated ids with Elias-Fano coded document ends, in blocks of bounded size.

A block is one binary value: magic, counts, the ids as little-endian uint32, and the ends of its documents in
Elias-Fano form. Blocks are rows of a Parquet table in ascending doc_id order (nulls first): part, seq and `before`
(ids before the block inside its part) place each of them, so a reader needs only the total of each part.

Null text counts as empty; a document of no text still has the end id. Rows with equal doc_id each keep their own entry,
ordered by text. Extra columns are ignored. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import common, tokens

MAGIC = b"MEF1"


#: The place of the r-th set bit of a byte.
_BIT = np.array([[([j for j in range(8) if b >> j & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.int64)
#: Bytes of the upper part for each entry of the directory.
_STEP = 64


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with select.

    The stored directory holds, as 32-bit numbers, the set bits before every 64th byte of the upper part: one bit more
    for each 16 bits of it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.int64)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        upper = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        upper[(values >> low_bits) + np.arange(n)] = 1
        high = np.packbits(upper, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % _STEP, np.uint8)])
        counts = np.bitwise_count(high).reshape(-1, _STEP).sum(1, dtype=np.uint32)
        directory = np.cumsum(counts, dtype=np.uint32) - counts
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), high, directory)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values numbered i: each by the directory, 64 bytes of the upper part and its own low bits."""
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), 4096):
            out[a : a + 4096] = self._select(np.asarray(i[a : a + 4096], np.int64))
        return out

    def _select(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.directory, i, "right") - 1
        part = self.high.reshape(-1, _STEP)[block]
        upto = np.cumsum(np.bitwise_count(part), axis=1, dtype=np.int64)
        rest = i - self.directory[block]
        byte = (upto <= rest[:, None]).sum(1)
        row = np.arange(len(i))
        rest = rest - np.where(byte > 0, upto[row, byte - 1], 0)
        at = block * _STEP * 8 + byte * 8 + _BIT[part[row, byte], rest]
        value = (at - i) << self.low_bits
        for j in range(self.low_bits):
            bit = i * self.low_bits + j
            value |= ((self.low[bit >> 3] >> (bit & 7)).astype(np.int64) & 1) << j
        return value

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        raw = np.frombuffer(data, np.uint8, a + b, at)
        return cls(n, low_bits, raw[:a], raw[a:], np.frombuffer(data, "<u4", b // _STEP, at + a + b))


def pack_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<Q", len(ids)) + ids.astype("<u4").tobytes() + EliasFano.build(ends).to_bytes()


def read_block(data: bytes) -> tuple[np.ndarray, EliasFano]:
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    (n,) = struct.unpack_from("<Q", data, 4)
    return np.frombuffer(data, "<u4", n, 12), EliasFano.from_bytes(data[12 + 4 * n :])


def document(ids: np.ndarray, ends: EliasFano, i: int) -> np.ndarray:
    """The ids of document i of a block, found by two selects."""
    first = int(ends.select(np.array([i - 1]))[0]) if i else 0
    return ids[first : int(ends.select(np.array([i]))[0])]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put end_id behind each document."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


_BLOCKS = "part int, seq int, before long, n_ids long, doc_ids array<long>, block binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all texts and write the block table."""

    def blocks(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc = tokens.encoder(tokenizer)
        for cut in common.gathered(batches, "text"):
            ids, ends = with_end(*enc.encode(common.text_or_empty(cut.column(1))), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays([0, cut.num_rows], cut.column(0)),
                    pa.array([pack_block(ids, ends[1:])], pa.binary()),
                ],
                ["part", "seq", "before", "n_ids", "doc_ids", "block"],
            )
            seq, before = seq + 1, before + len(ids)
        enc.rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(
        blocks, _BLOCKS
    ).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row for each document of a block table: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches):
        for batch in batches:
            for base, before, doc_ids, block in zip(*(batch.column(i) for i in range(4))):
                ids, ends = read_block(block.as_py())
                e = ends.select(np.arange(ends.n))
                s = np.concatenate([[0], e])[:-1]
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.tolist(), e.tolist())]
                first = base.as_py() + before.as_py()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(s + first), pa.array(e - s), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    table = spark.read.schema(_BLOCKS).parquet(path)
    # One row for each part of the table: as many as the writing job had tasks.
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return table.join(bases, "part").select("base", "before", "doc_ids", "block").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
