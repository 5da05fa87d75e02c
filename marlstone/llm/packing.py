"""Vector bin packing of documents into sequences, by the dot-product heuristic.

Every piece is a vector (tokens, segments, loss-bearing tokens) and every sequence has a limit for each. The open
sequence takes the waiting document whose dot product with its free room, both as shares of the limits, is largest among
those that fit whole. If none fits, the largest is cut to the room left and its rest opens the next sequences.

The loss-bearing ids of a document are its last ones: as many as the column named by `loss` says, or all where it is
absent or null (then the loss limit binds only if it is below the token limit).

A task packs its own documents in windows of bounded size and carries the open sequence from window to window, so at
most one sequence of a task is not full, unless the segment or loss limit closes it. Null text counts as empty: one piece
with the end id. Rows of null or repeated doc_id are packed as documents of their own; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import common, tokens
from marlstone.llm.token_files import with_end

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs windows of documents; carries the open sequence from one window to the next."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = (max_tokens, max_segments, max_loss)
        self._open(0)

    def _open(self, number: int) -> None:
        self.sequence, self.free = number, list(self.limits)

    def _put(self, doc: int, start: int, length: int, loss: int) -> tuple[int, int, int, int, int]:
        piece = (doc, start, length, self.sequence, self.limits[0] - self.free[0])
        self.free = [self.free[0] - length, self.free[1] - 1, self.free[2] - loss]
        if self.free[0] <= 0 or self.free[1] <= 0:
            self._open(self.sequence + 1)
        return piece

    def _cut(self, doc: int, tokens_: int, loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        """One document over the room left and as many further sequences as it needs."""
        start, plain = 0, tokens_ - loss
        while start < tokens_:
            # Ids up to `plain` bear no loss, those behind it do.
            take = min(tokens_ - start, self.free[0], max(0, plain - start) + self.free[2])
            if take <= 0:
                self._open(self.sequence + 1)
                continue
            yield self._put(doc, start, take, take - min(take, max(0, plain - start)))
            start += take

    def pack(self, lengths: np.ndarray, losses: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of every piece."""
        # Documents of equal vectors are one class; classes are sorted by tokens.
        order = np.lexsort((losses, lengths))
        n, loss = lengths[order], losses[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(n) != 0) | (np.diff(loss) != 0)])[: len(n)])
        members = [part.tolist() for part in np.split(order, first[1:])] if len(order) else []
        n, loss = n[first], loss[first]
        share_n, share_loss = n / self.limits[0] ** 2, loss / self.limits[2] ** 2
        while members:
            at = int(np.searchsorted(n, self.free[0], "right"))
            if at:
                # Every document is one segment, so that the segments' product is the same for all.
                score = share_n[:at] * self.free[0] + share_loss[:at] * self.free[2] + self.free[1] / self.limits[1] ** 2
                score[loss[:at] > self.free[2]] = -1.0
                best = int(np.argmax(score))
                at = best + 1 if score[best] >= 0 else 0
            k = at - 1 if at else len(members) - 1
            doc = members[k].pop()
            yield from self._cut(doc, int(n[k]), int(loss[k])) if not at else (self._put(doc, 0, int(n[k]), int(loss[k])),)
            if not members[k]:
                del members[k]
                n, loss, share_n, share_loss = (np.delete(x, k) for x in (n, loss, share_n, share_loss))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, max_tokens: int = 1024, max_segments: int = 32, max_loss: int = 1024, loss: str | None = None
) -> DataFrame:
    """One row for each piece. sequence_id is unique over all tasks: task number * 2^33 + number in the task."""

    def pieces(batches):
        enc = tokens.encoder(tokenizer)
        packer = Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 33
        for cut in common.gathered(batches, "text"):
            ids, ends = with_end(*enc.encode(common.text_or_empty(cut.column(1))), end_id)
            sizes = np.diff(ends)
            bear = cut.column(2).to_pandas().to_numpy(float)
            bear = np.where(np.isnan(bear), sizes, np.clip(np.nan_to_num(bear), 0, sizes)).astype(np.int64)
            doc, start, length, seq, offset = np.array(list(packer.pack(sizes, bear)), np.int64).reshape(-1, 5).T
            first = ends[doc] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * first).tolist(), (4 * (first + length)).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    cut.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(sizes[doc]), pa.array(seq + base), pa.array(offset),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
        enc.rest()

    bearing = F.lit(None).cast("long") if loss is None else F.col(loss).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bearing.alias("loss")).mapInArrow(pieces, _PIECES)
