"""Whole-text encoding with the tokenizers library at the speed of its model.

A text is cut at plain blanks, where both supported pre-tokenizers cut as well, and Arrow reduces each slice to its
distinct pieces. New pieces made only of Latin letters, digits and ASCII punctuation are cut together into the pre-tokens
the library would make, and each new one goes straight to the library's BPE model. All other pieces, and all texts with
unusual white space, go through the library's full encode(). The result equals encode() of the whole text.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.llm.common import ranges

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
#: A piece that is cut into segments here; any other goes to the library.
_SIMPLE = rf"^[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*$"
_SEGMENTS = {
    "words": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+|\t"),
    "bytes": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n|\t"),
}
#: A blank that does not simply lead the next word; such texts are encoded by the library as they are.
_ODD_BLANK = r" (?:\s|[\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}\x{180e}\x{0300}-\x{036f}]|$)"


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins that byte-level models use: visible Latin-1 stays, the rest moves past U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_TABLE = _byte_chars()


def digest(path: str) -> str:
    """The version digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """Encodes texts with a tokenizers .json file.

    The ids of known pieces stand one after the other in a pool. When more than `max_cached` pieces are known, those that
    only one slice has used are forgotten.
    """

    def __init__(self, path: str, max_cached: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model, self.max_cached = self.library.model, max_cached
        kind, normal = json.dumps(spec["pre_tokenizer"]), json.dumps(spec["normalizer"])
        words = '"Split"' in kind and '"Lowercase"' in normal and "[\\\\p{L}]+|[\\\\p{N}]|" in kind
        plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
        self.kind = "words" if words else "bytes" if plain else "library"
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(len(s) < 4 or not s.startswith("<|") for s in self.special):
            self.kind = "library"
        #: Piece to its number; sizes and begin place its ids in the pool, uses counts the slices that held it.
        self.pieces: dict[str, int] = {}
        self.sizes, self.uses, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._forget_segments()

    def _forget_segments(self) -> None:
        #: Segment to its number; a tab stands between pieces and has no ids.
        self.segments: dict[str, int] = {"\t": 0}
        self.segment_sizes, self.segment_pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _simple(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of simple pieces, by the segments that the library would cut them into."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = lead + f"\t{lead}".join(words)
        parts = _SEGMENTS[self.kind].findall(joined.lower() if self.kind == "words" else joined)
        if len(self.segments) > self.max_cached:
            self._forget_segments()
        code = np.fromiter(map(self.segments.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(code < 0).tolist()
        if unknown:
            names = [parts[k] for k in unknown]
            new = list(dict.fromkeys(names))
            mapped = "\t".join(new).encode("utf-8").decode("latin-1").translate(_BYTE_TABLE).split(_BYTE_TABLE[9])
            run = self.model.tokenize
            ids = [[t.id for t in run(m)] for m in mapped]
            self.segments.update(zip(new, range(len(self.segments), len(self.segments) + len(new))))
            self.segment_sizes = np.concatenate([self.segment_sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
            self.segment_pool = np.concatenate([self.segment_pool, np.fromiter(chain.from_iterable(ids), np.uint32)])
            code[unknown] = np.fromiter(map(self.segments.__getitem__, names), np.int64, len(names))
        begin, lens = (np.cumsum(self.segment_sizes) - self.segment_sizes)[code], self.segment_sizes[code]
        sizes = np.bincount(np.cumsum(code == 0), weights=lens, minlength=len(words)).astype(np.int64)
        return self.segment_pool[ranges(begin, lens)], sizes

    def _learn(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces: simple ones together, the others each by the library."""
        simple = pc.and_(pc.match_substring_regex(words, _SIMPLE), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        texts = words.to_numpy(zero_copy_only=False).tolist()
        ids, some = self._simple(list(compress(texts, simple.tolist())), lead)
        got = [self.library.encode(lead + w, add_special_tokens=False).ids if w else () for w in compress(texts, (~simple).tolist())]
        more = np.fromiter(map(len, got), np.int64, len(got))
        sizes, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sizes[simple], sizes[~simple] = some, more
        begin[simple], begin[~simple] = np.cumsum(some) - some, len(ids) + np.cumsum(more) - more
        both = np.concatenate([ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        return both[ranges(begin, sizes)], sizes

    def _numbers(self, vocabulary: pa.Array, lead: str) -> np.ndarray:
        """The piece number of every word, learning those that are new."""
        words = vocabulary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.pieces.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            ids, sizes = self._learn(vocabulary.take(pa.array(new)), lead)
            numbers[new] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.pieces.update(zip([words[k] for k in new.tolist()], numbers[new].tolist()))
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.uses[numbers] += 1
        return numbers

    def _keep(self, keep: np.ndarray) -> None:
        """Forget all pieces but those marked."""
        begin = np.cumsum(self.sizes) - self.sizes
        self.pool = self.pool[ranges(begin[keep], self.sizes[keep])]
        self.pieces = dict(zip(compress(self.pieces, keep.tolist()), range(int(keep.sum()))))
        self.sizes, self.uses = self.sizes[keep], np.minimum(self.uses[keep], 2)

    def _forget(self) -> None:
        keep = self.uses > 1
        if keep.sum() > self.max_cached // 2:
            keep &= self.uses > np.median(self.uses[keep])
        self._keep(keep)

    def rest(self, kept: int = 20_000) -> None:
        """Between tasks: keep the pieces used most, and give memory back, for a worker may idle beside others."""
        if len(self.pieces) > kept:
            self._keep(self.uses >= max(2, int(np.partition(self.uses, -kept)[-kept])))
        self._forget_segments()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of length n + 1). No text may be null."""
        n = len(texts)
        if self.kind == "library" or n == 0:
            return self._whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, _ODD_BLANK).to_numpy(zero_copy_only=False)
        if odd.any():
            keep = np.flatnonzero(~odd)
            ids, off = self.encode(texts.take(pa.array(keep)))
            ids2, off2 = self._whole(texts.filter(pa.array(odd)).to_pylist())
            lens, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
            lens[keep], begin[keep] = np.diff(off), off[:-1]
            lens[odd], begin[odd] = np.diff(off2), off2[:-1] + len(ids)
            both = np.concatenate([ids, ids2])
            return both[ranges(begin, lens)], np.concatenate([[0], np.cumsum(lens)])
        if len(self.pieces) > self.max_cached:
            self._forget()
        lists = pc.split_pattern(texts, " ")
        words = lists.values.dictionary_encode()
        code = words.indices.to_numpy()
        first = np.asarray(lists.offsets)[:-1]
        vocabulary = words.dictionary
        lead = " " if self.kind == "bytes" else ""
        numbers = self._numbers(vocabulary, lead)
        begin, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes
        begin, sizes, pool = begin[numbers], sizes[numbers], self.pool
        if lead:  # the first piece of a text has no blank before it
            heads, which = np.unique(code[first], return_inverse=True)
            bare, more = self._learn(vocabulary.take(pa.array(heads)), "")
            code = code.copy()
            code[first] = len(vocabulary) + which
            begin, sizes = np.concatenate([begin, len(pool) + np.cumsum(more) - more]), np.concatenate([sizes, more])
            pool = np.concatenate([pool, bare])
        lens = sizes[code]
        ids = pool[ranges(begin[code], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, ends[np.asarray(lists.offsets)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        return np.fromiter((i for g in got for i in g), np.uint32), np.concatenate([[0], np.cumsum([len(g) for g in got], dtype=np.int64)]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
