"""Array-at-a-time text primitives shared by the corpus operators.

A batch of texts is one UTF-8 byte array plus document offsets; words, word hashes
and hashes of word windows are computed for the whole batch with numpy, so no
operator loops over words in Python.  Words are ``[^\\x20\\x09-\\x0D]+``; a null text
has no words.  Hashes are functions of content alone (fixed constants), hence equal
on every executor, at every batch size and after any recomputation.

A word's hash chains its bytes, eight at a time, through a bijective mixer, so it is not
linear in any of them; words of eight bytes or fewer have different hashes if they have one
length.  Longer runs of words are hashed from the hashes of their halves, again through the
mixer.  Long words and whole texts take BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEEDS = (U64(0x9E3779B97F4A7C13), U64(0xC2B2AE3D27D4EB4B))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)

#: Bytes of a word that are chained; a longer word is hashed as a whole.
_CHAINED = 128

#: Bytes of text that one step of an operator works on (a longer document is one step).
STEP_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of two runs in a row from those of each."""
    return mix(first * U64(0x9E3779B97F4A7C15) + (last ^ (last >> U64(29))) * U64(0xC2B2AE3D27D4EB4F) + U64(0x165667B19E3779F9))


def lanes(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the next seven as one number (zeros after the end); a view that overlaps itself."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _words_hash(data: np.ndarray, lane: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    n = ends - starts
    h = mix((lane[starts] & _KEEP[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * U64(0xA24BAED4963EE407) + _SEEDS[which]))
    longer = np.flatnonzero((n > 8) & (n <= _CHAINED))
    at = 8
    while len(longer):
        rest = n[longer] - at
        h[longer] = mix((h[longer] * U64(0x9FB21C651E98DF25)) ^ (lane[starts[longer] + at] & _KEEP[np.minimum(rest, 8)]))
        at += 8
        longer = longer[rest > 8]
    for i in np.flatnonzero(n > _CHAINED):
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")[which]
    return h


class Batch:
    """Words of a batch: ``starts``/``ends`` in bytes, ``doc`` of each word, ``first[d]:first[d+1]`` words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = (data != 32) & (data - np.uint8(9) > 4) if space is SPACE else ~space[data]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        head[edges] = inside[edges]
        tail[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._lanes: np.ndarray | None = None
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    @property
    def lanes(self) -> np.ndarray:
        if self._lanes is None:
            self._lanes = lanes(self.data)
        return self._lanes

    @property
    def word_hash(self) -> np.ndarray:
        return self.words_hash(0)

    def words_hash(self, which: int) -> np.ndarray:
        """The first or the second hash of each word; the two are made apart."""
        if which not in self._hashes:
            self._hashes[which] = _words_hash(self.data, self.lanes, self.starts, self.ends, which)
        return self._hashes[which]

    def beginnings_hash(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n <= 8 bytes from each start."""
        return mix((self.lanes[starts] & _KEEP[n]) ^ U64(n * 0xD6E8FEB86659FD93 % 2**64))

    def text_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each whole text, as two signed arrays."""
        raw, at = self.data.tobytes(), self.offsets.tolist()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False))
        both = np.frombuffer(digests, "<i8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def runs_hash(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of each run of k words, from the hashes of shorter runs; documents are not looked at."""
        size, run = 1, self.words_hash(which)
        done, out = 0, None
        while True:
            if k & size:
                part = run[done:] if done else run
                out = part if out is None else joined_hash(out[: len(part)], part[: len(out)])
                done += size
            if done == k:
                return out[: max(len(self.starts) - k + 1, 0)]
            run, size = joined_hash(run[:-size], run[size:]) if len(run) > size else run[:0], 2 * size

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words within one document."""
        n = np.maximum(self.counts - k + 1, 0)
        at = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return at, self.runs_hash(k, which)[at]

    def whole_hash(self, docs: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of all words of each of the given documents, which have few words each."""
        out = np.zeros(len(docs), np.uint64)
        for k in np.unique(self.counts[docs]):
            use = self.counts[docs] == k
            out[use] = self.runs_hash(int(k), which)[self.first[docs[use]]]
        return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text (one row at least), so that memory stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z only."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
