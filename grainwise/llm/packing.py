"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

Documents are tokenised once into pieces of at most ``capacity`` tokens.  The plan sees
only how many pieces have each length (at most ``capacity`` numbers): lengths are placed
in decreasing order, each into the fullest open sequences that still hold it, and equal
sequences are handled as one entry with a count.  A plan line says: of this length, the
pieces of rank a to b take consecutive sequences from s on, at this offset.  Pieces then
find their line by their rank within their length.

Token ids are those of the tokenizer file; words are looked up in a bounded cache of the
ids they gave before, so that a frequent word is merged once.

Defined results: a null text is the empty text and packs as its end token alone; repeated
rows are packed once each; an empty table packs into no sequence.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, ranked, tidy, written
from ._words import steps


@dataclass(frozen=True)
class Packing:
    """``tokenizer`` names a file of the public_tokenizers package, found on each worker; ``cache`` bounds the distinct text pieces kept by a worker."""

    tokenizer: str = "word_bpe_49k.json"
    capacity: int = 4096
    end_id: int = 1
    cache: int = 600_000


class Ids:
    """Ids of whole texts as little-endian 32-bit bytes.

    White space ends every match of the tokenizer's split pattern, so the ids of a text are
    those of its white-space words in turn; a word's ids are remembered.  New words are
    normalised and split as the tokenizer does, and merged by a rank table made from the
    same file: each byte (apart for a word's last) is a two-byte symbol, so that an
    end-of-word byte is a symbol of its own.  Files of any other make-up, and texts with
    special tokens or with U+001C-U+001F (on which definitions of white space differ), go
    through the tokenizer itself.
    """

    SEPARATOR, SEPARATOR_ID = "\u0400", 1 << 30

    def __init__(self, name: str, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        file = public_tokenizers.path(name)
        with open(file) as f:
            made = json.load(f)
        self.tokenizer, self.cache, self.known = Tokenizer.from_file(file), cache, {}
        self.apart = ["\x1c", "\x1d", "\x1e", "\x1f", *(x["content"] for x in made.get("added_tokens", []))]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        same = splits[0].get("type") == "Split" and splits[0].get("invert") and splits[0]["behavior"] == "Removed" and splits[1].get("type") == "ByteLevel"
        self.twin = None
        if same and kinds == ["NFC", "Replace", "Lowercase"] and made["model"].get("end_of_word_suffix") and not made.get("post_processor"):
            self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.twin = self._rank_table(made["model"])

    def _rank_table(self, model: dict):
        """The model as a tiktoken encoding, or None if its ids do not follow its merges."""
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        ranks, end = {self.SEPARATOR.encode(): self.SEPARATOR_ID}, model["end_of_word_suffix"]
        for token, i in model["vocab"].items():
            ends = token.endswith(end) and token != end
            body = token[: -len(end)] if ends else token
            if all(c in byte for c in body):
                ranks[self._symbols(bytes(byte[c] for c in body), ends).encode()] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), self.SEPARATOR_ID + 1 + b)  # asked for, never met
        return tiktoken.Encoding("ranks", pat_str="[^\\n]+", mergeable_ranks=ranks, special_tokens={})

    _shift = {b: 0x100 + b for b in range(256)}

    def _symbols(self, word: bytes, ends: bool = True) -> str:
        text = word.decode("latin-1").translate(self._shift)
        return text[:-1] + chr(ord(text[-1]) + 0x100 * ends)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _normal(self, word: str) -> str:
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return self.tokenizer.normalizer.normalize_str(word)
        return word.lower()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        lines = ["\n".join([self._symbols(x.encode()) for x in self.find(self._normal(w))]) for w in words]
        ids = np.array(self.twin.encode_ordinary(f"\n{self.SEPARATOR}\n".join(lines)), "<u4")
        at = np.flatnonzero(ids == self.SEPARATOR_ID)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.twin:
            return self._encode(texts)
        out, apart = [b""] * len(texts), [i for i, t in enumerate(texts) if any(x in t for x in self.apart)]
        for i, ids in zip(apart, self._encode([texts[i] for i in apart]), strict=True):
            out[i] = ids
        plain, known = sorted(set(range(len(texts))) - set(apart)), self.known
        found = [texts[i].split() for i in plain]
        fresh = list(set().union(*found) - known.keys())
        if len(known) + len(fresh) > self.cache:
            known.clear()
            fresh = list(set().union(*found))
        if fresh:
            known.update(zip(fresh, self._encode_words(fresh), strict=True))
        get = known.__getitem__
        for i, words in zip(plain, found, strict=True):
            out[i] = b"".join(map(get, words))
        return out


@lru_cache(maxsize=1)
def _ids(name: str, cache: int) -> Ids:
    """One for a worker process, kept from task to task."""
    return Ids(name, cache)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _tokenise(p: Packing):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, room = _ids(p.tokenizer, p.cache), np.array([p.end_id], "<u4").tobytes(), 4 * p.capacity
        for rows in steps(batches):
            out = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), ids_of([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                ids += end
                out += [(doc_id, at // room, at // 4, len(ids[at : at + room]) // 4, zlib.crc32(ids[at : at + room])) for at in range(0, len(ids), room)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)

    return emit


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: lines (length, first rank, how many, first sequence, offset), sorted."""
    full: list[tuple[int, tuple]] = []  # (how many sequences, chain of lengths)
    room: dict[int, list[list]] = {}  # free tokens -> [[how many, chain], ...]
    free: list[int] = []

    def add(left: int, n: int, chain: tuple) -> None:
        if left == 0:
            full.append((n, chain))
            return
        if left not in room:
            room[left] = []
            insort(free, left)
        room[left].append([n, chain])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                fit = capacity // length
                chain: tuple = ()
                for _ in range(min(fit, n)):
                    chain = (chain, length)
                k = min(fit, n)
                add(capacity - k * length, n // k, chain)
                n -= n // k * k
                continue
            left = free[at]
            group = room[left][-1]
            take = min(n, group[0])
            group[0] -= take
            if not group[0]:
                room[left].pop()
                if not room[left]:
                    del room[left], free[at]
            add(left - length, take, (group[1], length))
            n -= take
    lines, used, first = [], dict.fromkeys(histogram, 0), 0
    for n, chain in full + [(g[0], g[1]) for left in free for g in room[left]]:
        lengths = []
        while chain:
            chain, length = chain
            lengths.append(length)
        offset = 0
        for length in reversed(lengths):
            lines.append((length, used[length], n, first, offset))
            used[length] += n
            offset += length
        first += n
    return sorted(lines)


def _slots(lines: np.ndarray):
    """Adds sequence_id and offset by a search in the plan."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lines.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for rows in batches:
            length, rank = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            line = table[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in _PIECES), pa.array(line[:, 3] + rank - line[:, 1]), pa.array(line[:, 4])], names=[*_PIECES.names, "sequence_id", "offset"])

    return emit


@tidy
def pack(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(p), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    # at most `capacity` rows reach the driver, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = spark.sparkContext.broadcast(np.array(plan(histogram, p.capacity), np.int64).reshape(-1, 5))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", "start", "ids_crc32")]
    placed = ranked(pieces, ["length"], order, "_rank", F.xxhash64("doc_id", "piece"))
    return placed.mapInArrow(_slots(lines), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
