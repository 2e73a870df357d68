"""Removal of repeated passages: seeds on winnowed anchors, extended to maximal repeats.

Of documents with one text the first is taken for all; a later one loses every word that
lies in a window, that is all of them if it is as long as one.

A window is ``threshold`` consecutive words.  Seeds: of each window's runs of ``seed``
words the one with the smallest hash (the first of equals) is the window's anchor; equal
windows hence have equal anchors at equal places, and about one run in five is an anchor.
Documents are joined on anchors: an anchor that only one text has can't lie in a repeat
and is dropped.  Every window that chose one of the anchors left is matched with its first
holder (smallest doc_id, then first place) by 128 bits of its content, so a passage that
thousands of documents share costs a row for each place instead of a row for each two
places.  Matches extend both ways: windows that follow each other in a document and in the
same holder are one repeat, as long as it goes (``repeats``).  The words of windows that
an earlier document also has are removed.  The 128 bits are two hashes made apart from the
bytes of the words; texts are not compared again.

A frequent anchor or window goes to as many tasks as it has parts of 1/2000 of the rows.

Defined results: a null text has no words; a document with fewer than ``threshold`` words
loses nothing; rows with one doc_id are one source (they take nothing from each other, and
each loses what earlier documents have); a null doc_id comes before all others; further
columns of any name pass through; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import as_row, prepare, row_columns, salted_join, tidy, written
from ._words import Batch, steps, text_bytes

_TO_SPACE = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))

#: Stands for all windows of a document.
EVERY = -1

#: Stands for a null doc_id.
NO_ID = -(2**63)


@dataclass(frozen=True)
class SubstringDedup:
    threshold: int = 13
    seed: int = 5

    def __post_init__(self):
        if not 1 <= self.seed <= self.threshold:
            raise ValueError("seed must lie between 1 and threshold")


def anchored(batch: Batch, p: SubstringDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, word at which its anchor starts, hash of the anchor) of every window."""
    span = p.threshold - p.seed + 1
    n = np.maximum(batch.counts - p.threshold + 1, 0)
    at = np.repeat(batch.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc = np.repeat(np.arange(batch.n_docs), n)
    if not len(at):
        return at, doc, at, at.astype(np.uint64)
    h = batch.runs_hash(p.seed)
    best, where = h[at], at.copy()
    for j in range(1, span):
        other = h[at + j]
        less = other < best
        best[less], where[less] = other[less], at[less] + j
    return at, doc, where, best


def _anchors(p: SubstringDedup):
    schema = pa.schema([("anchor", pa.int64()), ("text_key", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches):
            _, doc, where, h = anchored(Batch(*text_bytes(rows.column("text"))), p)
            first = np.ones(len(where), bool)
            first[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), rows.column("text_key").take(pa.array(doc[first]))], schema=schema)

    return emit


def _windows(p: SubstringDedup):
    """For each document and its repeated anchors: the windows around these anchors."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("ordinal", pa.int32()), ("start", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches):
            batch = Batch(*text_bytes(rows.column("text")))
            at, doc, _, h = anchored(batch, p)
            # an anchor that any document of the step repeats is one that others have, too
            keep = np.isin(h, rows.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            at, doc = at[keep], doc[keep]
            sums = [batch.runs_hash(p.threshold, i)[at].view(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1]), rows.column("doc_id").take(pa.array(doc)), rows.column("ordinal").take(pa.array(doc)), pa.array((at - batch.first[doc]).astype(np.int32))], schema=schema)

    return emit


def _cutter(p: SubstringDedup, schema: pa.Schema):
    """The rows (``row``, or doc_id only) with what is kept of the text, if that is in the schema, counts and digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches):
            data, offsets = text_bytes(rows.column("text"))
            batch, found = Batch(data, offsets), rows.column("matches")
            gone, digests, texts = [], [], []
            for d in range(rows.num_rows):
                own = slice(batch.first[d], batch.first[d + 1])
                n, at = own.stop - own.start, found[d].values
                drop = covered(at.field("start").to_numpy(zero_copy_only=False), n, p.threshold) if at is not None and len(at) else np.zeros(n, bool)
                raw, begin = data[offsets[d] : offsets[d + 1]].tobytes(), offsets[d]
                words = raw.translate(_TO_SPACE).split(b" ") if not drop.any() else [raw[a:b] for a, b in zip((batch.starts[own][~drop] - begin).tolist(), (batch.ends[own][~drop] - begin).tolist(), strict=True)]
                gone.append(int(drop.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w in words if w)).hexdigest())
                texts.append(without(raw, batch.starts[own] - begin, drop) if gone[-1] and "kept" in schema.names else None)
            made = {"row": rows.column("row"), "kept": texts, "n_words": batch.counts, "n_removed": gone, "kept_sha256": digests}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name == "row" else pa.array(made[f.name], f.type) for f in schema], names=schema.names)

    return cut


def without(raw: bytes, starts: np.ndarray, drop: np.ndarray) -> str:
    """The text without the marked words and the white space after each; the rest stands as it was."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]]).astype(np.int8)))  # kept runs: from edge to edge
    places = np.append(starts, len(raw))
    pieces = [raw[places[a] : places[b]] for a, b in edge.reshape(-1, 2)]
    if len(drop) and not drop[0]:
        pieces.insert(0, raw[: places[0]])
    return b"".join(pieces).decode("utf-8")


_TEXT_KEYS = ("_k0", "_k1", "_k2")


def _keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [k.alias(n) for k, n in zip((F.xxhash64(text), F.crc32(F.encode(text, "utf-8")), F.octet_length(text).cast("long")), _TEXT_KEYS, strict=True)]


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("_id")


def matches(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """(_id, text keys, matches): windows of each document that an earlier one also has, as (start, source, source_start); [EVERY] for a later copy."""
    prepare(docs.sparkSession)
    texts = docs.select(_id(F.col("doc_id")), *_keys(F.col("text")), "text")
    ids = written(texts.drop("text"))
    firsts = written(ids.groupBy(*_TEXT_KEYS).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n_left")))
    every = F.array(F.struct(F.lit(EVERY).alias("start"), F.col("first").alias("source"), F.lit(0).alias("source_start")))
    copies = salted_join(ids, firsts.filter("n_left > 1"), list(_TEXT_KEYS), F.xxhash64("_id")).filter("first < _id").select("_id", *_TEXT_KEYS, every.alias("matches")).distinct()

    seeds = texts.select(F.col("_k0").alias("text_key"), "text").mapInArrow(_anchors(p), "anchor long, text_key long")
    shared = seeds.groupBy("anchor").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count(F.lit(1)).alias("n_left")).filter("lo < hi").select("anchor", "n_left")
    by_text = salted_join(seeds, written(shared), ["anchor"], F.monotonically_increasing_id(), "left_semi").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    order = Window.partitionBy("first").orderBy(*_TEXT_KEYS)
    chosen = by_text.join(firsts, by_text["text_key"] == firsts["_k0"]).select(*_TEXT_KEYS, F.col("first").alias("_id"), (F.row_number().over(order) - 1).alias("ordinal"), "anchors")
    chosen = written(chosen)
    unique = texts.join(chosen, ["_id", *_TEXT_KEYS]).select(F.col("_id").alias("doc_id"), "ordinal", "text", "anchors")
    windows = written(unique.mapInArrow(_windows(p), "a long, b long, doc_id long, ordinal int, start int"))
    first = F.min(F.struct(F.col("doc_id").alias("source"), "ordinal", F.col("start").alias("source_start"))).alias("f")
    sources = windows.groupBy("a", "b").agg(first, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_left")).filter("f.source < last")
    sources = written(sources.select("a", "b", "f.source", "f.source_start", "n_left"))
    later = salted_join(windows, sources, ["a", "b"], F.xxhash64("doc_id", "start")).filter("source < doc_id")
    found = later.groupBy(F.col("doc_id").alias("_id"), "ordinal").agg(F.collect_set(F.struct("start", "source", "source_start")).alias("matches"))
    marks = found.join(chosen.select("_id", "ordinal", *_TEXT_KEYS), ["_id", "ordinal"]).select("_id", *_TEXT_KEYS, "matches")
    return written(marks.unionByName(copies))


def covered(starts: np.ndarray, n_words: int, threshold: int) -> np.ndarray:
    """Which of a document's words lie in one of the windows."""
    if len(starts) and starts[0] == EVERY:
        return np.full(n_words, n_words >= threshold)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + threshold, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])


def extended(found: list[dict], n_words: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(start, length, source, source_start): matched windows that follow each other in both documents, as one repeat each."""
    out: list[list[int]] = []
    for m in sorted(found, key=lambda m: (m["source"], m["start"] - m["source_start"], m["start"])):
        if m["start"] == EVERY:
            return [(0, n_words, m["source"], 0)] if n_words >= threshold else []
        last = out[-1] if out else None
        if last and last[2] == m["source"] and m["start"] - last[0] == m["source_start"] - last[3] and m["start"] == last[0] + last[1] - threshold + 1:
            last[1] += 1
        else:
            out.append([m["start"], threshold, m["source"], m["source_start"]])
    return sorted(map(tuple, out))


def _spans(p: SubstringDedup):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, n_words, found = (rows.column(c).to_pylist() for c in ("_id", "n_words", "matches"))
            out = [(None if i == NO_ID else i, *x) for i, n, f in zip(ids, n_words, found, strict=True) for x in extended(f, n, p.threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SPANS)], schema=_SPANS)

    return emit


@tidy
def repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """doc_id, start, length, source, source_start: the maximal repeats (in words) of at least ``threshold`` words of each document with the first holder of their windows."""
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("n_words")
    sizes = docs.select(_id(F.col("doc_id")), *_keys(F.col("text")), n_words).distinct()
    marks = matches(docs, p).join(sizes, ["_id", *_TEXT_KEYS])
    return marks.select("_id", "n_words", "matches").mapInArrow(_spans(p), "doc_id long, start int, length int, source long, source_start int")


def _cut(docs: DataFrame, p: SubstringDedup, keep_text: bool) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256) of the rows, or with ``kept`` too: what is left of a text that lost something."""
    marks = matches(docs, p)
    row = as_row(docs) if keep_text else as_row(docs.select("doc_id"))
    keyed = docs.select(row, "text", _id(F.col("doc_id")), *_keys(F.col("text"))).join(marks, ["_id", *_TEXT_KEYS], "left")
    rows = keyed.select("row", "text", "matches")
    added = [("kept", pa.string())] * keep_text + [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = rows.select("row").schema
    for name, kind in added:
        schema = schema.add(name, "string" if kind == pa.string() else "long")
    return rows.mapInArrow(_cutter(p, pa.schema([("row", pa.null()), *added])), schema)


@tidy
def remove_repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of each row."""
    out = _cut(docs.select("doc_id", "text"), p, keep_text=False)
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@tidy
def without_repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup()) -> DataFrame:
    """``docs`` (all its columns; n_chars, if there, follows the text) with repeats cut out of the texts, whose other white space stays; a text that loses all its words goes."""
    cut = _cut(docs, p, keep_text=True).filter("n_removed = 0 or n_words > n_removed")
    lost = F.col("n_removed") > 0
    text = F.when(lost, F.col("kept")).otherwise(F.col("row")["text"])
    instead = {"text": text}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(lost, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return cut.select(*row_columns(docs, **instead))
