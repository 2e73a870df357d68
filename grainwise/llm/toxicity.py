"""Toxicity of texts after noisy-channel deobfuscation.

Words written around a filter (look-alike characters, letters spaced or dotted out,
stretched letters) form a lattice of what each character may stand for: itself, a letter
it looks like, or nothing (a separator, a repeat).  A Viterbi search finds the reading
with the highest product of channel and character-model probability; the character model
is a trigram model of the letters of all documents.  Stretches are of any length: paths
share their beginnings.  Words without any such mark have one reading, themselves, and skip
the search; so do numbers, words of digits and separators alone.  The restored text's words and word beginnings
are then scored by a model learnt from labelled rows: each feature's rate of toxic
documents (its lower confidence bound) is combined by noisy-or.

Labels are learnt from at most ``fit_rows`` labelled rows, those with the smallest hash;
everything else sees all documents, whole.

Defined results: a null text is the empty text; a text without any feature gets the rate
of toxic documents among labelled texts without features (0 without labels); repeated rows
are scored each; of several labels for a doc_id each counts; null labels count not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import as_row, prepare, row_columns
from ._words import U64, Batch, lower_ascii, mix, steps, text_bytes

# Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h"}
SEPARATORS = " .-_*'~^,/\\"
PUNCTUATION = "!|(<#+"  # look-alikes that may also mean nothing


@dataclass(frozen=True)
class Toxicity:
    fit_rows: int = 20_000
    threshold: float = 0.7
    least_documents: int = 5
    confidence: float = 3.0  # standard errors of the lower bound
    prefixes: tuple[int, ...] = (4, 5, 6)
    swap: float = np.log(0.15)  # a look-alike for its letter
    skip: float = np.log(0.2)  # a separator within a word
    repeat: float = np.log(0.3)  # a letter written again
    boundaries: tuple[float, ...] = (np.log(0.2), 0.0)  # a separator between words; there is a reading for each, and one without
    cache: int = 200_000


LETTERS = 28  # boundary, a-z, any other letter
_CLASS = np.full(256, -1, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC0:] = 27
_SEPARATES = np.ones(256, bool)
_SEPARATES[97:123] = False
_SEPARATES[128:] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in LOOKALIKES if not c.isdigit()]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS if c != " "]] = True


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the letters of all words, one row for each that a task met."""
    total = np.zeros(LETTERS**3, np.int64)
    for rows in steps(batches):
        data, offsets = text_bytes(rows.column("text"))
        data = lower_ascii(data)
        cls = np.where((data >= 0x80) & (data < 0xC0), -2, _CLASS[data])
        mark = np.zeros(len(data), bool)
        mark[offsets[1:-1][offsets[1:-1] < len(data)]] = True
        keep = cls != -2
        x = np.where(cls[keep] < 0, 0, cls[keep])
        if not len(x):
            continue
        x = np.insert(x, np.flatnonzero(mark[keep]), 0)
        x = np.concatenate([[0], x, [0]])
        x = x[(x > 0) | np.append(x[1:] > 0, True) | np.insert(x[:-1] > 0, 0, False)]
        before = np.where(x[:-1] == 0, 0, np.insert(x[:-2], 0, 0))  # nothing is remembered across a boundary
        total += np.bincount((before * LETTERS + x[:-1]) * LETTERS + x[1:], minlength=LETTERS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def letter_model(texts: DataFrame) -> np.ndarray:
    """ln P(letter | two before), smoothed; at most 28**3 counts reach the driver."""
    counts = texts.mapInArrow(_count_letters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LETTERS**3)
    for r in counts:
        n[r["gram"]] = r["n"]
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    pair = (n.sum(axis=0) + 1) / (n.sum(axis=(0, 1))[None, :].sum() / LETTERS + 1)
    pair = pair / pair.sum(axis=1, keepdims=True)
    return np.log((n + 5 * pair[None]) / (n.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Viterbi decoding of a stretch of characters: its different readings, with a space between."""

    def __init__(self, model: np.ndarray, p: Toxicity):
        self.source, self.model, self.p, self.known = model, model.tolist(), p, {}

    def __call__(self, stretch: str) -> str:
        got = self.known.get(stretch)
        if got is None:
            if len(stretch) > 64:  # long ones seldom come again
                return self.readings(stretch)
            if len(self.known) >= self.p.cache:
                self.known.clear()
            got = self.known[stretch] = self.readings(stretch)
        return got

    def readings(self, stretch: str) -> str:
        apart = any(c in SEPARATORS or c.isspace() for c in stretch)
        return " ".join(dict.fromkeys(self.decode(stretch, x) for x in (None, *(self.p.boundaries if apart else ()))))

    def decode(self, stretch: str, boundary: float | None = None) -> str:
        p, model = self.p, self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two classes -> (ln P, (reading before, letter))
        for i, c in enumerate(stretch):
            readings = [(c, 0.0)] if "a" <= c <= "z" or c > "\x7f" and c.isalpha() else [(x, p.swap) for x in LOOKALIKES.get(c, "")]
            nothing = p.skip if c in SEPARATORS else (p.repeat if i and c == stretch[i - 1] else None)
            if not readings and nothing is None or c in PUNCTUATION:
                nothing = p.skip
            ends = boundary is not None and (c in SEPARATORS or c.isspace())
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in states.items():
                row = model[a][b]
                for x, cost in readings:
                    k = ord(x) - 96 if "a" <= x <= "z" else 27
                    s = score + cost + row[k]
                    if (b, k) not in new or new[b, k][0] < s:
                        new[b, k] = (s, (text, x))
                if ends and b:
                    s = score + boundary + row[0]
                    if (0, 0) not in new or new[0, 0][0] < s:
                        new[0, 0] = (s, (text, " "))
                if nothing is not None and ((a, b) not in new or new[a, b][0] < score + nothing):
                    new[a, b] = (score + nothing, text)
            states = new
        _, _, text = max(((s + model[a][b][0], (a, b), text) for (a, b), (s, text) in states.items()), key=lambda x: x[:2])
        out = []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out))


def stretches(batch: Batch) -> list[tuple[int, int, int]]:
    """(document, first byte, end) of what may be obfuscated; ``batch`` is lower-cased, with words between white space."""
    data, a, b = batch.data, batch.starts, batch.ends
    if not len(a):
        return []
    letter = (_CLASS[data] > 0) & (data < 0xC0) | (data >= 0x80)
    symbol = _SYMBOL[data]
    mark = letter | _DIGIT[data] | symbol
    apart = np.flatnonzero(_APART[data])
    word = np.searchsorted(a, apart, "right") - 1
    marks = np.concatenate([[0], np.cumsum(mark)])
    within = (word >= 0) & (apart < b[word])
    apart, word = apart[within], word[within]
    apart_n = np.bincount(word[(marks[apart] > marks[a[word]]) & (marks[b[word]] > marks[apart])], minlength=len(a))
    same = np.zeros(len(data), bool)
    same[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 0x80)
    same[a] = False

    def per_word(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[b] - sums[a]

    letters, symbols = per_word(letter), per_word(symbol)
    odd = (letters > 0) & ((per_word(_DIGIT[data] | symbol) > 0) | (apart_n > 0) | (per_word(same) > 0)) | (symbols > 0) & (per_word(mark) > 2)
    doc = batch.doc
    found = [(int(doc[i]), int(a[i]), int(b[i])) for i in np.flatnonzero(odd)]
    single = (b - a == 1) & (letter[a] | _DIGIT[data[a]] | _SYMBOL[data[a]])
    edge = np.diff(np.concatenate([[False], single, [False]]).astype(np.int8))
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        cuts = [i, *(np.flatnonzero(doc[i + 1 : j] != doc[i : j - 1]) + i + 1), j]
        found += [(int(doc[x]), int(a[x]), int(b[y - 1])) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= 3]
    return found


_last: list[Restorer] = []


def restorer_of(model: np.ndarray, p: Toxicity) -> Restorer:
    """The worker's restorer for this model, with what it has read before."""
    if not _last or _last[0].source is not model or _last[0].p != p:
        _last[:] = [Restorer(model, p)]
    return _last[0]


def features(rows: pa.RecordBatch, restorer: Restorer, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, word) of the restored texts: words themselves, and beginnings of words."""
    data, offsets = text_bytes(rows.column("text"))
    data = lower_ascii(data)
    extra: dict[int, list[str]] = {}
    for d, a, b in stretches(Batch(data, offsets)):
        extra.setdefault(d, []).append(restorer(data[a:b].tobytes().decode("utf-8", "replace")))
    again = text_bytes(pa.array([" ".join(extra[d]) for d in sorted(extra)], pa.string()))
    docs, found, words = [], [], []
    for (raw, where), names in (((data, offsets), np.arange(rows.num_rows)), (again, np.array(sorted(extra), np.int64))):
        batch = Batch(raw, where, _SEPARATES)
        doc = names[batch.doc] if len(names) else batch.doc
        for k in (0, *p.prefixes):
            use = slice(None) if k == 0 else batch.ends - batch.starts >= k
            a = batch.starts[use]
            h = batch.word_hash if k == 0 else batch.beginnings_hash(a, k)
            docs.append(doc[use])
            words.append(batch.word_hash[use].view(np.int64))
            found.append(mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64))
    return np.concatenate(docs), np.concatenate(found), np.concatenate(words)


def _pairs(shared, p: Toxicity):
    schema = pa.schema([("feature", pa.int64()), ("toxic", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(shared.value, p)
        for rows in steps(batches):
            doc, f, _ = features(rows, restorer, p)
            order = np.lexsort((f, doc))
            doc, f = doc[order], f[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(f[new]), rows.column("toxic").take(pa.array(doc[new]))], schema=schema)

    return emit


def _score(shared, p: Toxicity, kept: list[str]):
    """The columns ``kept`` of (row, text) with the score of the text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, weight, base = shared.value
        restorer = restorer_of(model, p)
        for rows in steps(batches):
            score = np.zeros(rows.num_rows)
            if len(known):
                doc, f, word = features(rows, restorer, p)
                i = np.minimum(np.searchsorted(known, f), len(known) - 1)
                hit = np.flatnonzero(known[i] == f)
                if len(hit):  # a word counts once, with its strongest feature
                    doc, word, w = doc[hit], word[hit], weight[i[hit]]
                    order = np.lexsort((w, word, doc))
                    doc, word, w = doc[order], word[order], w[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
                    score = np.bincount(doc[new], w[new], rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(1 - (1 - base) * np.exp(score))], names=[*kept, "score"])

    return emit


@dataclass(frozen=True)
class Model:
    """The character model, feature hashes, ln(1 - rate) of each, and the rate of texts without features."""

    letters: np.ndarray
    known: np.ndarray
    weight: np.ndarray
    base: float


def fit(docs: DataFrame, labels: DataFrame, use: Column, p: Toxicity = Toxicity()) -> Model:
    """Learns from the labels (doc_id, toxic) of rows where ``use`` (of doc_id) holds."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    letters = letter_model(texts.select("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & use)
    sample = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(p.fit_rows))
    shared = spark.sparkContext.broadcast(letters)
    fitted = texts.join(sample, "doc_id").select("text", "toxic")
    rates = fitted.groupBy("toxic").count().collect()
    rows, toxic = sum(r["count"] for r in rates), sum(r["count"] for r in rates if r["toxic"])
    counts = fitted.mapInArrow(_pairs(shared, p), "feature long, toxic int").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    # features of at least `least_documents` of the sampled texts, most of them toxic
    table = counts.filter((F.col("n") >= p.least_documents) & (F.col("k") > 0.5 * F.col("n"))).toPandas().sort_values("feature")
    n, k, z = table["n"].to_numpy(float), table["k"].to_numpy(float), p.confidence
    rate = (k + z * z / 2) / (n + z * z) - z / (n + z * z) * np.sqrt(k * (n - k) / np.maximum(n, 1) + z * z / 4)
    kept = rate > max(0.3, 2 * toxic / max(rows, 1) if toxic < rows / 4 else 0.3)
    known, weight = table["feature"].to_numpy(np.int64)[kept], np.log1p(-np.minimum(rate[kept], 1 - 1e-9))
    model = Model(letters, known, weight, 0.0)
    if rows and len(known):
        bare = score(fitted, model, p, ["toxic"]).filter("score <= 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
        base = bare["k"] / max(bare["n"], 1)
    else:
        base = toxic / max(rows, 1)
    return Model(letters, known, weight, float(base))


def _scored(docs: DataFrame, model: Model, p: Toxicity, columns: list[str], with_text: bool) -> DataFrame:
    """(row, text if asked for, score): the named columns as a struct, which nothing can clash with."""
    shared = docs.sparkSession.sparkContext.broadcast((model.letters, model.known, model.weight, model.base))
    rows = docs.select(as_row(docs.select(*(F.col(f"`{c}`") for c in columns))) if columns else F.struct(F.lit(0).alias("none")).alias("row"), "text")
    kept = ["row", *["text"] * with_text]
    return rows.mapInArrow(_score(shared, p, kept), rows.select(*kept).schema.add("score", "double"))


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row (doc_id by default) with its score in [0, 1], in place of a column ``score`` if there is one."""
    names = [c for c in keep or ["doc_id"] if c.lower() != "score"]
    return _scored(docs, model, p, names, False).select(*(F.col("row")[c].alias(c) for c in names), "score")


def below_threshold(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """``docs``, all its columns, without the rows that score the threshold or more."""
    scored = _scored(docs, model, p, [c for c in docs.columns if c != "text"], True)
    return scored.filter(F.col("score") < p.threshold).select(*row_columns(docs, text=F.col("text")))
