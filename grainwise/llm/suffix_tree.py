"""Log-probabilities of texts under a probabilistic suffix tree over their tokens.

Tokens are the lower-cased (A-Z) words of a text and one end; every word is a symbol of its
own.  A context is the run of tokens before a token, back to the end that a document starts
with at most.  A token's probability is that in the longest retained context; tokens that a
state has no entry for share what is left as they do in the state's parent, down to the
add-0.1 unigram, which has a share for unknown tokens.  A state's probabilities sum to 1.

1. Words of the training documents are counted by grouped aggregation over the corpus.
2. Level by level, next tokens are counted for the contexts seen ``least`` times whose parent
   (the context without its oldest token) is retained; next tokens seen ``entry`` times in a
   context get an entry.  Both floors are numbers of sightings, the same for every size of the
   input, so that no evidence counts in a small corpus that would not in a large one.
3. A context is retained if it passes a divergence test against its parent: tokens x
   Kullback-Leibler divergence must exceed half the number of its entries times the
   logarithm of its tokens.  Growth ends at the first level that retains no context.
4. Next-token distributions are smoothed with the parent's (Witten-Bell).
5. A text's score adds up one value for each of its runs of tokens: ln of the factor that a
   run brings as a state, plus what its last token gains by an entry after the others.

A task passes its counts on packed by parts of the runs, which other tasks add up; no row is made
for a run that is seen less than ``entry`` times.  The 2**20 - 1 most frequent words go by number there,
in runs of four tokens at most; all others go by hash.  Counts, states and entries are distributed
tables, joined by hashes of their runs.  The most frequent runs, ``frequent`` at most, go to the
scoring tasks as a table of 24 bytes each.  For rarer ones a chunk of documents asks the tables' parts,
once for each hash that it has, so that no word is a frequent key; the answers come back to what the
chunk has kept of its documents.  Bit tables of a fixed size keep runs that no table has from being
shuffled; they only ever let too much pass.

Runs are told apart by 64-bit hashes, in the joins and when counts are added up.  Defined results: a null
text is the empty text, whose only token is its end; rows that share a doc_id are scored
each; with no training documents every count is 0 and there is only the uniform root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, tidy, written
from ._words import U64, Batch, joined_hash, lower_ascii, mix, steps, text_bytes


@dataclass(frozen=True)
class SuffixTree:
    least: int = 32  # sightings of a context
    entry: int = 8  # of a token in a context
    share: float = 1e-5  # of the training tokens; what ``floors`` proposes, a model takes ``least`` and ``entry``
    entry_share: float = 5e-7
    frequent: int = 1_000_000  # runs that go to the scoring tasks as a table, the most frequent ones
    base_add: float = 0.1

    def floors(self, n_train: int) -> tuple[int, int]:
        """``least`` and ``entry`` to choose for a small corpus, at most those given here; no model takes them by itself."""
        return tuple(max(1, min(most, int(np.ceil(part * n_train)))) for most, part in ((self.least, self.share), (self.entry, self.entry_share)))


END = 0x5851F42D4C957F2D
_BITS = 27  # of the places in a bit table: 16 MB


def _batch(rows: pa.RecordBatch) -> Batch:
    data, offsets = text_bytes(rows.column("text"))
    return Batch(lower_ascii(data), offsets)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the values, and where each run of equal ones begins in it."""
    order = np.argsort(values)
    s = values[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def sequence(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all documents, an end before and after each, and the document of each."""
    n = batch.counts + 2
    out, is_word = np.full(n.sum(), U64(END)), np.ones(n.sum(), bool)
    last = np.cumsum(n) - 1
    is_word[last] = is_word[last - n + 1] = False
    out[is_word] = batch.word_hash
    return out, np.repeat(np.arange(batch.n_docs), n)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of ``h``; at most 2**_BITS / 64 rows reach the driver."""
    place = F.shiftrightunsigned("h", 64 - _BITS)
    rows = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def may_have(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> U64(64 - _BITS)
    return (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) != 0


_GRAMS_SQL = "ctx long, suf long, is_context boolean, n long, h long"
_GRAMS = pa.schema([("ctx", pa.int64()), ("suf", pa.int64()), ("is_context", pa.bool_()), ("n", pa.int64()), ("h", pa.int64())])
_PARTS_OF_COUNTS = pa.schema([("part", pa.int32()), ("is_context", pa.bool_()), ("counts", pa.binary())])
_HELD = 700_000  # different runs that a task counts before it passes them on
_CODE_BITS = 20  # of the number of a frequent word
_OTHER = U64((1 << _CODE_BITS) - 1)  # the member that stands for all next tokens that can't get an entry; among hashes 0 does
_CODED = 3  # tokens of a context that are sent as numbers, which fit 64 bits
_PARTS_SQL = "part int, is_context boolean, counts binary"


_SLOT = U64(43)  # of a hash, the bits below those that give its slot


class Codes:
    """Places of hashes in an array, found by their highest bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.code = np.argsort(hashes)
        self.sorted = np.append(hashes[self.code], U64(0))
        self.code = np.append(self.code, 0)
        self.first = np.zeros((1 << 64 - int(_SLOT)) + 1, np.int32)
        np.cumsum(np.bincount((self.sorted[:-1] >> _SLOT).astype(np.int64), minlength=1 << 64 - int(_SLOT)), out=self.first[1:])

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it has one."""
        slot = (h >> _SLOT).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        known = (self.sorted[at] == h) & (at < end)
        left = np.flatnonzero((at + 1 < end) & ~known)
        while len(left):
            at[left] += 1
            known[left] = self.sorted[at[left]] == h[left]
            left = left[~known[left]]
            left = left[at[left] + 1 < end[left]]
        return self.code[at], known


class _Counts:
    """Counts of runs of one kind as (group, member): equal pairs are added up by both, or by the hash of both where they don't fit 64 bits.

    ``d`` is the number of the group's tokens that are written as numbers, 0 for hashes.
    """

    def __init__(self, d: int = 0) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.d = 0, d

    def put(self, group: np.ndarray, member: np.ndarray, n: np.ndarray | None = None) -> None:
        self.held.append((group, member, np.ones(len(group), np.int64) if n is None else n))
        self.size += len(group)

    def merged(self) -> tuple[np.ndarray, ...]:
        group, member, n = (np.concatenate([x[i] for x in self.held]) if self.held else np.zeros(0, t) for i, t in enumerate((np.uint64, np.uint64, np.int64)))
        self.held.clear()
        order, at = _runs((group << U64(_CODE_BITS)) | member if 0 < self.d < _CODED else joined_hash(group, member))
        n = np.add.reduceat(n[order], at) if len(at) else n
        first = order[at]
        self.held, self.size = [(group[first], member[first], n)], len(first)
        return self.held[0]

    def clear(self) -> None:
        self.held, self.size = [], 0


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers by their bytes, the highest of which are mostly 0 and take no room once compressed."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplaned(raw, at: int, k: int, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * k, at).reshape(width, k).T).view(f"<u{width}")[:, 0]


def _growing(x: np.ndarray) -> bytes:
    """Numbers in ascending order by their differences, 8 bytes each before they are compressed."""
    return _planes(np.diff(x, prepend=U64(0)), 8)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal width by the highest bits, so that a part's hashes lie close to each other."""
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


_ZSTD = pa.Codec("zstd", 1)


def _squeezed(raw: bytes) -> bytes:
    """Compressed, with the length before it."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unsqueezed(raw: memoryview) -> memoryview:
    return memoryview(_ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little")))


def _packed(counts: tuple[np.ndarray, ...], parts: int, d: int = 0, whole: bool = False) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of counts: a group once for its members.  A pair goes to one part; a group's members to eight at most, if ``whole`` to one."""
    group, member, n = counts
    slice_of = U64(0) if whole else (member & U64(7) if d else member >> U64(61))
    part = (_part_of(mix(group) if d else group, parts) + slice_of * U64(0x9E3779B1)) % U64(parts)
    if d:
        order = np.argsort(group) if d == _CODED else np.arange(len(group))  # of fewer tokens they are in order by now
        order = order[np.argsort(part[order].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
    else:
        order = np.argsort((part << U64(40)) | (group >> U64(24)))
    group, member, n, part = group[order], member[order], n[order], part[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (group[1:] != group[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(part)))
    cuts = np.flatnonzero(np.diff(part[starts].astype(np.int64), prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(part)
        head, groups = np.array([d, b - a, hi - lo], "<u4").tobytes(), group[starts[a:b]]
        members = _planes(member[lo:hi]) if d else member[lo:hi].tobytes()
        yield int(part[lo]), _squeezed(b"".join((head, _growing(groups), _planes(sizes[a:b]), members, _planes(n[lo:hi]))))


def _unpacked(squeezed: memoryview) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_packed`` has written: d, groups, members, counts."""
    raw = _unsqueezed(squeezed)
    d, groups, rows = np.frombuffer(raw, "<u4", 3).tolist()
    at = 12
    group = np.cumsum(_unplaned(raw, at, groups, 8), dtype=np.uint64)
    at += 8 * groups
    sizes = _unplaned(raw, at, groups)
    at += 4 * groups
    member = _unplaned(raw, at, rows).astype(np.uint64) if d else np.frombuffer(raw, "<u8", rows, at)
    at += (4 if d else 8) * rows
    return d, np.repeat(group, sizes), member, _unplaned(raw, at, rows).astype(np.int64)


_COUNTS = pa.schema([("h", pa.int64()), ("n", pa.int64())])


def _by_part(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts in a sorted array."""
    cuts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    return list(zip(part[cuts].tolist(), cuts.tolist(), np.append(cuts, len(part))[1:].tolist(), strict=True))


def _count_words(parts: int):
    """Counts of the distinct words of a task, packed by parts of their hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order, at = _runs(h)
            held[:] = [(h[order[at]], np.add.reduceat(n[order], at) if len(at) else n)]
            return held[0]

        def passed() -> pa.RecordBatch:
            h, n = merged()
            held.clear()
            made = [(part, _squeezed(b"".join((np.array([to - at], "<u8").tobytes(), _growing(h[at:to]), _planes(n[at:to]))))) for part, at, to in _by_part(_part_of(h, parts))]
            return pa.RecordBatch.from_arrays([pa.array([part for part, _ in made], pa.int32()), pa.array([False] * len(made), pa.bool_()), pa.array([raw for _, raw in made], pa.binary())], schema=_PARTS_OF_COUNTS)

        for rows in steps(batches):
            h = _batch(rows).word_hash
            held.append((h, np.ones(len(h), np.int64)))
            if sum(len(h) for h, _ in held) > 2 * _HELD and len(merged()[0]) > _HELD:
                yield passed()
        if held:
            yield passed()

    return emit


def _words_added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the words of a part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for rows in batches:
        for raw in rows.column("counts"):
            raw = _unsqueezed(memoryview(raw.as_buffer()))
            k = int(np.frombuffer(raw, "<u8", 1)[0])
            held.append((np.cumsum(_unplaned(raw, 8, k, 8), dtype=np.uint64), _unplaned(raw, 8 + 8 * k, k).astype(np.int64)))
    if held:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, at = _runs(h)
        h, n = h[order[at]].view(np.int64), np.add.reduceat(n[order], at)
        for lo in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)])], schema=_COUNTS)


def _grams(shared, d: int, parts: int):
    """Counts of runs of d + 1 tokens, as (run without the last, without the first); from level 3 on also of contexts.

    There a context's members are all that followed it, those that can't get an entry as one, so that its own count is their sum.
    Runs of frequent words go as the words' numbers, (run without the last, last); the others as hashes.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, entry_bits, *frequent = shared.value
        codes = Codes(frequent[0]) if frequent and d <= _CODED else None
        coded, entries, contexts = _Counts(d), _Counts(), _Counts()

        def passed(last: bool) -> Iterator[pa.RecordBatch]:
            for counts, is_context in ((coded, d > 2), (entries, False), (contexts, True)):
                if counts.size <= (0 if last else 2 * _HELD):
                    continue
                made = counts.merged()
                if last or counts.size > _HELD:
                    counts.clear()
                    part, raw = zip(*_packed(made, parts, counts.d, is_context), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([is_context] * len(part)), pa.array(raw, pa.binary())], schema=_PARTS_OF_COUNTS)

        for rows in steps(batches):
            tokens, doc = sequence(_batch(rows))
            parent = x = tokens
            for _ in range(d - 1):
                parent, x = x, joined_hash(x[:-1], x[1:])
            if len(x) < 2:
                continue
            whole = doc[: len(x) - 1] == doc[d:]  # x has runs of d tokens, the last of which starts no run of d + 1
            if d < 3:
                at = np.flatnonzero(whole & may_have(bits, x[:-1]))
                at = at[may_have(entry_bits, x[at + 1])]
                can = np.ones(len(at), bool)
            else:
                at = np.flatnonzero(whole & may_have(bits, parent[1 : len(x)]))
                can = may_have(entry_bits, x[at + 1])
            if codes:
                code, known = codes.of(tokens)
                code = code.astype(np.uint64)
                of_group = known[at]
                group = code[at]
                for j in range(1, d):
                    of_group = of_group & known[at + j]
                    group = (group << U64(_CODE_BITS)) | code[at + j]
                both = of_group & known[at + d]
                if d < 3:
                    coded.put(group[both], code[at[both] + d])
                    at, can = at[~both], can[~both]
                else:  # all that followed a context is counted in one way, so that its sum is known in one place
                    coded.put(group[of_group], np.where(both & can, code[at + d], _OTHER)[of_group])
                    rare = at[of_group & can & ~both]
                    entries.put(x[rare], x[rare + 1])
                    at, can = at[~of_group], can[~of_group]
            if d < 3:
                entries.put(x[at], x[at + 1])
            else:
                contexts.put(x[at], np.where(can, x[at + 1], U64(0)))
            yield from passed(False)
        yield from passed(True)

    return emit


def _added_up(entry: int, shared=None):
    """The counts of a part from all tasks, of runs seen ``entry`` times: a context's and a suffix's hash, and the whole run's; contexts have no suffix."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[bool, int], _Counts] = {}
        most: dict[tuple[bool, int], int] = {}
        for rows in batches:
            for is_context, raw in zip(rows.column("is_context").to_pylist(), rows.column("counts"), strict=True):
                d, *got = _unpacked(memoryview(raw.as_buffer()))
                counts = kinds.setdefault((is_context, d), _Counts(d))
                counts.put(*got)
                if counts.size > 2 * most.get((is_context, d), _HELD):
                    counts.merged()
                    most[is_context, d] = max(_HELD, counts.size)

        def made(ctx: np.ndarray, suf: np.ndarray, is_context: bool, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(suf.view(np.int64)), pa.array(np.full(len(ctx), is_context)), pa.array(n), pa.array(h.view(np.int64))], schema=_GRAMS)

        def hashes(d: int, group: np.ndarray) -> list[np.ndarray]:
            word = shared.value[2]
            return [word[((group >> U64(_CODE_BITS * (d - 1 - j))) & _OTHER).astype(np.int64)] for j in range(d)]

        def joined(run: list[np.ndarray]) -> np.ndarray:
            while len(run) > 1:
                run = [joined_hash(a, b) for a, b in zip(run, run[1:], strict=False)]
            return run[0]

        for (is_context, d), counts in kinds.items():
            group, member, n = counts.merged()
            counts.clear()
            if is_context:
                order, at = _runs(group)
                size = np.add.reduceat(n[order], at) if len(at) else n
                use = np.flatnonzero(size >= entry)
                for some in np.split(use, range(1 << 16, len(use), 1 << 16)):
                    ctx = group[order[at[some]]]
                    ctx = joined(hashes(d, ctx)) if d else ctx
                    yield made(ctx, np.zeros(len(ctx), np.uint64), True, size[some], ctx)
            use = np.flatnonzero((n >= entry) & (member != (_OTHER if d else U64(0))))
            for at in np.split(use, range(1 << 16, len(use), 1 << 16)):
                a, b = group[at], member[at]
                if d:
                    run = [*hashes(d, a), shared.value[2][b.astype(np.int64)]]
                    a, b = joined(run[:-1]), joined(run[1:])
                yield made(a, b, False, n[at], joined_hash(a, b))

    return emit


def grow_tree(train: DataFrame, words: DataFrame, n_train: int, ends: int, v_total: float, p: SuffixTree) -> list[DataFrame]:
    """(h, n, value) of the runs that are states or have an entry, by level; ``words`` (h, n) has the end too."""
    spark, least, entry = train.sparkSession, p.least, p.entry
    tables: list[DataFrame] = []
    parts = max(8, -(-n_train // 1_000_000))  # of the counts: each has a million tokens' runs or so, whatever the input's size
    contexts = words.filter(F.col("n") >= least).select("h", F.col("n").alias("size"))
    below = words.filter(F.col("n") >= entry).select("h", ((F.col("n") + p.base_add) / v_total).alias("below"))
    named = words.filter(F.col("n") >= max(entry, _least_frequent(words, int(_OTHER)))).select("h", "n").toArrow()
    named = named["h"].to_numpy().view(np.uint64)[np.argsort(-named["n"].to_numpy())]
    retained, d = None, 0
    while True:
        d += 1
        bits = spark.sparkContext.broadcast((bit_table(contexts if d < 3 else retained), bit_table(below), *([named] if d <= _CODED else [])))
        counts = train.mapInArrow(_grams(bits, d, parts), _PARTS_SQL).repartitionById(parts, F.col("part"))
        counts = written(counts.mapInArrow(_added_up(entry, bits), _GRAMS_SQL))
        bits.destroy()
        if d >= 3:  # its entries' suffixes are entries of its parent, which is retained then
            contexts = counts.filter(F.col("is_context") & (F.col("n") >= least)).select(F.col("ctx").alias("h"), F.col("n").alias("size"))
        grams = counts.filter(~F.col("is_context")).select("h", "ctx", "suf", "n")
        both = written(grams.join(contexts.withColumnRenamed("h", "ctx"), "ctx").join(below.withColumnRenamed("h", "suf"), "suf"))
        sums = both.groupBy("ctx", "size").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("mass"), F.sum("below").alias("parent"),
            F.sum(F.col("n") * F.ln(F.col("n") / F.col("size") / F.col("below"))).alias("gain"),
        )
        rest = F.greatest(F.col("size") - F.col("mass"), F.lit(0))
        sums = sums.withColumn("parent", F.least("parent", F.lit(1 - 1e-9)))
        gain = F.col("gain") + F.when(rest > 0, rest * F.ln(F.greatest(rest, F.lit(1)) / F.col("size") / (1 - F.col("parent")))).otherwise(0.0)
        taken = (F.col("mass") + F.col("kinds") * F.col("parent")) / (F.col("size") + F.col("kinds"))
        left = F.ln(F.greatest(1 - taken, F.lit(1e-12)) / (1 - F.col("parent")))
        kept = written(sums.filter(gain > 0.5 * F.col("kinds") * F.ln(F.col("size") + 1.0)).select("ctx", "size", "kinds", left.alias("left")))
        if kept.isEmpty():
            return tables
        retained = kept.select(F.col("ctx").alias("h"))
        prob = (F.col("n") + F.col("kinds") * F.col("below")) / (F.col("size") + F.col("kinds"))
        entries = written(both.join(kept.drop("size"), "ctx").select("h", "n", prob.alias("p"), (F.ln(prob / F.col("below")) - F.col("left")).alias("value")))
        tables += [kept.select(F.col("ctx").alias("h"), F.col("size").alias("n"), F.col("left").alias("value")), entries.select("h", "n", "value")]
        below = entries.select("h", F.col("p").alias("below"))
        if d == 1:  # all runs of two tokens that may be contexts are counted; longer ones are counted with the next level
            end = END if END < 1 << 63 else END - (1 << 64)
            contexts = grams.filter((F.col("n") >= least) & (F.col("suf") != end)).join(retained.withColumnRenamed("h", "suf"), "suf", "left_semi").select("h", F.col("n").alias("size"))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double"
_PASSED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("raw", pa.binary())])
_PASSED_SQL = "part int, chunk long, kind int, raw binary"
_FEATURES, _ASKED, _STATE, _ANSWERS = range(4)


def _passed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PASSED, strict=True)], schema=_PASSED)


def _score_docs(shared, parts: int):
    """Chunks of documents: their state, with what frequent runs give and where rarer words (how often) and runs (-1) stand, and the hashes they ask each part for, once each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, n, value, bits, length, add, v_total = shared.value
        found, log_n = Codes(hot).of, np.log10((n + add) / v_total)
        heads: list[pa.RecordBatch] = []
        seen: list[tuple[np.ndarray, ...]] = []  # (document, hash, times)
        chunk, n_docs, size = 0, 0, 0

        def chunk_ends() -> Iterator[pa.RecordBatch]:
            doc, h, times = (np.concatenate(x) for x in zip(*seen, strict=True))
            order, at = _runs(h)
            doc, times, asked = doc[order], times[order], h[order[at]]
            cuts = _by_part(_part_of(asked, parts))
            head = pa.Table.from_batches(heads).combine_chunks().to_batches()[0].serialize().to_pybytes()
            sizes = np.array([len(head), len(cuts), len(asked), len(doc)], "<u4").tobytes()
            where = np.array([(part, to) for part, _, to in cuts], "<u4").tobytes()
            state = b"".join((sizes, head, where, _planes(np.diff(np.append(at, len(h)))), _planes(doc), _planes(times + 1)))
            yield _passed([(chunk % parts, chunk, _STATE, _squeezed(state)), *((part, chunk, _ASKED, _squeezed(_growing(asked[a:b]))) for part, a, b in cuts)])

        for rows in steps(batches):
            batch = _batch(rows)
            doc, word = batch.doc, batch.word_hash
            i, known = found(word)
            i, hot_doc = i[known], doc[known]
            base = np.bincount(hot_doc, log_n[i], batch.n_docs).astype(float)  # of no rows bincount gives integers
            gain = np.bincount(hot_doc, value[i], batch.n_docs).astype(float)
            n_known = np.bincount(hot_doc[n[i] > 0], minlength=batch.n_docs)
            rest_doc, rest = doc[~known], word[~known]
            order = np.lexsort((rest, rest_doc))
            rest_doc, rest = rest_doc[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])
            at = np.flatnonzero(new)
            docs, hashes, times = [rest_doc[at]], [rest[at]], [np.diff(np.append(at, len(rest)))]
            x, of = sequence(batch)
            place = np.arange(len(x) - 1)
            start = U64(END)
            for k in range(2, length + 1):  # runs of k tokens that start at ``place``; one is in the tables only if it is without its first token
                place = place[place + k <= len(of)]
                place = place[of[place] == of[place + k - 1]]
                x = joined_hash(x[:-1], x[1:])
                place = place[may_have(bits, x[place])]
                h = x[place]
                i, known = found(h)
                gain += np.bincount(of[place[known]], value[i[known]], batch.n_docs)
                docs.append(of[place[~known]])
                hashes.append(h[~known])
                times.append(np.full(len(docs[-1]), -1))
                alive = np.zeros(len(of) + 1, bool)
                alive[place] = True
                place = np.flatnonzero(alive[1:])
            i, known = found(np.array([start]))
            if known[0]:  # the end's value as a state
                gain = gain + value[i[0]]
            if not heads:
                chunk = rows.column("row")[0].as_py()
            heads.append(pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, (batch.counts + 1, n_known.astype(np.int64), base, gain))], schema=_SCORED))
            seen.append((np.concatenate(docs).astype(np.int64) + n_docs, np.concatenate(hashes), np.concatenate(times).astype(np.int64)))
            n_docs, size = n_docs + batch.n_docs, size + len(seen[-1][0])
            if size > _HELD:
                yield from chunk_ends()
                heads.clear()
                seen.clear()
                n_docs, size = 0, 0
        if heads:
            yield from chunk_ends()

    return emit


def _pack_features(parts: int):
    """Tables of (h, c, value) by parts of the hashes, packed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            h, c, value = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]).view(np.uint64) for i in range(3))
            order = np.argsort(h)
            h, c, value = h[order], c[order], value[order]
            held.clear()
            return _passed([(part, 0, _FEATURES, _squeezed(b"".join((np.array([to - at], "<u8").tobytes(), _growing(h[at:to]), _planes(c[at:to], 8), _planes(value[at:to], 8))))) for part, at, to in _by_part(_part_of(h, parts))])

        for rows in batches:
            if rows.num_rows:
                held.append(rows)
            if sum(b.num_rows for b in held) > _HELD:
                yield made()
        if held:
            yield made()

    return emit


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and value of each hash that a chunk asks a part for, in its order, 0 where there is none; states pass."""
    tables: list[tuple[np.ndarray, ...]] = []
    asked: list[tuple[int, int, memoryview]] = []
    for rows in batches:
        for part, chunk, kind, raw in zip(*(rows.column(i).to_pylist() for i in range(3)), rows.column("raw"), strict=True):
            raw = memoryview(raw.as_buffer())
            if kind == _STATE:
                yield _passed([(part, chunk, kind, bytes(raw))])
            elif kind == _ASKED:
                asked.append((part, chunk, raw))
            else:
                raw = _unsqueezed(raw)
                k = int(np.frombuffer(raw, "<u8", 1)[0])
                tables.append((np.cumsum(_unplaned(raw, 8, k, 8), dtype=np.uint64), _unplaned(raw, 8 + 8 * k, k, 8), _unplaned(raw, 8 + 16 * k, k, 8)))
    h, c, value = (np.concatenate(x) for x in zip(*tables, strict=True)) if tables else (np.full(1, END, np.uint64), *np.zeros((2, 1), np.uint64))
    order = np.argsort(h)
    h, c, value = h[order], c[order], value[order]
    for part, chunk, raw in asked:
        raw = _unsqueezed(raw)
        want = np.cumsum(_unplaned(raw, 0, len(raw) // 8, 8), dtype=np.uint64)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        has = h[at] == want
        yield _passed([(part, chunk, _ANSWERS, _squeezed(_planes(np.where(has, c[at], U64(0)), 8) + _planes(np.where(has, value[at], U64(0)), 8)))])


def _scored(add: float, v_total: float):
    """The documents of each chunk once its state and all its answers are there."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, memoryview] = {}
        answers: dict[int, dict[int, memoryview]] = {}
        asked: dict[int, int] = {}

        def made(chunk: int) -> pa.RecordBatch:
            raw, got = states.pop(chunk), answers.pop(chunk, {})
            head_size, n_parts, n_asked, n_seen = np.frombuffer(raw, "<u4", 4).tolist()
            head = pa.ipc.read_record_batch(pa.py_buffer(raw[16 : 16 + head_size]), _SCORED)
            at = 16 + head_size
            where = np.frombuffer(raw, "<u4", 2 * n_parts, at).reshape(-1, 2).tolist()
            at += 8 * n_parts
            reps = _unplaned(raw, at, n_asked).astype(np.int64)
            doc = _unplaned(raw, at + 4 * n_asked, n_seen).astype(np.int64)
            times = _unplaned(raw, at + 4 * n_asked + 4 * n_seen, n_seen).astype(np.int64) - 1
            c, value, lo = np.zeros(n_asked, np.int64), np.zeros(n_asked), 0
            for part, hi in where:
                one = _unsqueezed(got[part])
                c[lo:hi] = _unplaned(one, 0, hi - lo, 8).view(np.int64)
                value[lo:hi] = _unplaned(one, 8 * (hi - lo), hi - lo, 8).view(np.float64)
                lo = hi
            c, value, is_word = np.repeat(c, reps), np.repeat(value, reps), times > 0
            summed = lambda at, x: np.bincount(doc[at], x, head.num_rows)
            word, run = np.flatnonzero(is_word), slice(None)
            n_known = head.column("n_known").to_numpy() + summed(word, times[word] * (c[word] > 0)).astype(np.int64)
            base = head.column("base").to_numpy() + summed(word, times[word] * np.log10((c[word] + add) / v_total))
            gain = head.column("gain").to_numpy() + summed(run, value * np.abs(times))
            return pa.RecordBatch.from_arrays([head.column("doc_id"), head.column("held_out"), head.column("n_tokens"), *map(pa.array, (n_known, base, gain))], schema=_SCORED)

        for rows in batches:
            for part, chunk, kind, raw in zip(*(rows.column(i).to_pylist() for i in range(3)), rows.column("raw"), strict=True):
                raw = memoryview(raw.as_buffer())
                if kind == _STATE:
                    states[chunk] = _unsqueezed(raw)
                    asked[chunk] = int(np.frombuffer(states[chunk], "<u4", 2)[1])
                else:
                    answers.setdefault(chunk, {})[part] = raw
                if chunk in states and len(answers.get(chunk, ())) == asked[chunk]:
                    yield made(chunk)
        if states or answers:
            raise RuntimeError(f"{len(states)} chunks of documents lack answers")

    return emit


def _least_frequent(features: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, on a scale of sixteen steps to the doubling; the counts of its steps reach the driver."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double")) * 16)
    rows = {r["step"]: r["rows"] for r in features.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    total, least = 0, None
    for k in sorted(rows, reverse=True):
        total += rows[k]
        if total > most:
            break
        least = k
    return int(np.ceil(2 ** (least / 16) - 1e-9)) if least is not None else 1 << 62


def crc_remainder(column: str, by: int) -> Column:
    """crc32 of the value as text, modulo ``by``; null counts as the empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8")) % by).cast("int")


@tidy
def train_and_score(docs: DataFrame, held_out: Column, p: SuffixTree = SuffixTree()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows where ``held_out`` are not learnt from."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    train = rows.filter(~F.col("held_out")).select("text")
    n_rows, ends = rows.agg(F.count(F.lit(1)), F.count(F.when(~F.col("held_out"), 1))).first()
    parts = max(8, n_rows // 3000)
    words = written(train.mapInArrow(_count_words(parts), _PARTS_SQL).repartitionById(parts, F.col("part")).mapInArrow(_words_added_up, "h long, n long"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v = totals["n"] + ends, totals["v"] + (ends > 0)
    v_total = n_train + p.base_add * (v + 1)
    symbols = words.union(spark.createDataFrame([(END, ends)], "h long, n long"))
    tables = grow_tree(train, symbols, n_train, ends, v_total, p) if ends else []
    features = words.select("h", F.col("n").alias("c"), "n", F.lit(0.0).alias("value"))
    for t in tables:
        features = features.union(t.select("h", F.lit(None).cast("long"), "n", "value"))
    features = written(features.groupBy("h").agg(F.max("c").alias("c"), F.max("n").alias("n"), F.sum("value").alias("value")))
    hot = features.filter((F.col("n") >= _least_frequent(features, p.frequent)) | (F.col("h") == END)).select("h", F.coalesce("c", F.lit(0)).cast("double").alias("c"), "value").toArrow()
    order = np.argsort(hot["h"].to_numpy().view(np.uint64))
    table = tuple(hot[c].to_numpy()[order] for c in ("h", "c", "value"))
    if not len(order):
        table = (np.zeros(1, np.int64), np.zeros(1), np.zeros(1))
    bits = bit_table(features.filter("value <> 0 or c is null"))
    # a level brings runs up to one token longer than its contexts
    shared = spark.sparkContext.broadcast((table[0].view(np.uint64), *table[1:], bits, len(tables) // 2 + 1, p.base_add, v_total))
    parts = max(8, -(-(n_train * n_rows // ends if ends else 300 * n_rows) // 1_000_000))  # of what is asked for: each has a million tokens' or so
    asked = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score_docs(shared, parts), _PASSED_SQL)
    known = features.select("h", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("value", F.lit(0.0)).alias("value")).mapInArrow(_pack_features(parts), _PASSED_SQL)
    answers = asked.union(known).repartitionById(parts, F.col("part")).mapInArrow(_answered, _PASSED_SQL)
    sums = answers.repartition(parts, "chunk").mapInArrow(_scored(p.base_add, v_total), _SCORED_SQL)
    base_score = F.col("base") + float(np.log10((ends + p.base_add) / v_total))
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("gain") / float(np.log(10))).alias("score"))
