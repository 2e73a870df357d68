"""Near-duplicate documents by BagMinHash signatures of word shingles.

A text is the multiset of its runs of five words (a shorter text with words: the run
of all its words).  Every shingle owns unit-rate Poisson processes over its weight
axis, cut hierarchically into octaves [0,1), [1,2), [2,4), ...: whole octaves below the
shingle's count are taken as they are, and in the last one each point also draws its
place on the axis and counts if that lies below the count.  A point carries a register
number; a register keeps its earliest point.  Two bags share exactly the points of the
weight they share, so a register agrees with probability weighted Jaccard.  Processes
run only up to the time by which a document's registers are surely full, so the work is
about one draw a shingle plus a fixed number a document.

Registers are banded; members of a bucket are compared exactly (shingle multisets of the
texts) with one representative each, then with other buckets' representatives.  Documents
that are connected through buckets form a family, and what still lies in another component
than most of its family is a query against all members of the other components there: the
queries and the members are dealt into a grid of cells, each a block of queries and a block
of members, and in a cell registers are compared first, and texts exactly where registers
agree so often that the threshold is within ``sure`` standard errors.  So no pairs of a
bucket are spelled out, no task gets more of a family than a cell, and each pair of different
texts that shares a bucket and reaches the threshold ends in one class, while copies never
become pairs: texts with equal 128-bit BLAKE2b digests are one node from the start.  A family
of n members of which q are apart costs n x q / members_per_cell copies of a query's text
and n x q / queries_per_cell copies of a member's.

Defined results: a null text is the empty text; texts without words equal only their own
copies; rows with a null ``doc_id`` get a null class and take part in nothing (``kept_rows``
gives them ids of their own); rows that share a ``doc_id`` are one node for the texts that
it is the first to have, and go with an earlier one for the others; an empty table gives no rows; ties go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_row, prepare, row_columns, tidy, written
from ._words import U64, Batch, list_array, mix, steps, text_bytes


@dataclass(frozen=True)
class BagMinHash:
    """``registers`` = bands x rows; with 24 bands of 4 a pair at similarity 0.8 is missed with probability 3e-6."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    members_per_slice: int = 2000
    queries_per_cell: int = 250
    members_per_cell: int = 500
    sure: float = 4.5
    broadcast_bytes: int = 16 << 20
    edges_per_task: int = 5_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Registers that agree at least, up to a chance as small as that of missing a pair by the bands."""
        return int(self.registers * self.threshold - self.sure * (self.registers * self.threshold * (1 - self.threshold)) ** 0.5)


def shingles(batch: Batch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of a batch."""
    at, h = batch.windows(words)
    short = np.flatnonzero((batch.counts > 0) & (batch.counts < words))
    doc = np.repeat(np.arange(batch.n_docs), np.maximum(batch.counts - words + 1, 0))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, batch.whole_hash(short)])
    return doc, h


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), each pair once."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The BagMinHash registers (n_docs x m arrival times; infinite for an empty bag)."""
    out = np.full((n_docs, m), np.inf)
    total = np.bincount(doc, weight, n_docs)
    todo, slack = np.flatnonzero(total > 0), 3.0
    last = np.floor(np.log2(weight)).astype(np.int64) + 1  # octave o > 0 is [2**(o-1), 2**o); octave 0 is [0, 1)
    while len(todo):
        chosen = np.zeros(n_docs, bool)
        chosen[todo] = True
        of, limit = chosen[doc], np.full(n_docs, np.inf)
        limit[todo] = m * (np.log(m) + slack) / total[todo]
        flat = out.reshape(-1)
        for octave in range(int(last[of].max()) + 1):
            low, width = (0, 1) if octave == 0 else (1 << (octave - 1), 1 << (octave - 1))
            pick = np.flatnonzero(of & (weight > low))
            if not len(pick):
                continue
            key, d = mix(h[pick] + U64(octave * 0xA24BAED4963EE407 % 2**64)), doc[pick]
            share = np.minimum((weight[pick] - low) / width, 1.0)
            t, end, turn = np.zeros(len(pick)), limit[d], 0
            while len(key):
                turn += 1
                draw = mix(key + U64(turn * 0x9FB21C651E98DF25 % 2**64))
                t = t - np.log(_uniform(draw)) / width
                live = t <= end
                if not live.all():
                    key, d, share, t, end, draw = key[live], d[live], share[live], t[live], end[live], draw[live]
                second = mix(draw ^ U64(0x2545F4914F6CDD1D))
                register = d * m + ((second >> U64(32)) % U64(m)).astype(np.int64)
                if octave and (share < 1).any():
                    take = _uniform(mix(second)) < share
                    np.minimum.at(flat, register[take], t[take])
                else:
                    np.minimum.at(flat, register, t)
        todo, slack = todo[np.isinf(out[todo]).any(axis=1)], slack + 6
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("buckets", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _signer(p: BagMinHash):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches):
            batch = Batch(*text_bytes(rows.column("text")))
            a, b = batch.text_hash()
            reg = signatures(*weighted(*shingles(batch, p.words)), batch.n_docs, p.registers)
            has, bits = np.isfinite(reg[:, 0]), reg.view(np.uint64).reshape(batch.n_docs, p.bands, p.rows)
            bucket = mix(np.arange(p.bands, dtype=np.uint64) + U64(1)) + np.zeros((batch.n_docs, 1), np.uint64)
            for r in range(p.rows):
                bucket = mix(bucket ^ bits[:, :, r])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(a), pa.array(b), list_array(bucket[has].view(np.int64).reshape(-1), has * p.bands, pa.int64()), pa.array([x.tobytes() for x in mix(reg.view(np.uint64)).astype(np.uint8)], pa.binary())], schema=_SIGNED)

    return sign


def _units(batch: Batch, words: int) -> list[np.ndarray]:
    """For each document the sorted units (shingle, occurrence) of its multiset."""
    doc, h = shingles(batch, words)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    turn = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    unit = np.where(turn > 0, mix(h + turn.astype(np.uint64) * U64(0xD1342543DE82EF95)), h)
    ends = np.searchsorted(doc, np.arange(batch.n_docs + 1))
    return [np.sort(unit[ends[i] : ends[i + 1]]) for i in range(batch.n_docs)]


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b) or min(len(a), len(b)) / max(len(a), len(b)) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verifier(p: BagMinHash):
    """Rows come sorted: the text of ``hub`` (a null), then the texts compared with it.  One hub is held at a time."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_key, hubs = None, []
        for rows in steps(batches):
            units = _units(Batch(*text_bytes(rows.column("text"))), p.words)
            found = []
            for hub, cut, a, unit in zip(rows.column("hub").to_pylist(), rows.column("cut").to_pylist(), rows.column("a").to_pylist(), units, strict=True):
                if (hub, cut) != hub_key:
                    hub_key, hubs = (hub, cut), []
                if a is None:
                    hubs.append(unit)
                elif hubs and (s := max(_similarity(unit, x) for x in hubs)) >= p.threshold:
                    found.append((a, hub, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_EDGES)], schema=_EDGES)

    return verify


def _comparer(p: BagMinHash):
    """Rows come sorted: the queries of a cell of a family (kind 0), then its members; links between labels, none between labels that the cell has already joined."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, over = None, [], {}

        def top(label: int) -> int:
            while (above := over.get(label, label)) != label:
                over[label] = label = over.get(above, above)
            return label

        for rows in steps(batches):
            family, cut, block, kind, node, label = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("family", "cut", "block", "kind", "node", "label"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, p.registers)
            units = _units(Batch(*text_bytes(rows.column("text"))), p.words)
            edge = np.flatnonzero((np.diff(family) != 0) | (np.diff(cut) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            found = []
            for i, j in zip([0, *edge], [*edge, len(node)], strict=True):
                if (family[i], cut[i], block[i]) != now:
                    now, held, over = (family[i], cut[i], block[i]), [], {}
                if kind[i] == 0:
                    held.append((node[i:j], label[i:j], sketch[i:j], units[i:j]))
                elif held:
                    names, marks, mine = (np.concatenate([h[k] for h in held]) for k in range(3))
                    bags = [u for h in held for u in h[3]]
                    for at in range(i, j, 256):
                        to = min(j, at + 256)
                        equal = (sketch[at:to, None, :] == mine[None]).sum(axis=2)
                        for x, y in zip(*np.nonzero((equal >= p.least_equal) & (label[at:to, None] != marks[None])), strict=True):
                            mine_top, other_top = top(marks[y]), top(label[at + x])
                            if mine_top != other_top and (similarity := _similarity(units[at + x], bags[y])) >= p.threshold:
                                over[mine_top] = other_top
                                found.append((max(node[at + x], names[y]), min(node[at + x], names[y]), similarity))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_EDGES)], schema=_EDGES)

    return compare


def _small(df: DataFrame, p: BagMinHash) -> DataFrame:
    """The table, whose columns are numbers, marked for broadcast if its rows take at most ``broadcast_bytes``, else for any join."""
    return F.broadcast(df) if df.count() * (16 + 8 * len(df.columns)) <= p.broadcast_bytes else df


def verified(pairs: DataFrame, texts: DataFrame, p: BagMinHash) -> DataFrame:
    """Of the pairs (a, b) those whose texts reach the threshold, with their similarity.

    The texts of the a's travel once to their hub b; a hub with many partners is cut into
    slices, each with a copy of the hub's text, so no task holds more than one hub's text
    and a stream of partners.
    """
    n = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sizes = _small(written(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / p.members_per_slice).cast("int").alias("cuts"))), p)
    cut = F.pmod(F.xxhash64("a"), F.col("cuts")).cast("int")
    partners = texts.select(F.col("doc_id").alias("a"), "text").join(_small(pairs, p).join(sizes, "b").select("a", F.col("b").alias("hub"), cut.alias("cut")), "a")
    hubs = texts.select(F.col("doc_id").alias("b"), "text").join(sizes, "b").select(F.lit(None).cast("long").alias("a"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "text")
    rows = hubs.select("hub", "cut", "a", "text").unionByName(partners.select("hub", "cut", "a", "text"))
    dealt = rows.repartition(int(n), "hub", "cut").sortWithinPartitions("hub", "cut", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(_verifier(p), "a long, b long, similarity double")


def components(edges: DataFrame, p: BagMinHash = BagMinHash()) -> DataFrame:
    """(node, label): the smallest node of each connected component, for the nodes that have edges.

    Each round gives a node, and the node it points to, the smallest pointer among its
    neighbours, after pointers have been followed once more, so chains end in few rounds.
    Rounds are written to the shared folder and end when no pointer moves; their number of
    tasks follows the number of edges.
    """
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = written(edges.select(F.inline(ways)).distinct())
    tasks = both.count() // p.edges_per_task + 1
    labels = _small(written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")).coalesce(tasks)), p)
    while True:
        follow = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        known = labels.join(follow, "label")
        near = both.join(known.select(F.col("node").alias("other"), "far"), "other").groupBy("node").agg(F.min("far").alias("near")).coalesce(tasks)
        told = near.join(known, "node")
        claims = told.select("node", F.least("far", "near").alias("claim"), F.col("label").alias("old")).union(told.select("label", "near", F.lit(None).cast("long")))
        moved = written(claims.groupBy("node").agg(F.min("claim").alias("label"), F.max("old").alias("old")).coalesce(tasks))
        labels = _small(moved.select("node", "label"), p)
        if moved.filter("label < old").isEmpty():
            return labels


def _joined(nodes: DataFrame, name: str, labels: DataFrame, out: str) -> DataFrame:
    mine = labels.select(F.col("node").alias(name), F.col("label").alias("_label"))
    return nodes.join(mine, name, "left").withColumn(out, F.coalesce("_label", name)).drop("_label")


def merged(labels: DataFrame, links: DataFrame, p: BagMinHash = BagMinHash()) -> DataFrame:
    """The labels after more links (a, b): components are joined on the far smaller graph between labels."""
    ends = _joined(_joined(links.select("a", "b"), "a", labels, "x"), "b", labels, "y").filter("x <> y")
    top = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), p)
    everyone = labels.union(top.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
    higher = top.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return _small(written(everyone.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label"))), p)


@tidy
def near_duplicates(docs: DataFrame, p: BagMinHash = BagMinHash()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id of the class), copy_of (smallest doc_id with the same text), is_kept."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    signed = written(texts.mapInArrow(_signer(p), "doc_id long, text_key long, text_a long, text_b long, buckets array<long>, sketch binary"))
    copies = _small(written(signed.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")), p)
    members = written(signed.join(copies, ["text_a", "text_b"], "left").withColumn("copy_of", F.coalesce("first", "doc_id")).select("doc_id", "text_key", "copy_of", F.when(F.col("doc_id") == F.col("copy_of"), F.col("buckets")).alias("buckets"), "sketch"))
    sketches = members.filter("buckets is not null").select(F.col("doc_id").alias("node"), "text_key", "sketch").dropDuplicates(["node", "text_key"])
    entries = members.filter("buckets is not null").select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("node"))
    shared = _small(written(entries.groupBy("bucket").agg(F.min("node").alias("rep"), F.max("node").alias("top")).filter("rep < top").select("bucket", "rep")), p)
    buckets = written(entries.join(shared, "bucket"))

    first = written(buckets.groupBy("node").agg(F.min("rep").alias("rep")).filter("rep < node").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    labels = components(written(verified(first, texts, p)), p)

    # other representatives, for members that these may still join to something
    apart = _joined(_joined(buckets.filter("rep < node"), "node", labels, "x"), "rep", labels, "y").filter("x <> y")
    second = written(apart.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        labels = merged(labels, written(verified(second, texts, p)), p)

    # what differs from most of its family is held against every member of another component there
    across = _joined(_joined(buckets.filter("rep < node"), "node", labels, "x"), "rep", labels, "y").filter("x <> y")
    families = components(across.select(F.col("x").alias("a"), F.col("y").alias("b")), p).select(F.col("node").alias("label"), F.col("label").alias("family"))
    held = written(_joined(buckets.select("node").distinct(), "node", labels, "label").join(families, "label"))
    sizes = held.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("odd"), F.sum("n").alias("size")).filter("odd > 0")
    grid = main.select("family", "main", F.ceil(F.col("odd") / p.queries_per_cell).cast("int").alias("cuts"), F.ceil(F.col("size") / p.members_per_cell).cast("int").alias("blocks"))
    mixed = written(held.join(grid, "family"))
    if not mixed.isEmpty():
        told = texts.select(F.col("doc_id").alias("node"), "text", "text_key").join(_small(mixed, p), "node").join(sketches, ["node", "text_key"])
        place = F.xxhash64("node", F.lit("cell"))
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["family", "cut", "block", "kind", "node", "label", "sketch", "text"]
        query = told.filter("label <> main").withColumns({"cut": F.pmod(place, "cuts").cast("int"), "kind": F.lit(0)}).withColumn("block", cells("blocks")).select(*columns)
        every = told.withColumns({"block": F.pmod(place, "blocks").cast("int"), "kind": F.lit(1)}).withColumn("cut", cells("cuts")).select(*columns)
        dealt = query.unionByName(every).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family", "cut", "block").sortWithinPartitions("family", "cut", "block", "kind")
        third = written(dealt.mapInArrow(_comparer(p), "a long, b long, similarity double"))
        if not third.isEmpty():
            labels = merged(labels, third, p)
    classes = _joined(members.select("doc_id", "text_key", "copy_of"), "copy_of", labels, "class_id")
    return classes.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "copy_of", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_kept"), "text_key")


@tidy
def kept_rows(docs: DataFrame, p: BagMinHash = BagMinHash()) -> DataFrame:
    """One row of each class of ``docs``, with all its columns; rows without a doc_id come after all others, and repeated rows are one."""
    prepare(docs.sparkSession)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(key, F.lit(1 << 61)))
    judged = near_duplicates(docs.select(own.alias("doc_id"), "text"), p)
    kept = judged.filter("is_kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = docs.select(as_row(docs), own.alias("_id"), key.alias("_key")).join(kept, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    return rows.select(*row_columns(docs))
