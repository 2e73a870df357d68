"""Benchmark decontamination with DataFrame operations only.

Benchmark items and documents are normalised alike (A-Z lower-cased; words are runs of
ASCII digits and letters and of all non-ASCII characters).  Windows are ``words``
consecutive words of an item; a shorter item with words is one window.  The windows' hash
set is broadcast: each document's token windows are hashed one after another, looked up in
it, and hits are verified word by word inside the join, so that only true hits leave it.
Words are split once; each document also sends its number of words.  Spans are merged for
each document.

A benchmark whose windows take more than ``broadcast_bytes`` is looked up in blocks of that
size, each against all documents.

Defined results: a null text has no words; a null item_id names no item, but its windows
still hit; rows that share doc_id and text give the same result each, rows that share only
doc_id are judged apart; repeated items count once; further columns of any name pass
through; an empty benchmark hits nothing, empty documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import as_row, prepare, row_columns, text_or_empty, tidy, written

# The definition of words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    words: int = 10
    broadcast_bytes: int = 64 << 20
    replacement: str = " "


def words_of(text: Column) -> Column:
    """The normalised words of a text, in order."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORDS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def item_windows(benchmark: DataFrame, p: Decontamination) -> DataFrame:
    """(item_id, k, gram, window) of every distinct window of every item; ``gram`` is its hash."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(p.words))
    at = items.withColumn("k", k).select("item_id", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    windows = at.select("item_id", "k", F.slice("w", F.col("i"), F.col("k")).alias("window")).distinct()
    return windows.withColumn("gram", F.xxhash64("window"))


def scanned(docs: DataFrame, grams: DataFrame, sizes: list[int], counts: bool) -> DataFrame:
    """(doc_id, key, at, k, gram, window, n_words) of every place in ``docs`` (doc_id, key, w) where a window occurs; with ``counts`` also a row for each row of docs that has n_words only."""
    n = F.size("w")
    places = docs.select("doc_id", "key", "w", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    places = places.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))) if len(sizes) > 1 else places.withColumn("size", F.lit(sizes[0]))
    token_window = F.slice("w", F.col("at") + 1, F.col("size"))
    inside = F.col("at") + F.col("size") <= n
    probe = places.withColumn("probe", F.when(inside, F.xxhash64(token_window)))
    hit = (F.col("probe") == F.col("gram")) & (F.col("size") == F.col("k")) & (token_window == F.col("window"))
    last = (F.col("at") == n) & (F.col("size") == F.lit(sizes[0]))
    if not counts:
        return probe.join(F.broadcast(grams), hit).select("doc_id", "key", "at", "k", "gram", "window", F.lit(None).cast("long").alias("n_words"))
    # unmatched places are filtered right behind the lookup, but for one at each document's end
    both = probe.join(F.broadcast(grams), hit, "left").filter(F.col("k").isNotNull() | last)
    return both.select("doc_id", "key", F.when(~last, F.col("at")).alias("at"), "k", "gram", "window", F.when(last, n).cast("long").alias("n_words"))


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (first word, words), key (of the text) of each row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"), words_of(text_or_empty()).alias("w"))
    windows = written(item_windows(benchmark, p))
    distinct = written(windows.select("k", "gram", "window").distinct())
    room = F.sum(F.aggregate("window", F.lit(64), lambda a, x: a + F.octet_length(x) + 16))
    total = distinct.agg(room.alias("bytes"), F.array_sort(F.collect_set("k")).alias("sizes")).first()
    blocks = -(-(total["bytes"] or 0) // p.broadcast_bytes) or 1
    found, pairs = None, None
    for b in range(blocks):
        of_block = lambda df: df.filter(F.pmod("gram", F.lit(blocks)) == b) if blocks > 1 else df  # noqa: B023, E731
        part = written(scanned(rows, of_block(distinct), total["sizes"] or [p.words], counts=b == 0))
        hits = part.filter("at is not null").select("doc_id", "key", "at", "k", "gram", "window").distinct()
        named = hits.select("doc_id", "key", "gram", "window").distinct().join(_checked(of_block(windows).filter("item_id is not null").select("item_id", "gram", "window"), p), ["gram", "window"]).select("doc_id", "key", "item_id").distinct()
        if b == 0:
            base, found, pairs = part.filter("at is null").select("doc_id", "key", "n_words"), hits, named
        else:
            found, pairs = found.union(hits), pairs.union(named).distinct()
    # words of the union of the spans: each span adds what lies beyond the ends before it
    span = F.struct("at", "k")
    merged = F.aggregate(
        F.array_sort(F.collect_set(span)),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["k"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["k"] - F.greatest(a["end"], s["at"]))).alias("n")),
    )
    spans = found.groupBy("doc_id", "key").agg(merged["n"].alias("n_hit"), F.array_sort(F.collect_set(span)).alias("hit_spans"))
    names = pairs.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    same = lambda a, b: (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    both = spans.alias("s").join(names.alias("m"), same("s", "m"), "left").select("s.doc_id", "s.key", "n_hit", "hit_spans", "n_items", "items")
    result = base.alias("b").join(both.alias("x"), same("b", "x"), "left")
    return result.select(
        "b.doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "hit_spans", "b.key",
    )


def _checked(windows: DataFrame, p: Decontamination) -> DataFrame:
    """Windows with their items, marked for broadcast if they take at most ``broadcast_bytes``."""
    size = windows.agg(F.sum(F.aggregate("window", F.length("item_id") + 64, lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    return F.broadcast(windows) if size <= p.broadcast_bytes else windows


@tidy
def clean(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or, with remove="spans", with the hit words cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    judged = decontaminate(docs, benchmark, p)
    flagged = judged.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "hit_spans").dropDuplicates(["_id", "_key"])
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"))
    same = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    if remove == "documents":
        return rows.join(flagged, same, "left_anti").select(*row_columns(docs))
    # words are marked where they stand: each goes with what lies behind it
    text = F.col("row")["text"]
    hit = lambda i: F.exists(F.col("hit_spans"), lambda s: (i >= s["at"]) & (i < s["at"] + s["k"]))
    found = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0)
    kept = F.concat(lead, F.array_join(F.filter(found, lambda x, i: ~hit(i)), ""))
    cut = rows.join(flagged, same, "left")
    return cut.select(*row_columns(docs, text=F.when(F.col("hit_spans").isNull(), text).otherwise(kept)))
