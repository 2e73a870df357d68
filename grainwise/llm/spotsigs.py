"""SpotSigs document fingerprints, with DataFrame operations only.

A spot signature starts at an anchor (a very common word) and chains the next ``chain``
content words (words that are no anchors) that follow it.  A text's fingerprint is the set
of its signatures, as 64-bit hashes; prose has many, boilerplate without common words few.  A text
without any signature falls back to its runs of ``chain`` words, and one shorter than that
to its words.  Likeness is the Jaccard similarity of the sets; a pair whose set lengths
alone rule out the threshold is pruned before any element is compared.

For the self-join, sets are partitioned by length so that partners at the threshold lie in
the same or the next partition, and meet in an inverted index of each set's rarest
signatures (the prefix in which two sets at the threshold must meet); equal sets are one
node, so groups of copies never become pairs.

Defined results: a null text is the empty text, whose set is empty; two empty sets have
likeness 1, an empty and another 0; repeated rows have equal fingerprints; rows with one
doc_id follow each other by their texts, a null doc_id comes first; an empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import prepare, salted_join, text_or_empty, tidy, written

# Common words of the four languages.
ANCHORS = {
    "en": "a an and are as at be but by can did do for from had has have he her his if in is it its not of on or said she that the their there they this to was we were what when which who will with you",
    "de": "als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht sich sie sind so und von war werden wie zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa se ses son sont sur un une vous",
    "es": "al como con de del el ella en era es esta este ha hay la las lo los más me mi muy no o para pero por que se sin sobre su sus un una y ya",
}


@dataclass(frozen=True)
class SpotSigs:
    chain: int = 2
    languages: tuple[str, ...] = ("en", "de", "fr", "es")

    @property
    def anchors(self) -> list[str]:
        return sorted({w for x in self.languages for w in ANCHORS[x].split()})


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def with_signatures(df: DataFrame, text: Column, name: str, p: SpotSigs = SpotSigs()) -> DataFrame:
    """Adds ``name``: the sorted set of a text's hashed spot signatures."""
    # several steps, so that each array is made once
    w, spots, content = f"{name}_w", f"{name}_s", f"{name}_c"
    is_anchor = lambda x: x.isin(p.anchors)
    df = df.withColumn(w, words_of(text))
    df = df.withColumn(spots, F.filter(F.transform(F.col(w), lambda x, i: F.when(is_anchor(x), i).otherwise(-1)), lambda i: i >= 0))
    df = df.withColumn(content, F.filter(F.col(w), lambda x: ~is_anchor(x)))
    # before the j-th anchor, at word i, there are i - j content words: its chain starts there
    made = F.transform(
        F.filter(F.transform(F.col(spots), lambda i, j: F.struct(i.alias("i"), (i - j).alias("c"))), lambda s: s["c"] + p.chain <= F.size(content)),
        lambda s: F.xxhash64(F.get(F.col(w), s["i"]), *(F.get(F.col(content), s["c"] + k) for k in range(p.chain))),
    )
    runs = F.when(
        F.size(w) >= p.chain,
        F.transform(F.sequence(F.lit(0), F.size(w) - p.chain), lambda i: F.xxhash64(F.lit(""), *(F.get(F.col(w), i + k) for k in range(p.chain)))),
    ).otherwise(F.transform(F.col(w), lambda x: F.xxhash64(F.lit(""), x)))
    df = df.withColumn(f"{name}_m", made)
    return df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size(f"{name}_m") > 0, F.col(f"{name}_m")).otherwise(runs)))).drop(w, spots, content, f"{name}_m")


def fingerprint(signatures: str) -> Column:
    """The set as text: sixteen hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where the set lengths alone keep it under the threshold."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    pruned = (F.least(n, m) == 0) | (F.least(n, m) < F.lit(threshold) * F.greatest(n, m))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(pruned, F.lit(0.0)).otherwise((both / (n + m - both)).cast("double"))


def with_next(docs: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Adds next_<column> of the row with the next larger doc_id (after the last: of the first), in no single task.

    Rows are dealt into ranges of doc_id and ordered within; the first row of each range
    is also sent to the range before.  Only one small row a range meets in one place.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # cut points of doc_id: at most 4096 numbers
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / n) for i in range(1, min(n, 4096)))), 100_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    if cuts:
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(_position(cuts))
    else:
        part = F.lit(0)
    ranged = docs.withColumn("_range", part.cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), *(F.col(c) for c in columns if c != "doc_id")]
    # the smallest row of each range, found without sorting and sent to the range before it
    least = ranged.groupBy("_range").agg(F.min("doc_id").alias("_least"), (F.count(F.lit(1)) > F.count("doc_id")).alias("_null"))
    firsts = {r["_range"]: (None if r["_null"] else r["_least"]) for r in least.collect()}  # a row a range
    if not firsts:
        return ranged.drop("_range").select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    names = sorted(firsts)
    before = {names[i]: names[i - 1] for i in range(len(names))}
    rows = [(r, firsts[r], before[r], r == names[0]) for r in names]
    heads = F.broadcast(spark.createDataFrame(rows, "_r int, _first long, _to int, _around boolean"))
    halo = ranged.join(heads, (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    # of rows that share the smallest doc_id, the least by its columns
    halo = halo.groupBy("_to", "_around").agg(F.min(F.struct(*columns)).alias("_c")).select(F.col("_to").alias("_range"), F.lit(True).alias("_halo"), F.col("_around"), *(F.col("_c")[c].alias(c) for c in columns))
    mine = ranged.withColumns({"_halo": F.lit(False), "_around": F.lit(False)})
    dealt = mine.unionByName(halo, allowMissingColumns=True).repartition(max(n, 1), "_range")
    window = Window.partitionBy("_range").orderBy(F.col("_halo"), *order)
    following = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(window))
    return following.filter(~F.col("_halo")).select(*docs.columns, *(F.col("_next")[c].alias(f"next_{c}") for c in columns))


def _position(points: list[int]) -> Column:
    """How many of the sorted points are at most doc_id: counted in every 64th, then among the 64 that follow."""
    at_most = lambda x: x <= F.col("doc_id")
    coarse = F.size(F.filter(F.array(*(F.lit(int(c)) for c in points[63::64])), at_most)) if len(points) >= 64 else F.lit(0)
    fine = F.slice(F.array(*(F.lit(int(c)) for c in points)), coarse * 64 + 1, 64)
    return coarse * 64 + F.size(F.filter(fine, at_most))


def edited_text(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(F.col(text), F.lit(1), n - half), F.substr(F.col(other), F.lit(1), half))


def fingerprints(docs: DataFrame, p: SpotSigs = SpotSigs()) -> DataFrame:
    """doc_id, text, signatures, edited (text), edited_signatures, near_edited, near_next of every row."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    both = with_next(texts, ["doc_id", "text"]).drop("next_doc_id").withColumn("edited", edited_text())
    for text, name in (("text", "signatures"), ("edited", "edited_signatures"), ("next_text", "next_signatures")):
        both = with_signatures(both, F.col(text), name, p)
    return both.withColumns({"near_edited": likeness("signatures", "edited_signatures"), "near_next": likeness("signatures", "next_signatures")}).drop("next_text", "next_signatures")


@tidy
def similar_sets(sets: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, signatures): pairs (a, b, likeness) of representatives at the threshold, and membership (doc_id, representative).

    Partition k holds sets with threshold**-k <= length < threshold**-(k+1); a set is
    looked up in its own partition and in the one above.  Rows of empty sets are members
    of their smallest doc_id and pair with nothing.
    """
    keyed = written(sets.withColumn("key", F.xxhash64("signatures")))  # filters below would make the sets anew for each of their elements
    members = keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("representative")), "key")
    nodes = written(members.filter("doc_id = representative and size(signatures) > 0").select(F.col("doc_id").alias("node"), "signatures").dropDuplicates(["node"]))
    place = F.floor(F.log(F.size("signatures").cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    sized = nodes.withColumn("n", F.size("signatures")).withColumn("part", place)
    each = sized.select("node", "n", "part", F.explode("signatures").alias("s"))
    frequency = written(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).withColumn("n_left", F.col("df")))
    ranked = salted_join(each, frequency, ["s"], F.xxhash64("node")).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "s")))
    prefix = written(ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("node", "n", "part", "s"))
    other = prefix.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("home"), "s")
    probe = prefix.withColumn("home", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    met = probe.join(other, ["home", "s"]).filter((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("b")))).filter(F.col("n") >= F.col("m") * threshold - 1e-9)
    candidates = met.select(F.col("node").alias("a"), "b").distinct()
    pairs = candidates.join(nodes.select(F.col("node").alias("a"), F.col("signatures").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("signatures").alias("y")), "b")
    return pairs.withColumn("likeness", likeness("x", "y", threshold)).filter(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members.select("doc_id", "representative")
