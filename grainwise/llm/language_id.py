"""Language of web pages by Bayesian fusion of evidence.

Three sources are combined for each page:

* text: likelihoods of the visible text's byte trigrams, learnt from the languages of all
  ``documents`` and tempered, since neighbouring trigrams are not independent;
* declared markup language: P(declared | language), counted over all pages;
* where the page is: a prior from its host, smoothed towards its registered domain, that
  towards the address suffix, that towards all pages.  These counts come from grouped
  aggregation of what text and markup say; a page's own share is taken out of its prior.

Every language of ``documents`` is known, however few of them it has; its likelihoods are
smoothed.  The likelihood table has a row of ``buckets`` numbers for each language.

A host with very many pages is summed in partial aggregates, and its pages are dealt out to
many tasks when they meet its sums; so are the hosts of a wide domain or suffix.

Defined results: a null page or one without visible text is judged by markup and host
alone; without a usable address the prior is that of all pages; ties go to the language
first in the alphabet; repeated rows are judged each; without any training documents no
row can be judged and language is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, salted_join, tidy, written
from ._words import U64, lower_ascii, mix, steps, text_bytes


@dataclass(frozen=True)
class LanguageId:
    buckets: int = 1 << 14
    temper: float = 0.25
    host_weight: float = 5.0  # pages that the wider level counts for
    markup_add: float = 1.0


def _trigrams(rows: pa.RecordBatch, column: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams of lower-cased texts, white space and digits as one symbol."""
    data, offsets = text_bytes(rows.column(column))
    x = lower_ascii(data)
    x = np.where((x < 0x61) & ((x < 0x27) | (x > 0x27)) | ((x > 0x7A) & (x < 0x80)), 0x20, x).astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (x[:-2] << U64(16)) | (x[1:-1] << U64(8)) | x[2:]
    row = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
    use = (row[:-2] == row[2:]) & ~((x[:-2] == 0x20) & (x[1:-1] == 0x20))
    return row[:-2][use], (mix(gram[use]) % U64(buckets)).astype(np.int64)


def _train(languages: list[str], buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = {x: i for i, x in enumerate(languages)}, np.zeros(len(languages) * buckets, np.int64)
        for rows in steps(batches):
            row, bucket = _trigrams(rows, "text", buckets)
            of = np.array([number.get(x, -1) for x in rows.column("lang").to_pylist()])
            use = of[row] >= 0
            total += np.bincount(of[row[use]] * buckets + bucket[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return emit


def _likelihoods(shared, p: LanguageId):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in steps(batches):
            row, bucket = _trigrams(rows, "text", p.buckets)
            sums = [np.bincount(row, m[bucket], rows.num_rows) * p.temper for m in model]
            flat = np.stack(sums, axis=1)
            logs = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), len(model)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in ("page_id", "host", "declared")), logs], names=["page_id", "host", "declared", "text_log"])

    return emit


def visible_text(html: str = "html") -> Column:
    """The text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#\w+;", " ")


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def declared_language(html: str = "html") -> Column:
    found = F.regexp_extract(F.substring(F.coalesce(F.col(html), F.lit("")), 1, 1 << 30), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1)
    return F.lower(found)


def _normal(log: Column) -> Column:
    """Probabilities from an array of logarithms."""
    raised = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


@tidy
def identify(pages: DataFrame, documents: DataFrame, p: LanguageId = LanguageId()) -> DataFrame:
    """page_id, language, probability, text_language, declared, host and the prior's probability of the answer."""
    spark = pages.sparkSession
    prepare(spark)
    langs = documents.filter("lang is not null").select("lang").distinct()
    languages = sorted(r["lang"] for r in langs.collect())  # every language that has documents
    schema = "page_id long, language string, probability double, text_language string, declared string, host string, prior double"
    if not languages:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", ")[1:])))
    size = len(languages)
    cells = documents.select("lang", "text").mapInArrow(_train(languages, p.buckets), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.zeros(size * p.buckets)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"]
    counts = counts.reshape(size, p.buckets) + 0.5
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), declared_language().alias("declared"), visible_text().alias("text"))
    judged = seen.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model), p), "page_id long, host string, declared string, text_log array<double>")
    judged = written(judged.withColumn("text_p", _normal(F.col("text_log"))))

    names = [f"p{i}" for i in range(size)]
    soft = judged.select("declared", *(F.col("text_p")[i].alias(n) for i, n in enumerate(names)))
    # what pages that declare a language are in: P(declared | language), over the known languages and "any other"
    named = [x for x in languages if x not in ("", "?")]
    said = F.when(F.col("declared").isin(*named), F.col("declared")).otherwise(F.when(F.col("declared") == "", F.lit("")).otherwise("?"))
    by_said = {r["said"]: [r[n] for n in names] for r in soft.groupBy(said.alias("said")).agg(*(F.sum(n).alias(n) for n in names)).collect()}
    keys = [*named, "", "?"]
    table = np.array([by_said.get(k, [0.0] * size) for k in keys]) + p.markup_add
    table = np.log(table / table.sum(axis=0, keepdims=True))
    markup = F.create_map(*(x for i, k in enumerate(keys) for x in (F.lit(k), F.array(*(F.lit(float(v)) for v in table[i])))))
    fused = judged.withColumn("said_log", markup[said]).withColumn("own_log", F.zip_with("text_log", "said_log", lambda a, b: a + b))
    # registered domain and suffix from the host's last labels
    labels = F.split("host", r"\.")
    suffix = F.when(F.col("host") == "", "").otherwise(F.element_at(labels, -1))
    domain = F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, F.when(F.size(labels) >= 2, -2).otherwise(-1)), suffix)).otherwise(suffix)
    own = written(fused.withColumns({"own": _normal(F.col("own_log")), "domain": domain, "suffix": suffix}).select("page_id", "host", "domain", "suffix", "declared", "text_log", "own_log", "own"))

    wide = own.select("host", "domain", "suffix", *(F.col("own")[i].alias(n) for i, n in enumerate(names)))
    hosts = wide.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(n).alias(n) for n in names))
    hosts = written(hosts.select("host", "domain", "suffix", "pages", F.array(*names).alias("host_n")))

    def with_level(df: DataFrame, key: str, out: str) -> DataFrame:
        """Adds the sums of a wider level, which may hold a third of all hosts."""
        sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"), F.array(*(F.sum(F.col("host_n")[i]) for i in range(size))).alias(out))
        return salted_join(df, written(sums), [key], F.xxhash64("host"))

    everything = hosts.agg(*(F.coalesce(F.sum(F.col("host_n")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(size))).first()
    levels = with_level(with_level(hosts, "domain", "domain_n"), "suffix", "suffix_n").select("host", "host_n", "domain_n", "suffix_n", F.col("pages").alias("n_left"))
    placed = salted_join(own, written(levels), ["host"], F.monotonically_increasing_id())
    everyone = float(sum(everything)) + size
    placed = placed.withColumn("prior_p", F.array(*(F.lit((float(x) + 1.0) / everyone) for x in everything)))

    def narrowed(df: DataFrame, level: str) -> DataFrame:
        """The prior of a narrower level, without the page's own share."""
        rest = F.zip_with(level, "own", lambda n, o: F.greatest(n - o, F.lit(0.0)))
        pages = F.aggregate("rest", F.lit(0.0), lambda a, b: a + b) + p.host_weight
        return df.withColumn("rest", rest).withColumn("pages", pages).withColumn("prior_p", F.zip_with("rest", "prior_p", lambda a, b: (a + p.host_weight * b) / F.col("pages")))

    for level in ("suffix_n", "domain_n", "host_n"):
        placed = narrowed(placed, level)
    final = placed.withColumn("p", _normal(F.zip_with("own_log", "prior_p", lambda a, b: a + F.ln(b))))
    best = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int")
    known = F.array(*(F.lit(x) for x in languages))
    return final.select("page_id", F.element_at(known, best("p")).alias("language"), F.array_max("p").alias("probability"), F.element_at(known, best("text_log")).alias("text_language"), "declared", "host", F.element_at("prior_p", best("p")).alias("prior"))
