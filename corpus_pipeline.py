"""A corpus pipeline of five stages: each is written as Parquet and read again as the documents of the next.

Toxic documents go; one document of each near-duplicate class stays (the smallest
doc_id); passages that an earlier document has are cut out; documents with benchmark
passages go; what is left is packed into token sequences.  All stages but the last return
the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import bagminhash, decontamination, packing, substring_dedup, suffix_tree, toxicity
from grainwise.llm._spark import read_table, tidy, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; a null text counts as empty, rows without a doc_id are judged by their text."""
    p = toxicity.Toxicity()
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), suffix_tree.crc_remainder("doc_id", 3) != 1, p)
    return toxicity.below_threshold(docs, model, p)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest doc_id; repeated rows are one, rows without a doc_id come after all others."""
    return bagminhash.kept_rows(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of which nothing is left goes, one with a null text stays."""
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; without benchmark items all stay."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left with their places in sequences; a null text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the learnt score, the hashed classes and the tokenizer.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)  # the scratch tables that a stage's result reads end with the run
    return docs
