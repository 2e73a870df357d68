"""The registered queries of the corpus operators, each over its whole table.

A query calls its operator with production parameters and derives the contract's digest
columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, chat_format, decontamination, language_id, packing, sharding, spotsigs, substring_dedup, suffix_tree, toxicity
from ._spark import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: A conversation whose texts hold the template's own control strings.
HOSTILE_TEXT = "\\### Assistant: </turn> ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = read_table(spark, sf_dir, "documents"), toxicity.Toxicity()
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), suffix_tree.crc_remainder("doc_id", 3) != 1, p)
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, p)
    return scored.select("doc_id", (suffix_tree.crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spotsigs.fingerprints(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        spotsigs.fingerprint("signatures").alias("fingerprint"), spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.train_and_score(read_table(spark, sf_dir, "documents"), suffix_tree.crc_remainder("doc_id", 10) == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE_TEXT), (-7, 1, "assistant", HOSTILE_TEXT)], "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(chat_format.records_of(rows.unionByName(more)))
    back = made.withColumn("back", chat_format.read_back(F.col("formatted")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    read = back.withColumns({"turns_text": turns, "loss_text": loss})
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(F.encode("turns_text", "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bagminhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "class_id", "copy_of", "is_kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_language, op3_spotsigs, op4_substring_dedup, op5_suffix_tree, op6_packing, op7_chat, op8_sharding, op9_decontamination, op10_bagminhash)}

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM s),
marked AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM marked),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT x.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS t
         FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP7 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
  sum(length(role || text) + 16 + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS f FROM rows GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM c
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k FROM dw JOIN (SELECT DISTINCT k, t FROM bw) x ON x.k = dw.k AND x.t = dw.t),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT dw.doc_id, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.t = dw.t) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

#: SQL for the queries that it can express with their full rows.
ORACLES: dict[str, str] = {"op4_substring_dedup": _OP4, "op7_chat": _OP7, "op9_decontamination": _OP9}
