"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Rows with equal texts form a group, and a group has a vector (bytes, tokens, rows).  A
group that is heavy (over 1/``fine`` of a shard in any dimension; so at most
3 x shards x fine of them, times the parts below) is an item of its own; one
over ``part`` of a shard is cut into parts by a hash of the row, since no placement
could balance it whole.  Light groups are hashed into ``bundles`` items.  So the number
of items has a fixed bound at any input size.  Items go, largest first, to the shard
where the dot product of the item with the residual capacity is highest, among the
shards that still have room in every dimension, or else to the one with most residual
bytes; the smallest items come last and even out what is left.

Defined results: a null text counts as empty; size is UTF-8 bytes plus one; repeated rows
belong to one group and get a slot each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, ranked, text_or_empty, tidy, written


@dataclass(frozen=True)
class Sharding:
    shards: int = 16
    bundles: int = 1 << 15
    fine: int = 512
    part: float = 0.05


DIMENSIONS = ["size", "tokens", "rows"]


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item."""
    total = vectors.sum(axis=0)
    share = vectors / np.maximum(total, 1) * shards  # 1 is a shard's capacity
    free, out = np.ones((shards, share.shape[1])), np.zeros(len(share), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        v = share[i]
        fits = (free >= v).all(axis=1)
        score = np.where(fits, free @ v, -np.inf) if fits.any() else free[:, 0]
        out[i] = s = int(np.argmax(score))
        free[s] -= v
    return out


@tidy
def shard(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    prepare(spark)
    text = text_or_empty()
    raw = F.encode(text, "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS)).first()
    share = F.greatest(*(F.col(c) / F.lit(max(total[c], 1)) * p.shards for c in DIMENSIONS))
    sized = groups.withColumn("share", share)
    heavy = sized.filter(F.col("share") > 1 / p.fine).withColumn("parts", F.when(F.col("share") > p.part, F.ceil(F.col("share") / (p.part / 4))).otherwise(1).cast("int")).select("group", "parts")
    heavy = F.broadcast(written(heavy))  # at most 3 x shards x fine rows
    part = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))).cast("int")
    item = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("group"), F.lit(p.bundles))).otherwise(F.col("group"))
    named = rows.join(heavy, "group", "left").withColumns({"part": part, "item": item})
    items = named.groupBy("item", "part").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    table = items.orderBy("item", "part").toPandas()  # bounded by bundles and heavy parts
    placed = pd.DataFrame({"item": table["item"].astype("int64"), "part": table["part"].astype("int32"), "shard": place(table[DIMENSIONS].to_numpy(float), p.shards).astype("int32")})
    where = F.broadcast(spark.createDataFrame(placed, "item long, part int, shard int"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    out = ranked(named.join(where, ["item", "part"]), ["shard"], order, "slot", F.xxhash64("doc_id", "text_crc32"), slices=1024)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
