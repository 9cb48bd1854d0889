"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, checkpoint, n_words, text_key, text_of

#: Groups under ALONE travel in bundles: so many hash bundles for each class of text length, which bounds
#: the items that the packer sees. A bundle holds about 1/4096 of all rows, as much as such a group can.
BUNDLES = 1024
#: A group above this share of any dimension is an item of its own.
ALONE = 1 / 4096
#: Only a group that no shard can hold is split: into so many pieces for each shard that it would fill.
PIECES = 4
#: Weights of bytes, tokens and rows in the dot product; bytes weigh most, as the law is near equal bytes.
WEIGHTS = (4.0, 1.0, 1.0)


def place(sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """Greedy vector bin packing: items in order of falling largest share, each to the shard where the
    dot product of item and residual capacity is highest among the shards that it fits in (or among
    all shards, where it fits in none); of equal ones to the first. sizes: items x dimensions; returns
    the shard of each item."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1)
    left = np.full((n_shards, share.shape[1]), 1.0 / n_shards)
    weight = np.array(WEIGHTS[: share.shape[1]])
    out = np.zeros(len(share), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        score = left @ (share[i] * weight)
        fits = (left >= share[i] - 1e-12).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        out[i] = s = int(np.argmax(score))
        left[s] -= share[i]
    return out


def pack_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Deal documents (doc_id, text) into n_shards shards whose bytes are near equal, and whose tokens
    and rows are balanced along with them.

    Groups are equal texts and stay together, unless no shard can hold a group (over 1/n_shards of all
    bytes, tokens or rows): such a group is split by a hash of doc_id. Groups under ALONE are packed in
    bundles chosen by a hash of the text, so the packer sees a bounded number of items (4 x BUNDLES +
    3/ALONE + 3 x PIECES x n_shards) however many documents there are; only these sums reach the driver.
    Slots number the rows of a shard from 0 without gaps.

    Null text: size 1, the same group as the empty text. Null or repeated ids and repeated rows are
    kept, each with a slot of its own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of()
    base = checkpoint(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), n_words(text).alias("tokens"), *text_key()))
    rows, size, tokens = base.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    total = [max(x or 0, 1) for x in (size, tokens, rows)]

    groups = base.groupBy("k1", "k2", "k3").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    share = F.greatest(*[F.col(c) / F.lit(n) for c, n in zip("btr", total, strict=True)])
    heavy = groups.where(share > ALONE).select("k1", "k2", "k3", F.when(share > 1 / n_shards, F.ceil(share * n_shards * PIECES)).otherwise(1).cast("int").alias("pieces"))
    # at most 3/ALONE rows: the shares of a dimension sum to 1
    base = base.join(F.broadcast(heavy), ["k1", "k2", "k3"], "left")
    mean = total[0] / total[2]
    length = F.when(F.col("size") < mean / 4, 0).when(F.col("size") < mean, 1).when(F.col("size") < 4 * mean, 2).otherwise(3)
    bundle = F.concat(F.lit("b"), length.cast("string"), F.lit("."), F.pmod("k1", F.lit(BUNDLES)).cast("string"))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pieces"))).otherwise(F.lit(0))
    whole = F.concat_ws(".", F.lit("g"), F.col("k1").cast("string"), F.col("k2").cast("string"), F.col("k3").cast("string"), piece.cast("string"))
    base = base.withColumn("item", F.when(F.col("pieces").isNull(), bundle).otherwise(whole))

    items = sorted(map(tuple, base.groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()))
    shards = place(np.array([x[1:] for x in items], dtype=np.float64).reshape(len(items), 3), n_shards)
    table = spark.createDataFrame([(x[0], int(s)) for x, s in zip(items, shards, strict=True)], "item string, shard int")
    return with_slots(base.join(F.broadcast(table), "item"), rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def with_slots(placed: DataFrame, rows: int) -> DataFrame:
    """Number the rows of each shard from 0: within hash buckets of a shard, from an offset that the
    sums of the buckets before give, so no task holds a whole shard."""
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets_for(rows))))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place_in = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return placed.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.row_number().over(place_in) - 1)
