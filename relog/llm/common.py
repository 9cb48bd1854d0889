"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and read it back: lineage ends here, and later
    steps survive the loss of any executor. The folder is the session's spark.checkpoint.dir; where that
    is unset, a local session uses a folder of its own and a cluster raises an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="relog-"))
    return df.checkpoint(eager=True)


#: Keys that hold over 1/SPREAD of all rows; there are fewer than SPREAD of them.
SPREAD = 2000


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined (inner) with per_key, which has one row for each key and the number n of the key's rows.

    Keys with more than 1/SPREAD of all rows number fewer than SPREAD, so they are broadcast and their rows
    stay in their tasks; all other rows meet their keys by a shuffle. Both sides are read more than once:
    give checkpoints."""
    total = per_key.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * SPREAD > total
    hot = per_key.where(is_hot)
    held = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(per_key.where(~is_hot), on)
    return held.unionByName(rest)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; split leaves an empty string at either end that begins or ends in white space."""
    parts = F.split(text, SPACE, -1)
    ends = (F.element_at(parts, 1) == "").cast("long") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("long")
    return F.size(parts).cast("long") - ends


def text_key() -> list[Column]:
    """Columns k1, k2, k3 that together stand for a text: 64 + 32 bits of two unrelated hashes, and its length."""
    t = text_of()
    return [F.xxhash64(t).alias("k1"), F.crc32(t).alias("k2"), F.octet_length(t).cast("long").alias("k3")]


def buckets_for(rows: int) -> int:
    """As many buckets as rows in a bucket: neither the buckets' table nor one bucket becomes large."""
    return max(64, math.ceil(math.sqrt(max(rows, 1))))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of an integer's decimal text, modulo n; a null id counts as remainder 1, so it may be learned from."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % n, F.lit(1).cast("long"))


_RNG = np.random.default_rng(5)
_PLACES = _RNG.integers(1, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def scattered(x: np.ndarray) -> np.ndarray:
    """Every 64-bit value to another one, without collisions; all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the shingles of `size` words, A-Z lower-cased, in order; a text of fewer words has
    one of all its words, a wordless one none."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in (text or "").encode().lower().split()], np.uint64)
    n = len(words) - size + 1
    if n <= 0:
        return scattered((words * _PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words))) if len(words) else words
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j : j + n] * _PLACES[j]
    return scattered(out + np.uint64(size))
