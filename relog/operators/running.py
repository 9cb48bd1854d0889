"""Running sums and last values along the order of each key, without a task that holds a key of very many rows.

Keys are counted together, by hash buckets. Those of common buckets, which have few rows, are worked on by one window
over the key. Keys of buckets with more rows than a task should hold are cut along their order into blocks (file
number and split of the log): a window runs inside a block of a key; what the blocks before it hold comes from one
row for each key and block. So a key with a third of all rows is worked on in as many tasks as it has blocks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = ("db", "tbl", "pk")
#: Hash buckets that keys are counted by. A bucket of more rows than HELD and than LARGE times the mean is cut into blocks.
BUCKETS, HELD, LARGE = 4096, 1_000_000, 4


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the session's spark.checkpoint.dir: ids that depend on how the log
    was split are never made twice."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local session uses a folder of its own and a
    cluster raises an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="relog-")


def running(df: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, keys: tuple[str, ...] = KEYS, held: int = HELD) -> DataFrame:
    """Adds, for rows with seq (file_no, block_start, rid): each of sums, up to and with the row; each of
    lasts, the last value before the row that isn't null.

    The rows are checkpointed once, so what made them (reading and parsing a log) runs once, though the count of the
    buckets and the windows read them: give only the columns that are needed. One number a bucket reaches the driver."""
    sums, lasts = sums or {}, lasts or {}
    df = reliable(df.withColumns({f"_in_{n}": c for n, c in (sums | lasts).items()}))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()
    most = max(held, LARGE * sum(r["n"] for r in counts) // BUCKETS)
    large = [r["bucket"] for r in counts if r["n"] > most]
    if not large:
        return whole(df, list(sums), list(lasts), keys)
    has = bucket.isin(large)
    return whole(df.where(~has), list(sums), list(lasts), keys).unionByName(in_blocks(df.where(has), list(sums), list(lasts), keys))


def windows(rows: W, sums: list[str], lasts: list[str], to: str) -> list[Column]:
    """Columns with the sums up to a row and the last values before it, in a window's order."""
    upto, before = rows.rowsBetween(W.unboundedPreceding, 0), rows.rowsBetween(W.unboundedPreceding, -1)
    return [*[F.sum(f"_in_{n}").over(upto).alias(f"{to}{n}") for n in sums], *[F.last(f"_in_{n}", ignorenulls=True).over(before).alias(f"{to}{n}") for n in lasts]]


def whole(df: DataFrame, sums: list[str], lasts: list[str], keys: tuple[str, ...]) -> DataFrame:
    """One window over each key; the result stays dealt by the keys. The sort begins with what tells most rows apart,
    the last of the keys: Spark compares the first column's leading bytes before it looks at rows."""
    kept = [c for c in df.columns if not c.startswith("_in_")]
    return df.select(*kept, *windows(W.partitionBy(*reversed(keys)).orderBy("seq"), sums, lasts, ""))


def in_blocks(df: DataFrame, sums: list[str], lasts: list[str], keys: tuple[str, ...]) -> DataFrame:
    """A window over each block of a key, and one over the rows that stand for blocks."""
    kept = [c for c in df.columns if not c.startswith("_in_")]
    df = df.withColumns({"_file": F.col("seq.file_no"), "_block": F.col("seq.block_start")})
    at = [*keys, "_file", "_block"]
    totals = df.groupBy(*at).agg(
        *[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums],
        *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col("seq"))).alias(f"_of_{n}") for n in lasts],
    )
    earlier = W.partitionBy(*keys).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*at, *[F.sum(f"_of_{n}").over(earlier).alias(f"_to_{n}") for n in sums], *[F.last(f"_of_{n}", ignorenulls=True).over(earlier).alias(f"_to_{n}") for n in lasts])
    both = df.select("*", *windows(W.partitionBy(*at).orderBy("seq"), sums, lasts, "_at_")).join(carry, at)
    made = {n: F.coalesce(F.col(f"_to_{n}"), F.lit(0)) + F.col(f"_at_{n}") for n in sums} | {n: F.coalesce(F.col(f"_at_{n}"), F.col(f"_to_{n}")) for n in lasts}
    return both.select(*kept, *[c.alias(n) for n, c in made.items()])
