"""Change logs derived from the tables orders and events, whose final state SQL can state in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.sources.changelog import parse

#: Orders move up by this much; no key of the table reaches it.
STEP = 100_000_000
#: Rows of a key range that make one block of the derived log.
BLOCK = 65_536
DB, ORDERS, USERS = "shop", "orders", "users"


def seq(phase: int | Column, place: Column) -> Column:
    """Order of a derived log: phase, then place."""
    number = F.lit(phase) if isinstance(phase, int) else phase
    return F.struct(number.cast("int").alias("file_no"), F.floor(place / BLOCK).cast("long").alias("block_start"), place.cast("long").alias("rid"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of few files over all cores, as making and parsing lines costs more than reading."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, seq of a log over orders: 1 insert all; 2 update priority of every third key; 3 set status
    to NULL for every eleventh; 4 move every fifth key up; 5 move every 25th again, with a new status;
    6 delete every seventh key's row; 7 insert anew at every 35th key, which moves have vacated."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    k, phase, none = F.col("k"), F.col("phase"), F.lit(None).cast("string")
    third = k + F.when(k % 25 == 0, 2 * STEP).when(k % 5 == 0, STEP).otherwise(0)
    status = F.when(k % 11 == 0, none).otherwise(F.col("status"))
    priority = F.when(k % 3 == 0, F.concat(F.lit("P"), (k % 10).cast("string"))).otherwise(F.col("priority"))

    def triple(name: str, kind: int, old: dict[int, Column], new: dict[int, Column], is_key: bool = False) -> Column:
        """A column's fields of a line of each phase that has an old or a new value for it."""
        in_phase = lambda values: F.coalesce(*[F.when(phase == p, v.cast("string")) for p, v in values.items()])
        return F.when(phase.isin(sorted(old.keys() | new.keys())), L.triple_text(name, kind, is_key, in_phase(old), in_phase(new)))

    op = F.when(phase.isin(1, 7), L.INSERT).when(phase == 6, L.DELETE).otherwise(L.UPDATE)
    value = L.line_text(
        F.concat(F.lit("b"), phase.cast("string"), F.lit(":"), k), F.lit(1_500_000_000_000) + k % 1000, DB, ORDERS, op,
        triple("id", L.NUMBER, {2: k, 3: k, 4: k, 5: k + STEP, 6: third}, {1: k, 2: k, 3: k, 4: k + STEP, 5: third, 7: k}, True),
        triple("status", L.STRING, {3: F.col("status"), 5: status, 6: F.when(k % 25 == 0, "M").otherwise(status)}, {1: F.col("status"), 5: F.lit("M"), 7: F.col("status")}),
        triple("priority", L.STRING, {2: F.col("priority"), 6: priority}, {1: F.col("priority"), 2: priority, 7: F.lit("RE")}),
        *[triple(c, L.NUMBER, {6: F.col(c)}, {1: F.col(c), 7: F.col(c)}) for c in ("cust", "cents")],
    )
    phases = F.array(F.lit(1), *[F.when(k % n == 0, p) for p, n in ((2, 3), (3, 11), (4, 5), (5, 25), (6, 7), (7, 35))])
    # one expression for the lines of all phases: with seven, the generated method is too large for the JVM to compile
    return o.select("*", F.explode(phases).alias("phase")).where(phase.isNotNull()).select(value.alias("value"), seq(phase, k).alias("seq"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, seq of a log over events, keyed by user: a user's first event is an insert, each later one
    an update of kind and amount."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    e = spread(e).join(first, "user_id")
    none, is_first = F.lit(None).cast("string"), F.col("event_id") == F.col("first_id")
    ident = L.triple_text("user", L.NUMBER, True, F.when(~is_first, F.col("user_id")), F.col("user_id"))
    value = L.line_text(F.concat(F.lit("e:"), "event_id"), F.col("event_id"), DB, USERS, F.when(is_first, L.INSERT).otherwise(L.UPDATE), ident, L.triple_text("kind", L.STRING, False, none, F.col("event_type")), L.triple_text("cents", L.NUMBER, False, none, F.col("cents")))
    return e.select(value.alias("value"), seq(1, F.col("event_id")).alias("seq"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(order_lines(spark, sf_dir))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(event_lines(spark, sf_dir))


def both_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two tables whose keys overlap."""
    return parse(order_lines(spark, sf_dir).unionByName(event_lines(spark, sf_dir)))
