"""Queries over a replayed table and over a key's history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relog.functions import logline as L
from relog.operators.replay import END, doubled, key_events, replay
from relog.operators.running import reliable, running
from relog.sources.changelog import TableSchema, infer_schema, of_table


@dataclass(frozen=True)
class RangeQuery:
    """Rows of db.tbl whose key lies between start and end, neither included."""

    db: str
    tbl: str
    start: int
    end: int


def key(value: int) -> Column:
    return F.lit(str(value)).cast(L.KEY_TYPE)


#: Keys that are listed in the lines' filter, keys that are broadcast; more meet the lines by a shuffle.
LISTED_KEYS, BROADCAST_KEYS = 5_000, 500_000


def key_moves(changes: DataFrame) -> DataFrame:
    """db, tbl, seq, old_pk, new_pk of the updates that move a key, checkpointed."""
    return reliable(changes.where((F.col("op") == L.UPDATE) & (F.col("old_pk") != F.col("new_pk"))).select("db", "tbl", "seq", "old_pk", "new_pk"))


def led_from(moves: DataFrame, into: DataFrame) -> DataFrame:
    """db, tbl, pk: every key from which a chain of moves led to one of the moves in `into` (part of moves).

    The move before a move is the last one into the key that it leaves, so chains are found by one as-of join and
    pointer doubling: rounds are the logarithm of the longest chain. Keys of earlier moves in the chain are returned also
    where a delete and an insert came in between, so there may be more keys than needed, never fewer."""
    same = ["db", "tbl"]
    told = moves.select(*same, F.col("new_pk").alias("pk"), "seq", F.col("seq").alias("id"))
    before = as_of_join(told, moves.select(*same, F.col("old_pk").alias("pk"), "seq"))
    links = reliable(before.select(*same, F.col("seq").alias("id"), F.col("state.id").alias("up")))  # each up is a move's place
    rooted = links.where("up is null").select(*same, "id", F.col("id").alias("root"))
    chains = reliable(doubled(rooted, links.where("up is not null")).withColumnRenamed("id", "seq"))
    wanted = into.select(*same, "seq").join(chains, [*same, "seq"]).groupBy(*same, "root").agg(F.max("seq").alias("upto"))
    return moves.join(chains, [*same, "seq"]).join(wanted, [*same, "root"]).where("seq <= upto").select(*same, F.col("old_pk").alias("pk")).distinct()


def among(changes: DataFrame, keys: DataFrame, also: Column | None = None) -> DataFrame:
    """The changes of one table of which the old or the new key is among keys (pk), or that `also` holds for. The keys'
    number is looked at: few become part of the lines' filter, more are broadcast, beyond that they meet the lines
    by a shuffle. Lines are taken apart only where they pass, as filters and semi-joins go below that."""
    keys = reliable(keys.select(F.col("pk").alias("_pk")).where("_pk is not null").distinct())
    n, old, new = keys.count(), F.col("old_pk"), F.col("new_pk")
    if n <= LISTED_KEYS:
        listed = [F.lit(str(r[0])).cast(L.KEY_TYPE) for r in keys.collect()]
        has = F.coalesce(old.isin(listed), F.lit(False)) | F.coalesce(new.isin(listed), F.lit(False))
        return changes.where(has if also is None else has | also)
    known, rest = (F.broadcast(keys) if n <= BROADCAST_KEYS else keys), changes if also is None else changes.where(~also)
    led_in = rest.where((F.col("op") == L.UPDATE) & (old != new)).join(known, old == F.col("_pk"), "left_anti").join(known, new == F.col("_pk"), "left_semi")
    found = rest.join(known, F.coalesce(old, new) == F.col("_pk"), "left_semi").unionByName(led_in)
    return found if also is None else found.unionByName(changes.where(also))


def of_rows(changes: DataFrame, asked: Callable[[Column], Column]) -> DataFrame:
    """The changes (of one table) that replay needs for the rows whose key is asked for in the end: those of the keys themselves and
    of all keys from which moves could have led to them. All others are dropped before lines are taken apart."""
    has = F.coalesce(asked(F.col("old_pk")), F.lit(False)) | F.coalesce(asked(F.col("new_pk")), F.lit(False))
    moves = key_moves(changes)
    into = moves.where(asked(F.col("new_pk")))
    if into.isEmpty():
        return changes.where(has)
    return among(changes, led_from(moves, into), has)


def range_query(changes: DataFrame, query: RangeQuery, schema: TableSchema | None = None) -> DataFrame:
    """The rows of the range in key order. A row may be born outside of the range and move in, so replay gets the
    range's keys and those that moves led from. Spark sorts by range partitions, so no task holds the whole result."""
    changes = of_table(changes, query.db, query.tbl)
    schema = schema or infer_schema(changes, query.db, query.tbl)
    inside = lambda pk: (pk > key(query.start)) & (pk < key(query.end))
    pk = F.col(schema.key)
    return replay(of_rows(changes, inside), query.db, query.tbl, schema).where(inside(pk)).orderBy(pk)


def point_query(changes: DataFrame, db: str, tbl: str, pk: int, schema: TableSchema | None = None) -> DataFrame:
    """The row of one key, or none; only lines of keys that could have led to it are replayed."""
    changes = of_table(changes, db, tbl)
    schema = schema or infer_schema(changes, db, tbl)
    is_key = lambda c: c == key(pk)
    return replay(of_rows(changes, is_key), db, tbl, schema).where(is_key(F.col(schema.key)))


def key_list_query(changes: DataFrame, db: str, tbl: str, keys: DataFrame, schema: TableSchema | None = None) -> DataFrame:
    """Rows for a list of keys (ord, pk), in the list's order; keys without a row give none, and keys
    listed twice give two. Only lines of keys that could have led to one of them are replayed."""
    changes = of_table(changes, db, tbl)
    schema = schema or infer_schema(changes, db, tbl)
    asked = reliable(keys.select("ord", F.col("pk").cast(L.KEY_TYPE).alias("_pk")))
    wanted = asked.select(F.col("_pk").alias("pk")).distinct()
    moves = key_moves(changes)
    into = moves.join(wanted, F.col("new_pk") == F.col("pk"), "left_semi")
    if not into.isEmpty():
        wanted = wanted.unionByName(led_from(moves, into).select("pk"))
    rows = replay(among(changes, wanted), db, tbl, schema)
    return asked.join(rows, F.col("_pk") == F.col(schema.key)).drop("_pk").orderBy("ord")


def history(changes: DataFrame, pk: int) -> DataFrame:
    """All events of a key, newest first."""
    of_key = changes.where((F.col("old_pk") == key(pk)) | (F.col("new_pk") == key(pk)))  # before lines are taken apart
    return key_events(of_key).where(F.col("pk") == key(pk)).orderBy(F.col("seq").desc())


def as_of(changes: DataFrame, upto: Column) -> DataFrame:
    """Changes up to and with a place in the log (a struct like seq); replay of these is the state then."""
    return changes.where(F.col("seq") <= upto)


def as_of_join(states: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("db", "tbl", "pk")) -> DataFrame:
    """For each row of asked (keys, seq) the newest of states (keys, seq, other columns) of that key strictly before
    seq: keys, seq, state (a struct of the other columns; null where there is none).

    Both are put in one order and the last state is carried on in blocks (running), so a hot key is many tasks."""
    state = F.struct(*[F.col(c) for c in states.columns if c not in keys])
    # at equal places a question comes before the states
    place = lambda last: F.struct("seq.file_no", "seq.block_start", (F.col("seq.rid") * 2 + last).alias("rid"))
    told = states.select(*keys, place(1).alias("seq"), state.alias("_state"))
    both = told.unionByName(asked.select(*keys, place(0).alias("seq"), F.col("seq").alias("_asked")), allowMissingColumns=True)
    found = running(both, lasts={"state": F.col("_state")}, keys=keys).where("_asked is not null")
    return found.select(*keys, F.col("_asked").alias("seq"), "state")


def previous_events(changes: DataFrame) -> DataFrame:
    """Events (without their columns) with the seq of the event before of the same key, null for the first."""
    return running(key_events(changes).drop("cols"), lasts={"prev_seq": F.col("seq")})


def last_events(changes: DataFrame) -> DataFrame:
    """The last event of each key. Spark keeps one row for each key and task before the shuffle."""
    e = F.struct("op", "kind", "moved", "ts_ms")
    return key_events(changes).groupBy("db", "tbl", "pk").agg(F.max("seq").alias("seq"), F.max_by(e, "seq").alias("e")).select("db", "tbl", "pk", "seq", "e.*")


#: Events in a block of a key's list.
LIST_BLOCK = 1000


def event_lists(changes: DataFrame, newest_first: bool = True, block: int = LIST_BLOCK) -> DataFrame:
    """db, tbl, pk, block, events (seq, op): each key's log as arrays of at most `block` events. Blocks are numbered from the
    key's first event on, by a running count, so a key with a third of the log is many rows that many tasks make."""
    numbered = running(key_events(changes).select("db", "tbl", "pk", "seq", "op"), sums={"place": F.lit(1).cast("long")})
    at = F.floor((F.col("place") - 1) / block).cast("long").alias("block")
    events = numbered.groupBy("db", "tbl", "pk", at).agg(F.collect_list(F.struct("seq", "op")).alias("events"))
    return events.withColumn("events", F.sort_array("events", asc=not newest_first))


def tombstones(changes: DataFrame) -> DataFrame:
    """db, tbl, pk of keys that stood for a row once and don't now."""
    return last_events(changes).where(F.col("kind") == END).select("db", "tbl", "pk")


def origins(changes: DataFrame, start: int, end: int) -> DataFrame:
    """db, tbl, pk: the keys of the open range and every key that moves could have brought a row from.
    The set may hold more keys than needed, never fewer, so a semi-join with it before replay is safe.
    Each round steps back over the moves from the keys that the last one added."""
    same = ["db", "tbl", "pk"]
    events = key_events(changes).select(*same).distinct()
    moves = reliable(changes.where((F.col("op") == L.UPDATE) & (F.col("old_pk") != F.col("new_pk"))).select("db", "tbl", F.col("new_pk").alias("pk"), "old_pk").distinct())
    wanted = fresh = reliable(events.where((F.col("pk") > key(start)) & (F.col("pk") < key(end))))
    while not fresh.isEmpty():
        back = fresh.join(moves, same).select("db", "tbl", F.col("old_pk").alias("pk")).distinct()
        fresh = reliable(back.join(wanted, same, "left_anti"))
        wanted = reliable(wanted.unionByName(fresh))
    return wanted


def shards(rows: DataFrame, pk: str, n: int) -> DataFrame:
    """Adds shard: the key modulo n."""
    return rows.withColumn("shard", F.pmod(F.col(pk), F.lit(n)).cast("int"))


def preview(rows: DataFrame, by: str, n: int = 3) -> DataFrame:
    """The first n rows by key."""
    return rows.orderBy(by).limit(n)


def changed_columns(changes: DataFrame) -> DataFrame:
    """seq, op and names of the columns that a change carries, without the key, in the line's order."""
    names = F.transform(F.filter("cols", lambda c: ~c["is_pk"]), lambda c: c["name"])
    return changes.select("db", "tbl", "seq", "op", names.alias("names"))


def numbered_by_key(rows: DataFrame, pk: str, group: str) -> DataFrame:
    """Adds place: the row's number in key order inside its group, from 1. Keys are dealt to ranges; a row's place is that in
    its range's part of the group and the sizes of the parts before. So a group is as many tasks as there are ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = reliable(rows.repartitionByRange(n, pk).withColumn("_range", F.spark_partition_id()))
    part = W.partitionBy(group, "_range")
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_at", F.row_number().over(part.orderBy(pk)))
    on = local[group].eqNullSafe(sizes[group]) & (local["_range"] == sizes["_range"])
    return local.join(sizes, on).select(*[local[c] for c in rows.columns], (F.col("_before") + F.col("_at")).alias("place"))
