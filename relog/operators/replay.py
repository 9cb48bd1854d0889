"""Replay: from changes to key events, incarnations of keys, chains of key moves, and table state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators.running import reliable, running
from relog.sources.changelog import TableSchema, infer_schema, of_table

START, MOD, END = "START", "MOD", "END"


def key_events(changes: DataFrame) -> DataFrame:
    """db, tbl, pk, seq, op, kind, moved, cols, ts_ms: one event for an insert, delete or plain update, two for an
    update that moves the key (END of the old key and START of the new one, both marked as moved).

    Changes without a usable key or with another operation give no event."""
    return events_of(changes, {"cols": F.array().cast(f"array<{L.COL_TYPE}>")})


def value_events(changes: DataFrame, schema: TableSchema) -> DataFrame:
    """key_events with v0, v1, ..., value_at of each of the schema's columns, instead of cols (ENDs set none)."""
    values = [f"v{i}" for i in range(len(schema.values))]
    told = from_fields(changes, schema) if "parts" in changes.columns else changes.select("*", *[value_at(F.col("cols"), c).alias(v) for c, v in zip(schema.values, values, strict=True)])
    return events_of(told, dict.fromkeys(values, F.lit(None).cast("struct<v:string>")))


def from_fields(changes: DataFrame, schema: TableSchema) -> DataFrame:
    """db, tbl, seq, ts_ms, op, old_pk, new_pk, v0, v1, ... of changes that have their fields.

    Where a line's key is its first column and each of its columns is one of the schema's, with its type, the places
    of the columns' heads tell all: as many as there are columns, so none is there twice or under another type. Only
    for other lines cols are made. Spark compiles all for the first kind; the steps stand in generators of one row,
    which keep each within a method that the JVM compiles, and don't copy the fields into a row."""
    n, key = len(schema.values), next(f"{name}:{kind}:1" for name, kind, is_key in schema.columns if is_key)
    heads = [f"{name}:{kind}:0" for name, kind, is_key in schema.columns if not is_key]
    parts, p = F.col("parts"), [F.col(f"p.p{i}") for i in range(n)]
    one = lambda *columns: F.explode(F.array(F.struct(*columns)))
    found = changes.select("db", "tbl", "seq", "ts_ms", "op", "parts", one(F.lit(0).alias("none"), *[F.array_position(parts, F.lit(h)).cast("int").alias(f"p{i}") for i, h in enumerate(heads)]).alias("p"))
    is_head = [(at > L.HEADER) & (at % 3 == (L.HEADER + 1) % 3) for at in p]
    n_found = sum([h.cast("int") for h in is_head], F.lit(1))
    plain = (F.get(parts, F.lit(L.HEADER)) == key) & (F.size(parts) == n_found * 3 + L.HEADER)
    number = lambda i: L.decoded(F.get(parts, F.lit(L.HEADER + i))).try_cast(L.KEY_TYPE)
    values = [F.when(h, F.struct(L.decoded(F.get(parts, at + 1)).alias("v"))).alias(f"v{i}") for i, (h, at) in enumerate(zip(is_head, p, strict=True))]
    read = found.select("db", "tbl", "seq", "ts_ms", one("op", number(1).alias("old"), number(2).alias("new"), F.when(~F.coalesce(plain, F.lit(False)), parts).alias("odd"), *values).alias("x"))
    odd = F.col("x.odd")
    others = lambda usual, other: F.when(odd.isNull(), F.col(f"x.{usual}")).otherwise(other)
    keys = [others(side, L.key_of(odd, side)).alias(f"{side}_pk") for side in ("old", "new")]
    in_cols = [others(f"v{i}", value_at(L.column_changes(odd), c)).alias(f"v{i}") for i, c in enumerate(schema.values)]
    return read.select("db", "tbl", "seq", "ts_ms", F.col("x.op").alias("op"), *keys, *in_cols)


def events_of(changes: DataFrame, says: dict[str, Column]) -> DataFrame:
    """Key events that carry some columns of their changes; says gives what ENDs have instead.

    The array of events always has two places: for one that may be empty, Spark makes a filter that works out
    the array once more."""
    op, old, new = F.col("op"), F.col("old_pk"), F.col("new_pk")
    moves = F.coalesce((op == L.UPDATE) & (old != new), F.lit(False))
    kind = F.when((op == L.INSERT) & new.isNotNull(), START).when(((op == L.DELETE) & old.isNotNull()) | moves, END).when((op == L.UPDATE) & (old == new), MOD)
    event = lambda pk, kind, moved: F.struct(pk.alias("pk"), kind.alias("kind"), moved.alias("moved"))
    events = F.array(event(F.when(op == L.INSERT, new).otherwise(old), kind, moves), F.when(moves, event(new, F.lit(START), F.lit(True))))
    exploded = changes.select("db", "tbl", "seq", "op", "ts_ms", *says, F.explode(events).alias("e")).where(F.col("e.kind").isNotNull())
    return exploded.select("db", "tbl", "e.pk", "seq", "op", "e.kind", "e.moved", *[F.when(F.col("e.kind") == END, none).otherwise(F.col(c)).alias(c) for c, none in says.items()], "ts_ms")


def incarnations(events: DataFrame) -> DataFrame:
    """Adds inc: how many rows the key has stood for so far; 0 means an update or delete of no row."""
    return running(events, sums={"inc": (F.col("kind") == START).cast("long")})


def value_at(cols: Column, name: str) -> Column:
    """Struct of a column's new value if the change has the column, else null: an assignment of NULL is
    not the same as no assignment. The column is found by expressions that Spark compiles, as functions with lambdas
    are interpreted, for each column and event."""
    at = F.array_position(F.arrays_zip(cols["name"].alias("name"), cols["is_pk"].alias("is_pk")), F.struct(F.lit(name).alias("name"), F.lit(False).alias("is_pk")))
    return F.when(at > 0, F.struct(F.get(cols, (at - 1).cast("int"))["new"].alias("v")))


def segments(changes: DataFrame, schema: TableSchema) -> DataFrame:
    """One row for each incarnation of a key: start_seq, end_seq, from_move, moved_away, and for each
    column the last value set in it with its seq."""
    seq = F.col("seq")
    events = incarnations(value_events(changes, schema).drop("op", "ts_ms")).where(F.col("inc") > 0)
    aggregates = [
        F.min(F.when(F.col("kind") == START, seq)).alias("start_seq"),
        F.min(F.when(F.col("kind") == END, seq)).alias("end_seq"),
        F.max((F.col("kind") == START) & F.col("moved")).alias("from_move"),
        F.min_by("moved", F.when(F.col("kind") == END, seq)).alias("moved_away"),
    ]
    for i in range(len(schema.values)):
        aggregates.append(F.max(F.when(F.col(f"v{i}").isNotNull(), F.struct(seq.alias("seq"), F.col(f"v{i}.v").alias("v")))).alias(f"v{i}"))
    return events.groupBy("pk", "tbl", "db", "inc").agg(*aggregates)


def chain_roots(links: DataFrame) -> DataFrame:
    """db, tbl, id, root of links (db, tbl, id, up): the last that following up from id leads to; a null up, or one
    that is no id, ends a chain.

    Pointers double: the rounds are the logarithm of the longest chain, each ends in a reliable checkpoint. What has
    reached its root leaves the loop; the parts found in each round are put together once, at the end."""
    key = ["db", "tbl"]
    known = links.select(*key, F.col("id").alias("up")).withColumn("is_id", F.lit(True))
    pointers = reliable(links.join(known, [*key, "up"], "left").select(*key, "id", F.when(F.col("is_id"), F.col("up")).alias("up")))
    return doubled(pointers.where("up is null").select(*key, "id", F.col("id").alias("root")), pointers.where("up is not null"))


def doubled(rooted: DataFrame, open_: DataFrame) -> DataFrame:
    """db, tbl, id, root of rows whose root is known, and of others (db, tbl, id, up) that follow up to these."""
    key, found = ["db", "tbl"], [rooted]
    while not open_.isEmpty():
        at_root = reduce(DataFrame.unionByName, found).select(*key, F.col("id").alias("up"), "root")
        hop = open_.select(*key, F.col("id").alias("up"), F.col("up").alias("next"))
        stepped = reliable(open_.join(at_root, [*key, "up"], "left").join(hop, [*key, "up"], "left"))
        found.append(stepped.where("root is not null").select(*key, "id", "root"))
        rest = stepped.where("root is null")
        if rest.where("next is null").limit(1).count():
            raise ValueError("a chain leads nowhere")
        open_ = rest.select(*key, "id", F.col("next").alias("up"))
    return reduce(DataFrame.unionByName, found)


def roots(moved: DataFrame) -> DataFrame:
    """db, tbl, start_seq, root: the first segment of the chain of moves that each of the segments that a move began is
    in. Such a segment follows the one that the same move ended; where no move began that one, it is the root, so
    only those of the second move of a chain and of later ones take part in pointer doubling."""
    key = ["db", "tbl"]
    ends = moved.where("moved_away").select(*key, F.col("end_seq").alias("id"), F.col("start_seq").alias("up"), F.col("from_move").alias("goes_on"))
    begun = moved.where("from_move").select(*key, F.col("start_seq").alias("id"))
    found = reliable(begun.join(ends, [*key, "id"], "left"))
    rooted = found.where("up is null or not goes_on").select(*key, "id", F.coalesce("up", "id").alias("root"))
    return doubled(rooted, found.where("goes_on").select(*key, "id", "up")).withColumnRenamed("id", "start_seq")


def replay(changes: DataFrame, db: str, tbl: str, schema: TableSchema | None = None) -> DataFrame:
    """The final rows of a table, columns in the order of its first insert.

    Segments that no move touches are final as they are. Only those in a chain of moves meet again: by
    their chain's root, where for each column the latest value wins, under the key of the one segment
    that has not ended. A chain without one was deleted."""
    changes = of_table(changes, db, tbl)
    schema = schema or infer_schema(changes, db, tbl)
    found = reliable(segments(changes, schema))
    values = [f"v{i}" for i in range(len(schema.values))]
    alone = found.where(~F.col("from_move") & F.col("end_seq").isNull()).select("pk", *values)
    moved = found.where(F.col("from_move") | F.coalesce("moved_away", F.lit(False)))
    rows = alone
    if not moved.isEmpty():
        begun = moved.where("from_move")
        chains = begun.join(roots(moved), ["db", "tbl", "start_seq"]).unionByName(moved.where("not from_move").withColumn("root", F.col("start_seq")))
        live = F.when(F.col("end_seq").isNull(), F.col("pk"))
        merged = chains.groupBy("db", "tbl", "root").agg(F.max(live).alias("pk"), *[F.max(v).alias(v) for v in values])
        rows = alone.unionByName(merged.where(F.col("pk").isNotNull()).select("pk", *values))
    place = {c: F.col(f"v{i}.v") for i, c in enumerate(schema.values)}
    return rows.select(*[(F.col("pk") if is_key else schema.of(name, place[name])).alias(name) for name, _, is_key in schema.columns])


def inherited(ends: DataFrame, n: int) -> DataFrame:
    """db, tbl, child, v0, v1, ...: for each segment that a move began (child: its place), the values that the
    segments before it in its chain had set.

    ends: for each move, db, tbl, child, up (the place where the segment that it ended began, if a move began that
    one too) and the values that this segment had set by then. Pointers double over the chains, and with each hop
    what lies farther back fills what nearer segments left unset: logarithmic rounds, each a checkpoint."""
    key, values = ["db", "tbl"], [f"v{i}" for i in range(n)]
    open_, found = reliable(ends.select(*key, "child", "up", *values)), []
    while True:
        found.append(open_.where("up is null"))
        if open_.where("up is not null").isEmpty():
            return reduce(DataFrame.unionByName, found).select(*key, "child", *values)
        back = reduce(DataFrame.unionByName, [*found, open_.where("up is not null")]).select(*key, F.col("child").alias("up"), F.col("up").alias("next"), *[F.col(v).alias(f"far_{v}") for v in values])
        stepped = open_.where("up is not null").join(back, [*key, "up"], "left")
        open_ = reliable(stepped.select(*key, "child", F.col("next").alias("up"), *[F.coalesce(v, f"far_{v}").alias(v) for v in values]))


def running_state(changes: DataFrame, columns: list[str]) -> DataFrame:
    """The state of each row after each of its key's events: db, tbl, pk, inc, seq, kind and the columns' text (null
    where NULL was assigned or nothing yet). A row keeps its values when a move changes its key.

    One pass carries, along each key, what was set since its row's first event there; only rows of segments that a move
    began go on: they get what their chain had set before (inherited), from the segment's first event on."""
    keys, n = ("db", "tbl", "pk"), len(columns)
    starts, seq = F.col("kind") == START, F.col("seq")
    values, local = [f"v{i}" for i in range(n)], [f"_at{i}" for i in range(n)]
    events = key_events(changes).select(*keys, "seq", "kind", "moved", *[value_at(F.col("cols"), c).alias(v) for c, v in zip(columns, values, strict=True)])
    # what an event says of a column: a value, or, at a start, that there is none yet
    says = {v: F.when(starts | F.col(v).isNotNull(), F.struct(F.col(v).alias("set"))) for v in values}
    first = F.when(starts, F.struct(seq.alias("seq"), F.col("moved").alias("moved")))
    carried = running(events, sums={"inc": starts.cast("long")}, lasts={f"_old_{v}": c for v, c in says.items()} | {"_first": first})
    now = {at: F.coalesce(says[v], F.col(f"_old_{v}"))["set"] for at, v in zip(local, values, strict=True)}
    begun = F.coalesce(first, F.col("_first"))
    rows = reliable(carried.where("inc > 0").select(*keys, "inc", "seq", "kind", "moved", begun["seq"].alias("begun"), begun["moved"].alias("from_move"), *[c.alias(at) for at, c in now.items()]))
    told = lambda df, at: df.select(*keys, "inc", "seq", "kind", *[c["v"].alias(name) for c, name in zip(at, columns, strict=True)])
    moved = rows.where("from_move")
    if moved.isEmpty():
        return told(rows, [F.col(a) for a in local])
    ends = rows.where((F.col("kind") == END) & F.col("moved")).select("db", "tbl", F.col("seq").alias("child"), F.when(F.col("from_move"), F.col("begun")).alias("up"), *[F.col(a).alias(v) for a, v in zip(local, values, strict=True)])
    chain = inherited(ends, n).withColumnRenamed("child", "seq")
    starting = moved.where(starts).join(chain, ["db", "tbl", "seq"], "left")
    others = moved.where(~starts).select("*", *[F.lit(None).cast("struct<v:string>").alias(v) for v in values])
    whole = running(starting.unionByName(others), lasts={f"_from_{v}": F.col(v) for v in values}, keys=(*keys, "inc"))
    filled = [F.coalesce(F.col(a), F.col(v), F.col(f"_from_{v}")) for a, v in zip(local, values, strict=True)]
    return told(rows.where(~F.col("from_move")), [F.col(a) for a in local]).unionByName(told(whole, filled))
