"""Rows of asked keys from the newest log files backwards, reading no older file than they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators.lookup import among, key_moves, led_from
from relog.operators.replay import END, START, chain_roots, incarnations, key_events, value_at
from relog.operators.running import reliable
from relog.sources.changelog import TableSchema, of_table, read_changelog
from relog.sources.files import log_files


def stretch(changes: DataFrame, n_columns: list[str]) -> DataFrame:
    """What a stretch of one table's log did to rows: pk, alive, root_pk, born, v0, v1, ...

    One row for each key that has events in it, about the row that the key stands for at its end: alive is false where
    the last event ended it. The row was born in the stretch, or stood at root_pk when it began; v0, v1, ... are the last
    values set (null: not set). A key's events before its first start belong to a row from before the stretch."""
    key, values = ["db", "tbl"], [f"v{i}" for i in range(len(n_columns))]
    seq, kind = F.col("seq"), F.col("kind")
    events = key_events(changes).select(*key, "pk", "seq", "kind", "moved", *[value_at(F.col("cols"), c).alias(v) for c, v in zip(n_columns, values, strict=True)])
    last = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(seq.alias("seq"), F.col(f"{v}.v").alias("v")))).alias(v)
    found = reliable(
        incarnations(events)
        .groupBy("pk", *reversed(key), "inc")
        .agg(
            F.min(F.when(kind == START, seq)).alias("start_seq"),
            F.min(F.when(kind == END, seq)).alias("end_seq"),
            F.coalesce(F.max((kind == START) & F.col("moved")), F.lit(False)).alias("from_move"),
            F.coalesce(F.min_by("moved", F.when(kind == END, seq)), F.lit(False)).alias("moved_away"),
            *[last(v) for v in values],
        )
        .withColumn("id", F.struct("pk", "inc"))
    )
    newest = found.groupBy("pk").agg(F.max_by(F.struct("id", F.col("end_seq").isNull().alias("alive")), "inc").alias("n")).select("pk", "n.id", "n.alive")
    ends = found.where("moved_away").select(*key, F.col("end_seq").alias("start_seq"), F.col("id").alias("up"))
    linked = found.where("from_move").join(ends, [*key, "start_seq"], "left").select(*key, "id", "up")
    links = linked.unionByName(found.where(~F.col("from_move")).select(*key, "id", F.lit(None).cast(found.schema["id"].dataType).alias("up")))
    roots = chain_roots(links)
    chains = found.join(roots, [*key, "id"]).groupBy("root").agg(*[F.max(v).alias(v) for v in values])
    of_pk = newest.join(roots.select("id", "root"), "id").join(chains, "root")
    return of_pk.select("pk", "alive", F.col("root.pk").alias("root_pk"), (F.col("root.inc") > 0).alias("born"), *[F.when(F.col(v).isNotNull(), F.struct(F.col(f"{v}.v").alias("v"))).alias(v) for v in values])


def latest_rows(spark: SparkSession, path: str, db: str, tbl: str, keys: DataFrame, schema: TableSchema) -> tuple[DataFrame, list[int]]:
    """The rows of keys (ord, pk) in the list's order, as key_list_query gives them, of a valid log's files under path; and
    the numbers of the files that were read.

    The newest file is read first, then as many files before it as were read so far (1, 1, 2, 4, ...). A key's request keeps the values found so far,
    which are newer than all that follow, and goes on at the key where its row stood before; it leaves when all its columns
    are set, or its row's insert or end was met. When no request is left, older files aren't read. Each step drops the
    lines of keys that no open request could lead to before it takes lines apart."""
    values = [f"v{i}" for i in range(len(schema.values))]
    asked = reliable(keys.select("ord", F.col("pk").cast(L.KEY_TYPE).alias("pk")))
    unset = [F.lit(None).cast("struct<v:string>").alias(v) for v in values]
    open_ = reliable(asked.where("pk is not null").select("pk").distinct().select("pk", F.col("pk").alias("at"), *unset))
    files = log_files(spark, path)
    left, read, done = list(files), [], []
    while left and not open_.isEmpty():
        some, left = left[-max(1, len(read)) :], left[: -max(1, len(read))]
        read += some
        changes = of_table(read_changelog(spark, [files[n] for n in some]), db, tbl)
        wanted = open_.select(F.col("at").alias("pk")).distinct()
        moves = key_moves(changes)
        into = moves.join(wanted, F.col("new_pk") == F.col("pk"), "left_semi")
        if not into.isEmpty():
            wanted = wanted.unionByName(led_from(moves, into).select("pk"))
        here = stretch(among(changes, wanted), schema.values).select(F.col("pk").alias("at"), "alive", "root_pk", "born", *[F.col(v).alias(f"here_{v}") for v in values])
        filled = [F.coalesce(F.col(v), F.when(F.col("alive"), F.col(f"here_{v}"))).alias(v) for v in values]
        stepped = open_.join(here, "at", "left").where(F.col("alive").isNull() | F.col("alive"))  # an ended row is no row
        stepped = stepped.select("pk", F.coalesce("root_pk", "at").alias("at"), F.coalesce("born", F.lit(False)).alias("born"), *filled)
        settled = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values], F.lit(bool(values)))
        stepped = reliable(stepped.withColumn("settled", F.col("born") | settled))
        done.append(stepped.where("settled").select("pk", *values))
        open_ = stepped.where(~F.col("settled")).select("pk", "at", *values)
    none = open_.limit(0).select("pk", *values)
    rows = reduce(DataFrame.unionByName, done, none)
    place = {c: F.col(f"{v}.v") for c, v in zip(schema.values, values, strict=True)}
    table = rows.select(F.col("pk").alias("_pk"), *[(F.col("pk") if is_key else schema.of(name, place[name])).alias(name) for name, _, is_key in schema.columns])
    return asked.join(table, F.col("pk") == F.col("_pk")).select("ord", *[table[n] for n, _, _ in schema.columns]).orderBy("ord"), read
