"""Registered queries over logs derived from the driver's tables, each with its DuckDB SQL.

The SQL states the results in closed form, so it shares nothing with the replay that it checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators import lookup, stats
from relog.operators.backward import latest_rows
from relog.operators.replay import incarnations, key_events, replay, running_state
from relog.operators.running import shared_folder
from relog.plans.derived import DB, ORDERS, STEP, USERS, both_changes, event_changes, event_lines, order_changes, order_lines, seq
from relog.sources.changelog import TableSchema, infer_schema, lines, of_table, parse, publish_result, read_changelog, read_published, schemas, write_log, write_result
from relog.sources.files import Folder, log_files
from relog.sources.store import EventStore
from relog.streaming.snapshots import State, as_inserts, follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns of the derived tables.
ORDER_SCHEMA = TableSchema((("id", L.NUMBER, True), ("status", L.STRING, False), ("priority", L.STRING, False), ("cust", L.NUMBER, False), ("cents", L.NUMBER, False)))
USER_SCHEMA = TableSchema((("user", L.NUMBER, True), ("kind", L.STRING, False), ("cents", L.NUMBER, False)))
SHARDS = 16
BORN = 1_000_000

COMMON = f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
state AS (
  SELECT k + CASE WHEN k % 25 = 0 THEN {2 * STEP} WHEN k % 5 = 0 THEN {STEP} ELSE 0 END AS id,
         CASE WHEN k % 25 = 0 THEN 'M' WHEN k % 11 = 0 THEN NULL ELSE status END AS status,
         CASE WHEN k % 3 = 0 THEN 'P' || (k % 10) ELSE priority END AS priority, cust, cents
  FROM o WHERE k % 7 <> 0
  UNION ALL SELECT k, status, 'RE', cust, cents FROM o WHERE k % 35 = 0),
log AS (
  SELECT 1 AS phase, k, 'I' AS op, NULL AS old_pk, k AS new_pk FROM o
  UNION ALL SELECT 2, k, 'U', k, k FROM o WHERE k % 3 = 0
  UNION ALL SELECT 3, k, 'U', k, k FROM o WHERE k % 11 = 0
  UNION ALL SELECT 4, k, 'U', k, k + {STEP} FROM o WHERE k % 5 = 0
  UNION ALL SELECT 5, k, 'U', k + {STEP}, k + {2 * STEP} FROM o WHERE k % 25 = 0
  UNION ALL SELECT 6, k, 'D', k + CASE WHEN k % 25 = 0 THEN {2 * STEP} WHEN k % 5 = 0 THEN {STEP} ELSE 0 END, NULL FROM o WHERE k % 7 = 0
  UNION ALL SELECT 7, k, 'I', NULL, k FROM o WHERE k % 35 = 0),
ev AS (
  SELECT new_pk AS pk, CAST(phase AS INTEGER) AS phase, k, op, 'START' AS kind, false AS moved FROM log WHERE op = 'I'
  UNION ALL SELECT old_pk, phase, k, op, 'END', false FROM log WHERE op = 'D'
  UNION ALL SELECT new_pk, phase, k, op, 'MOD', false FROM log WHERE op = 'U' AND old_pk = new_pk
  UNION ALL SELECT old_pk, phase, k, op, 'END', true FROM log WHERE op = 'U' AND old_pk <> new_pk
  UNION ALL SELECT new_pk, phase, k, op, 'START', true FROM log WHERE op = 'U' AND old_pk <> new_pk),
e AS (SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS m FROM events),
el AS (SELECT event_id, user_id, event_type, cents, CASE WHEN n = 1 THEN 'I' ELSE 'U' END AS op,
  '|e:' || event_id || '|' || event_id || '|{DB}|{USERS}|' || CASE WHEN n = 1 THEN 'I' ELSE 'U' END || '|user:1:1|' || CASE WHEN n = 1 THEN 'NULL' ELSE CAST(user_id AS VARCHAR) END || '|' || user_id || '|kind:2:0|NULL|' || event_type || '|cents:1:0|NULL|' || cents || '|' AS line FROM e)
"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with SQL over the tables of COMMON."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = COMMON + sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Keys and numbers as long; the derived logs hold no larger ones."""
    return df.select(*[F.col(c).cast("long").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def placed(*columns: str) -> list[Column]:
    """phase and k of a derived log's seq, after the given columns."""
    return [*[F.col(c) for c in columns], F.col("seq.file_no").alias("phase"), F.col("seq.rid").alias("k")]


def final_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(replay(order_changes(spark, sf_dir), DB, ORDERS, ORDER_SCHEMA))


def orders_range(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    return plain(lookup.range_query(order_changes(spark, sf_dir), lookup.RangeQuery(DB, ORDERS, start, end), ORDER_SCHEMA))


ROW = "id, status, priority, cust, cents"


@query(f"SELECT {ROW} FROM state WHERE id > 100 AND id < {STEP + 50_000}")
def replay_orders_range(spark, sf_dir):
    changes = order_changes(spark, sf_dir)
    return plain(lookup.range_query(changes, lookup.RangeQuery(DB, ORDERS, 100, STEP + 50_000)))  # infers the schema


@query(f"SELECT {ROW} FROM state")
def replay_orders_full(spark, sf_dir):
    return final_orders(spark, sf_dir)


@query('SELECT user_id AS "user", event_type AS kind, cents FROM e WHERE m = 1')
def replay_users_latest(spark, sf_dir):
    return plain(replay(event_changes(spark, sf_dir), DB, USERS, USER_SCHEMA))


@query("SELECT id, priority FROM state WHERE status IS NULL")
def replay_null_assignment(spark, sf_dir):
    return final_orders(spark, sf_dir).where("status is null").select("id", "priority")


@query(f"SELECT id, status, priority FROM state WHERE id > {2 * STEP}")
def replay_pk_move_chain(spark, sf_dir):
    return orders_range(spark, sf_dir, 2 * STEP, 3 * STEP).select("id", "status", "priority")


@query("SELECT k AS id, status, 'RE' AS priority FROM o WHERE k % 35 = 0")
def replay_delete_reinsert(spark, sf_dir):
    return orders_range(spark, sf_dir, -1, STEP).where("id % 35 = 0").select("id", "status", "priority")


@query(f"SELECT {ROW} FROM state WHERE id > {STEP} AND id < {2 * STEP}")
def replay_moved_into_range(spark, sf_dir):
    return orders_range(spark, sf_dir, STEP, 2 * STEP)


@query(f"SELECT {ROW} FROM state WHERE id > 0 AND id < {BORN}")
def replay_moved_out_of_range(spark, sf_dir):
    return orders_range(spark, sf_dir, 0, BORN)


@query(f"SELECT {ROW} FROM state WHERE id = {STEP + 10}")
def point_lookup(spark, sf_dir):
    return plain(lookup.point_query(order_changes(spark, sf_dir), DB, ORDERS, STEP + 10))


@query(f"SELECT s_suppkey AS ord, {ROW} FROM supplier JOIN state ON id = s_suppkey * 5 + {STEP}")
def key_list_lookup(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") * 5 + STEP).alias("pk"))
    return plain(lookup.key_list_query(order_changes(spark, sf_dir), DB, ORDERS, keys))


@query("SELECT phase, k, op, kind, moved FROM ev WHERE pk = 35 ORDER BY phase DESC")
def pk_history_desc(spark, sf_dir):
    return lookup.history(order_changes(spark, sf_dir), 35).select(*placed(), "op", "kind", "moved")


@query("SELECT pk, phase, k, lag(phase) OVER (PARTITION BY pk ORDER BY phase) AS prev_phase FROM ev")
def pk_prev_pointer(spark, sf_dir):
    return plain(lookup.previous_events(order_changes(spark, sf_dir)).select(*placed("pk"), F.col("prev_seq.file_no").alias("prev_phase")))


@query("SELECT pk, phase, kind, CAST(sum(CASE WHEN kind = 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY pk ORDER BY phase) AS BIGINT) AS inc FROM ev")
def incarnation_numbers(spark, sf_dir):
    return plain(incarnations(key_events(order_changes(spark, sf_dir)).drop("cols")).select("pk", F.col("seq.file_no").alias("phase"), "kind", "inc"))


#: The row's values after each event, in closed form: moves keep what was set before them.
STATES = f"""SELECT ev.pk, ev.phase, ev.k, ev.kind,
  CASE WHEN phase = 7 THEN 'RE' WHEN ev.k % 3 = 0 AND phase >= 2 THEN 'P' || (ev.k % 10) ELSE priority END AS priority,
  CASE WHEN phase = 7 THEN status WHEN pk >= {2 * STEP} THEN 'M' WHEN ev.k % 11 = 0 AND phase >= 3 THEN NULL ELSE status END AS status
  FROM ev JOIN o ON o.k = ev.k"""


@query(f"SELECT pk, phase, kind, priority, status FROM ({STATES})")
def running_states(spark, sf_dir):
    return plain(running_state(order_changes(spark, sf_dir), ["priority", "status"]).select("pk", F.col("seq.file_no").alias("phase"), "kind", "priority", "status"))


@query("SELECT k AS id, CASE WHEN k % 11 = 0 THEN NULL ELSE status END AS status, CASE WHEN k % 3 = 0 THEN 'P' || (k % 10) ELSE priority END AS priority, cust, cents FROM o")
def as_of_state(spark, sf_dir):
    changes = lookup.as_of(order_changes(spark, sf_dir), seq(3, F.lit(STEP)))
    return plain(replay(changes, DB, ORDERS, ORDER_SCHEMA))


COUNTS = "count(*) FILTER (op = 'I') AS inserts, count(*) FILTER (op = 'U') AS updates, count(*) FILTER (op = 'D') AS deletes, count(*) FILTER (op = 'U' AND old_pk <> new_pk) AS key_moves, count(*) AS total"
ALL = f", a AS (SELECT '{DB}' AS db, '{ORDERS}' AS tbl, CAST(phase AS INTEGER) AS file_no, op, old_pk, new_pk FROM log UNION ALL SELECT '{DB}', '{USERS}', 1, op, user_id, user_id FROM el)"


@query(f"{ALL} SELECT db, tbl, {COUNTS} FROM a GROUP BY GROUPING SETS ((db, tbl), ())")
def op_counts_by_table(spark, sf_dir):
    return stats.counts_by_table(both_changes(spark, sf_dir))


@query(f"{ALL} SELECT file_no, {COUNTS} FROM a GROUP BY file_no")
def op_counts_by_file(spark, sf_dir):
    return stats.counts_by_file(both_changes(spark, sf_dir))


@query(f"{ALL} SELECT file_no, db, tbl, op, count(*) AS n FROM a GROUP BY GROUPING SETS ((file_no, db, tbl), (file_no, op), (file_no))")
def lines_by_file(spark, sf_dir):
    return stats.lines_by_table_and_file(both_changes(spark, sf_dir))


@query("SELECT count(*) AS key_moves FROM log WHERE op = 'U' AND old_pk <> new_pk")
def pk_update_count(spark, sf_dir):
    return stats.counts_by_table(order_changes(spark, sf_dir)).where("tbl is null").select("key_moves")


@query("SELECT CAST(max(strlen(line)) AS INTEGER) AS max_line, CAST(max(greatest(length(CAST(user_id AS VARCHAR)), length(event_type), length(CAST(cents AS VARCHAR)))) AS INTEGER) AS max_value FROM el")
def max_lengths(spark, sf_dir):
    return stats.longest(event_lines(spark, sf_dir), event_changes(spark, sf_dir))


@query("SELECT pk FROM ev GROUP BY pk HAVING arg_max(kind, phase) = 'END'")
def tombstones(spark, sf_dir):
    return plain(lookup.tombstones(order_changes(spark, sf_dir)).select("pk"))


@query("SELECT pk, max(phase) AS phase, arg_max(kind, phase) AS kind, arg_max(op, phase) AS op FROM ev GROUP BY pk")
def last_event_by_key(spark, sf_dir):
    return plain(lookup.last_events(order_changes(spark, sf_dir)).select("pk", F.col("seq.file_no").alias("phase"), "kind", "op"))


@query("SELECT moved, count(*) AS n FROM ev WHERE kind = 'END' GROUP BY moved")
def ended_by_cause(spark, sf_dir):
    return stats.ended(order_changes(spark, sf_dir)).select("moved", "n")


@query("SELECT pk, phase, k, 'orphan' AS problem FROM ev WHERE k % 13 = 0 AND pk = k AND phase BETWEEN 2 AND 6 AND kind <> 'START' UNION ALL SELECT k, 8, k, 'occupied' FROM o WHERE k % 17 = 0 AND k % 13 <> 0 AND ((k % 5 <> 0 AND k % 7 <> 0) OR k % 35 = 0)")
def orphan_report(spark, sf_dir):
    """A log that lost every 13th key's first insert, and has every 17th key's insert twice."""
    changes, phase, k = order_changes(spark, sf_dir), F.col("seq.file_no"), F.col("seq.rid")
    again = changes.where((phase == 1) & (k % 17 == 0) & (k % 13 != 0)).withColumn("seq", seq(8, k))
    broken = changes.where((phase != 1) | (k % 13 != 0)).unionByName(again)
    return plain(stats.quality_report(broken, ORDER_SCHEMA).where("problem <> 'incomplete'").select(*placed("pk"), "problem"))


@query("SELECT pk, phase, k, kind, moved FROM ev")
def expand_moves(spark, sf_dir):
    return plain(key_events(order_changes(spark, sf_dir)).select(*placed("pk"), "kind", "moved"))


@query("SELECT CAST(phase AS INTEGER) AS phase, k, op, CASE WHEN phase IN (1, 6, 7) THEN 'status,priority,cust,cents' WHEN phase = 2 THEN 'priority' WHEN phase = 4 THEN '' ELSE 'status' END AS names FROM log")
def changed_columns(spark, sf_dir):
    return lookup.changed_columns(order_changes(spark, sf_dir)).select(*placed(), "op", F.array_join("names", ",").alias("names"))


@query(f"SELECT * FROM (VALUES ('{ORDERS}', 0, 'id', 1, true), ('{ORDERS}', 1, 'status', 2, false), ('{ORDERS}', 2, 'priority', 2, false), ('{ORDERS}', 3, 'cust', 1, false), ('{ORDERS}', 4, 'cents', 1, false), ('{USERS}', 0, 'user', 1, true), ('{USERS}', 1, 'kind', 2, false), ('{USERS}', 2, 'cents', 1, false)) t(tbl, place, name, type, is_pk)")
def schema_inferred(spark, sf_dir):
    return schemas(both_changes(spark, sf_dir)).select("tbl", F.posexplode("cols").alias("place", "c")).select("tbl", "place", "c.name", "c.type", "c.is_pk")


@query('SELECT event_id, event_id AS ts_ms, op, CASE WHEN op = \'U\' THEN user_id END AS old_pk, user_id AS new_pk, event_type AS kind, CAST(cents AS VARCHAR) AS cents FROM el')
def parse_roundtrip(spark, sf_dir):
    named = lambda n: F.get(F.filter("cols", lambda c: c["name"] == n), 0)["new"]
    return plain(event_changes(spark, sf_dir).select(F.col("seq.rid").alias("event_id"), "ts_ms", "op", "old_pk", "new_pk", named("kind").alias("kind"), named("cents").alias("cents")))


@query("SELECT event_id, line FROM el")
def encode_lines(spark, sf_dir):
    return event_lines(spark, sf_dir).select(F.col("seq.rid").alias("event_id"), F.col("value").alias("line"))


TSV = "concat_ws(chr(9), CAST(id AS VARCHAR), coalesce(status, 'NULL'), coalesce(priority, 'NULL'), CAST(cust AS VARCHAR), CAST(cents AS VARCHAR))"


@query(f"SELECT id, {TSV} AS line FROM state")
def tsv_lines(spark, sf_dir):
    rows = final_orders(spark, sf_dir)
    return rows.select("id", L.tsv_text(*[F.col(c) for c in rows.columns]).alias("line"))


@query(f"SELECT count(*) AS n_rows, CAST(sum(strlen({TSV}) + 1) AS BIGINT) AS n_bytes FROM state")
def output_size(spark, sf_dir):
    return stats.output_size(final_orders(spark, sf_dir))


@query(f"SELECT id, md5({TSV}) AS md5 FROM state")
def row_digests(spark, sf_dir):
    rows = final_orders(spark, sf_dir)
    return stats.digest(rows, *rows.columns).select("id", "md5")


@query(f"SELECT {ROW} FROM state")
def multi_table_filter(spark, sf_dir):
    return plain(replay(both_changes(spark, sf_dir), DB, ORDERS, ORDER_SCHEMA))


@query(f"SELECT id, CAST(id % {SHARDS} AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY id % {SHARDS} ORDER BY id) AS INTEGER) AS place FROM state")
def shard_assignment(spark, sf_dir):
    rows = lookup.shards(final_orders(spark, sf_dir).select("id"), "id", SHARDS)
    return lookup.numbered_by_key(rows, "id", "shard").withColumn("place", F.col("place").cast("int"))


@query(f"SELECT {ROW} FROM state ORDER BY id LIMIT 3")
def result_preview(spark, sf_dir):
    return lookup.preview(final_orders(spark, sf_dir), "id")


@query(f"SELECT DISTINCT pk FROM ev WHERE pk > {2 * STEP} UNION SELECT DISTINCT pk - {STEP} FROM ev WHERE pk > {2 * STEP} UNION SELECT DISTINCT pk - {2 * STEP} FROM ev WHERE pk > {2 * STEP}")
def wanted_pks_backward(spark, sf_dir):
    return plain(lookup.origins(order_changes(spark, sf_dir), 2 * STEP, 3 * STEP).select("pk"))


@query("SELECT pk, string_agg(phase || op, ',' ORDER BY phase DESC) AS ops FROM ev GROUP BY pk")
def key_event_lists(spark, sf_dir):
    lists = lookup.event_lists(order_changes(spark, sf_dir))
    return plain(lists.select("pk", F.array_join(F.transform("events", lambda e: F.concat(e["seq"]["file_no"].cast("string"), e["op"])), ",").alias("ops")))


@query("SELECT pk, CAST((n - 1) // 2 AS BIGINT) AS block, string_agg(phase || op, ',' ORDER BY phase) AS ops FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY phase) AS n FROM ev) GROUP BY pk, block")
def key_event_blocks(spark, sf_dir):
    """Each key's log in blocks of two events."""
    lists = lookup.event_lists(order_changes(spark, sf_dir), newest_first=False, block=2)
    return plain(lists.select("pk", "block", F.array_join(F.transform("events", lambda e: F.concat(e["seq"]["file_no"].cast("string"), e["op"])), ",").alias("ops")))


@query(f"SELECT pk, phase, k, kind, moved FROM ev WHERE pk > 100 AND pk < {BORN}")
def stored_events(spark, sf_dir):
    """Two appends to a store that is clustered by key, compacted, and a key range's events from it."""
    changes, store = order_changes(spark, sf_dir), EventStore(spark, new_folder(spark))
    for phases in ((1, 3), (4, 7)):
        store.append(changes.where(F.col("seq.file_no").between(*phases)))
    store.compact()
    return plain(store.events(DB, ORDERS, 101, BORN - 1).select(*placed("pk"), "kind", "moved"))


@query(f"SELECT count(*) AS n_rows, CAST(sum(strlen({TSV}) + 1) AS BIGINT) AS n_bytes FROM state")
def written_size(spark, sf_dir):
    """Rows and bytes of the table as a written result, counted while it is written."""
    said = write_result(final_orders(spark, sf_dir), new_folder(spark))
    return spark.createDataFrame([(said["n_rows"], said["n_bytes"])], "n_rows long, n_bytes long")


@query(f"SELECT {ROW} FROM state")
def snapshot_merge(spark, sf_dir):
    """The state after phase 3 as a snapshot, and the rest of the log replayed onto it."""
    changes = order_changes(spark, sf_dir)
    early = replay(lookup.as_of(changes, seq(3, F.lit(STEP))), DB, ORDERS, ORDER_SCHEMA)
    late = of_table(changes, DB, ORDERS).where(F.col("seq.file_no") > 3)
    return plain(replay(as_inserts(early, DB, ORDERS, ORDER_SCHEMA).unionByName(late.drop("parts")), DB, ORDERS, ORDER_SCHEMA))


@query(f"SELECT '{USERS}' AS tbl, 'user' AS key, 3 AS n_columns")
def schema_of_table(spark, sf_dir):
    schema = infer_schema(event_changes(spark, sf_dir), DB, USERS)
    return spark.range(1).select(F.lit(USERS).alias("tbl"), F.lit(schema.key).alias("key"), F.lit(len(schema.columns)).alias("n_columns"))


def new_folder(spark: SparkSession) -> str:
    """A folder of this run's own that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/relog-log-{uuid.uuid4()}"


#: Files of a log that a query writes.
FILES = 12


def written_log(spark: SparkSession, log: DataFrame) -> str:
    """A folder with the log as 1.txt, ..., 12.txt."""
    path = new_folder(spark)
    write_log(log, path, FILES)
    return path


@query(f"SELECT {ROW} FROM state")
def replay_from_files(spark, sf_dir):
    """The log of two tables written as text files 1.txt, ..., 12.txt and read back in splits of a third of a file:
    the state is right only if files, splits and lines keep their order."""
    path = written_log(spark, order_lines(spark, sf_dir).unionByName(event_lines(spark, sf_dir)))
    size = max(Folder(spark, path).sizes().values())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(size // 3 + 1), "0"), strict=True):
        spark.conf.set(n, v)
    try:
        return plain(replay(read_changelog(spark, path, complete=True), DB, ORDERS, ORDER_SCHEMA))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


@query(f"SELECT {ROW} FROM state")
def streaming_merge(spark, sf_dir):
    """A stream follows 12 log files that come in another order than their numbers'; the first to come wait for those
    before them, and batches of at most 5 are merged into the table's state."""
    path = written_log(spark, order_lines(spark, sf_dir))
    logs, state = Folder(spark, f"{path}-came"), State(spark, DB, ORDERS, f"{path}-state", ORDER_SCHEMA)
    files = list(log_files(spark, path))
    for some in (files[3:7], files[:3] + files[9:], files[7:9]):
        for n in some:
            logs.take(f"{path}/{n}.txt")
        follow(logs.path, state, f"{path}-marks", files_per_batch=5).awaitTermination()
    return plain(state.rows())


@query(f"SELECT {ROW} FROM state")
def bucketed_state(spark, sf_dir):
    """The log's phases merged one after the other into a state by key buckets."""
    changes = order_changes(spark, sf_dir)
    state = State(spark, DB, ORDERS, new_folder(spark), ORDER_SCHEMA, buckets=32)
    for phases in ((1, 2), (3, 4), (5, 5), (6, 7)):
        state.merge(changes.where(F.col("seq.file_no").between(*phases)), phases[1])
    return plain(state.rows())


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS row, {TSV} AS line FROM state WHERE id > 100 AND id < {BORN}")
def published_result(spark, sf_dir):
    """A key range as a published result of bounded parts, read back in order after a check of its parts."""
    path = new_folder(spark)
    publish_result(orders_range(spark, sf_dir, 100, BORN), path, rows_per_file=1000)
    return read_published(spark, path).select("row", "line")


@query(f"SELECT s_suppkey * 3 + a.i AS ord, {ROW} FROM supplier, (VALUES (0, {STEP}), (1, 0), (2, {2 * STEP})) a(i, away) JOIN state ON id = s_suppkey * 5 + a.away")
def latest_of_keys(spark, sf_dir):
    """Rows of keys before and after one and two moves, from the newest of 12 log files backwards."""
    path = written_log(spark, order_lines(spark, sf_dir))
    away = F.expr(f"explode(array(struct(0 AS i, {STEP} AS away), struct(1 AS i, 0 AS away), struct(2 AS i, {2 * STEP} AS away)))")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", away.alias("a"))
    rows, _ = latest_rows(spark, path, DB, ORDERS, keys.select((F.col("s_suppkey") * 3 + F.col("a.i")).alias("ord"), (F.col("s_suppkey") * 5 + F.col("a.away")).alias("pk")), ORDER_SCHEMA)
    return plain(rows)


@query("SELECT event_id, line FROM el")
def filtered_lines(spark, sf_dir):
    """The lines of one table, written as a log of 12 files and read back."""
    tbl = F.get(L.fields(F.col("value")), F.lit(3))
    path = written_log(spark, order_lines(spark, sf_dir).unionByName(event_lines(spark, sf_dir)).where(tbl == USERS))
    return lines(spark, path).select(F.get(L.fields(F.col("value")), F.lit(1)).cast("long").alias("event_id"), F.col("value").alias("line"))


def broken_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of orders with an unknown operation in every 13th key's update of phase 2, inserts cut off for
    every 17th key, and a key that is no number in deletes of every 19th."""
    phase, k, value = F.col("seq.file_no"), F.col("seq.rid"), F.col("value")
    value = F.when((phase == 2) & (k % 13 == 0), F.replace(value, F.lit("|U|"), F.lit("|Q|"))).when((phase == 1) & (k % 17 == 0), F.regexp_replace(value, r"\|[^|]*\|$", "|")).when((phase == 6) & (k % 19 == 0), F.regexp_replace(value, r"id:1:1\|[0-9]+", "id:1:1|none")).otherwise(value)
    return order_lines(spark, sf_dir).select(value.alias("value"), "seq")


@query("SELECT CAST(phase AS INTEGER) AS phase, k, CASE phase WHEN 1 THEN 'fields' WHEN 2 THEN 'op' ELSE 'key' END AS problem FROM log WHERE (phase = 2 AND k % 13 = 0) OR (phase = 1 AND k % 17 = 0) OR (phase = 6 AND k % 19 = 0)")
def broken_lines(spark, sf_dir):
    return stats.broken_lines(parse(broken_log(spark, sf_dir))).select(*placed(), "problem")


@query("SELECT k AS pk, CAST(phase AS INTEGER) AS phase, 'incomplete' AS problem FROM log WHERE op = 'I' AND k % 19 = 0")
def incomplete_rows(spark, sf_dir):
    """Inserts of every 19th key lack their last column."""
    k = F.col("seq.rid")
    value = F.when((k % 19 == 0) & F.col("seq.file_no").isin(1, 7), F.regexp_replace("value", r"cents:1:0\|[^|]*\|[^|]*\|$", "")).otherwise(F.col("value"))
    changes = parse(order_lines(spark, sf_dir).select(value.alias("value"), "seq"))
    return plain(stats.incomplete_rows(changes, ORDER_SCHEMA).select("pk", F.col("seq.file_no").alias("phase"), "problem"))


@query(f"""SELECT asked.pk, asked.before, arg_max(s.kind, s.phase) AS kind, arg_max(s.priority, s.phase) AS priority, arg_max(struct_pack(v := s.status), s.phase).v AS status
  FROM (SELECT k + step * {STEP} AS pk, CAST(before AS INTEGER) AS before FROM o, range(0, 3) t(step), range(4, 9) b(before) WHERE k % 10 = 0 UNION ALL SELECT -max(k) - 1, 4 FROM o) asked
  LEFT JOIN ({STATES}) s ON s.pk = asked.pk AND s.phase < asked.before GROUP BY asked.pk, asked.before""")
def as_of_join(spark, sf_dir):
    """The state of every tenth key, and of the keys that moves take its row to, before each of the phases 4 to 8:
    before, between and after both moves, and after the delete; and of a key that never was."""
    states = running_state(order_changes(spark, sf_dir), ["priority", "status"]).select("db", "tbl", "pk", "seq", "kind", "priority", "status")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tenth = o.where("o_orderkey % 10 = 0").select(F.explode(F.expr(f"transform(sequence(0, 14), i -> struct(o_orderkey + (i div 5) * {STEP} AS pk, CAST(4 + i % 5 AS INT) AS before))")).alias("a")).select("a.*")
    never = o.select((-F.max("o_orderkey") - 1).alias("pk"), F.lit(4).alias("before"))
    asked = tenth.unionByName(never).select(F.lit(DB).alias("db"), F.lit(ORDERS).alias("tbl"), F.col("pk").cast(L.KEY_TYPE).alias("pk"), seq(F.col("before"), F.lit(-1)).alias("seq"))
    return plain(lookup.as_of_join(states, asked).select("pk", F.col("seq.file_no").alias("before"), "state.kind", "state.priority", "state.status"))
