"""Counts over a log, and a report of what does not follow the format's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators.replay import END, MOD, START, key_events, segments
from relog.operators.running import reliable, running
from relog.sources.changelog import TableSchema


def op_counts(changes: DataFrame) -> list[Column]:
    op = F.col("op")
    return [
        F.count_if(op == L.INSERT).alias("inserts"),
        F.count_if(op == L.UPDATE).alias("updates"),
        F.count_if(op == L.DELETE).alias("deletes"),
        F.count_if((op == L.UPDATE) & (F.col("old_pk") != F.col("new_pk"))).alias("key_moves"),
        F.count("*").alias("total"),
    ]


def counts_by_table(changes: DataFrame) -> DataFrame:
    """Operations by schema and table, and a last line of all (null names)."""
    return changes.groupingSets([["db", "tbl"], []], "db", "tbl").agg(*op_counts(changes))


def counts_by_file(changes: DataFrame) -> DataFrame:
    """Operations by file number."""
    return changes.groupBy(F.col("seq.file_no").alias("file_no")).agg(*op_counts(changes))


def lines_by_table_and_file(changes: DataFrame) -> DataFrame:
    """Lines by file and table, by file and operation, and by file, in one pass."""
    file = F.col("seq.file_no").alias("file_no")
    return changes.select(file, "db", "tbl", "op").groupingSets([["file_no", "db", "tbl"], ["file_no", "op"], ["file_no"]], "file_no", "db", "tbl", "op").agg(F.count("*").alias("n"))


def longest(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """max_line (bytes of a line) and max_value (characters of a new value)."""
    values = changes.select(F.array_max(F.transform("cols", lambda c: F.length(c["new"]))).alias("n")).agg(F.max("n").alias("max_value"))
    return lines.agg(F.max(F.octet_length("value")).alias("max_line")).join(values)  # one row each


def output_size(rows: DataFrame) -> DataFrame:
    """n_rows and n_bytes of the result as text, each line with its newline."""
    line = L.tsv_text(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(line.alias("line")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("n_bytes"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with the MD5 of their text."""
    return rows.withColumn("md5", F.md5(L.tsv_text(*[F.col(f"`{c}`") for c in columns])))


def broken_lines(changes: DataFrame) -> DataFrame:
    """seq and kind of lines that replay passes over: 'fields', 'op' or 'key'."""
    op, old, new = F.col("op"), F.col("old_pk"), F.col("new_pk")
    lost = ((op == L.INSERT) & new.isNull()) | ((op == L.DELETE) & old.isNull()) | ((op == L.UPDATE) & (old.isNull() | new.isNull()))
    kind = F.when(F.size("cols") == 0, "fields").when(~op.isin(L.INSERT, L.UPDATE, L.DELETE) | op.isNull(), "op").when(lost, "key")
    return changes.select("db", "tbl", "seq", F.coalesce(new, old).alias("pk"), kind.alias("problem")).where(F.col("problem").isNotNull())


def misplaced_events(changes: DataFrame) -> DataFrame:
    """seq, pk and problem of events that the state before does not allow: 'orphan' (update, delete or
    move of no row) and 'occupied' (insert or move onto a living row)."""
    events = key_events(changes).drop("cols")
    edge = F.when(F.col("kind") != MOD, F.col("kind"))
    events = running(events, lasts={"last_edge": edge})
    alive = F.coalesce(F.col("last_edge") == START, F.lit(False))
    problem = F.when((F.col("kind") == START) & alive, "occupied").when((F.col("kind") != START) & ~alive, "orphan")
    return events.select("db", "tbl", "seq", "pk", problem.alias("problem")).where(F.col("problem").isNotNull())


def incomplete_rows(changes: DataFrame, schema: TableSchema) -> DataFrame:
    """db, tbl, seq, pk of inserts that leave columns of the table unset."""
    found = segments(changes, schema).where(~F.col("from_move"))
    missing = [F.col(f"v{i}").isNull() for i in range(len(schema.values))]
    any_missing = F.lit(False)
    for m in missing:
        any_missing = any_missing | m
    return found.where(any_missing).select("db", "tbl", F.col("start_seq").alias("seq"), "pk", F.lit("incomplete").alias("problem"))


def quality_report(changes: DataFrame, schema: TableSchema) -> DataFrame:
    """All problems of a table's log: db, tbl, seq, pk, problem. Lines are parsed once, into a checkpoint."""
    changes = reliable(changes.drop("parts"))
    return broken_lines(changes).unionByName(misplaced_events(changes)).unionByName(incomplete_rows(changes, schema))


def ended(changes: DataFrame) -> DataFrame:
    """Number of ends by table and cause, deleted or moved."""
    return key_events(changes).where(F.col("kind") == END).groupBy("db", "tbl", "moved").agg(F.count("*").alias("n"))
