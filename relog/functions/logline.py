"""Column expressions between text and changes: parse a log line, encode one, and print a row as text.

A line is `binlog id|milliseconds|schema|table|op|` and then three fields for each column,
`name:type:is_key|old|new|`, with or without a leading bar. Nothing in it is escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log format: type codes, operations, spellings of NULL, number of leading fields.
NUMBER, STRING = 1, 2
INSERT, UPDATE, DELETE = "I", "U", "D"
NULL_WORDS = ("NULL", "<NULL>")
HEADER = 5

KEY_TYPE = "decimal(20,0)"
COL_TYPE = "struct<name:string,type:int,is_pk:boolean,old:string,new:string>"


def fields(line: Column) -> Column:
    """The fields of a line, empty ones kept, without those that a leading and a closing bar make."""
    inner = F.when(line.startswith("|"), F.substr(line, F.lit(2))).otherwise(line)
    inner = F.when(inner.endswith("|"), F.left(inner, F.length(inner) - 1)).otherwise(inner)
    return F.split(inner, r"\|", -1)


def n_columns(parts: Column) -> Column:
    """Number of column triples; null if the fields don't come out even."""
    rest = F.size(parts) - HEADER
    return F.when((rest >= 3) & (rest % 3 == 0), (rest / 3).cast("int"))


def decoded(value: Column) -> Column:
    """SQL NULL for the exact words that stand for it; any other text, also the empty one, is itself."""
    return F.when(value.isin(*NULL_WORDS), F.lit(None)).otherwise(value)


def column_changes(parts: Column) -> Column:
    """Array of COL_TYPE, in the line's order; empty where the fields don't come out even."""

    raw = lambda i: F.struct(F.split(F.get(parts, 3 * i + HEADER), ":", -1).alias("about"), F.get(parts, 3 * i + HEADER + 1).alias("old"), F.get(parts, 3 * i + HEADER + 2).alias("new"))

    def triple(x: Column) -> Column:
        about = x["about"]
        return F.struct(F.get(about, 0).alias("name"), F.get(about, 1).try_cast("int").alias("type"), F.coalesce(F.get(about, 2) == "1", F.lit(False)).alias("is_pk"), decoded(x["old"]).alias("old"), decoded(x["new"]).alias("new"))

    n = n_columns(parts)
    return F.when(n.isNotNull(), F.transform(F.transform(F.sequence(F.lit(0), n - 1), raw), triple)).otherwise(F.array().cast(f"array<{COL_TYPE}>"))


def key_of(parts: Column, side: str) -> Column:
    """Old or new value of the key column, as a number up to 2^64-1. The key mostly is the first column, so
    it is read from the fields; all columns are only built for lines where it is another one."""
    first = (F.split_part(F.get(parts, F.lit(HEADER)), F.lit(":"), F.lit(3)) == "1") & n_columns(parts).isNotNull()
    own = decoded(F.get(parts, F.lit(HEADER + (1 if side == "old" else 2))))
    return F.when(first, own).otherwise(F.get(F.filter(column_changes(parts), lambda c: c["is_pk"]), 0)[side]).try_cast(KEY_TYPE)


def triple_text(name: str, kind: int, is_key: bool, old: Column, new: Column) -> Column:
    """One column's three fields of a line; null prints as NULL."""
    text = lambda v: F.coalesce(v.cast("string"), F.lit(NULL_WORDS[0]))
    return F.concat(F.lit(f"{name}:{kind}:{int(is_key)}|"), text(old), F.lit("|"), text(new), F.lit("|"))


def line_text(binlog: Column, ms: Column, db: str, tbl: str, op: Column, *triples: Column) -> Column:
    """A line from its parts; a triple that is null is left out."""
    head = F.concat(F.lit("|"), binlog.cast("string"), F.lit("|"), ms.cast("string"), F.lit(f"|{db}|{tbl}|"), op, F.lit("|"))
    return F.concat(head, *[F.coalesce(t, F.lit("")) for t in triples])


def tsv_text(*columns: Column, null: str = NULL_WORDS[0]) -> Column:
    """A result row as tab-separated text; null and the empty string stay apart."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(null)) for c in columns])
