"""Reading change logs (text or Parquet), and writing changes and results."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relog.functions import logline as L
from relog.sources.files import LOG_NAME, Folder, complete_log

#: Names of the files that Spark's tasks write.
PART_NAME = re.compile(r"^part-([0-9]+)")
#: Tables whose first inserts are looked for by a filter that lists their places.
LISTED_TABLES = 50


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, seq, file_name of all lines of the files `<number>.txt` under path, split as Spark likes.

    seq orders the lines: file number, start of the split in the file, then the rising id that rows of a
    split get as they are read. The id alone would not do, as splits are packed by size."""
    return numbered(spark.read.text(path))


def numbered(raw: DataFrame) -> DataFrame:
    """Adds seq and file_name to raw text lines of files."""
    name = F.col("_metadata.file_name")
    seq = F.struct(
        F.regexp_extract(name, LOG_NAME.pattern, 1).try_cast("int").alias("file_no"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("rid"),
    )
    return raw.select("value", seq.alias("seq"), name.alias("file_name")).where(F.col("seq.file_no").isNotNull() & (F.col("value") != ""))


def parse(lines_: DataFrame) -> DataFrame:
    """Changes of lines (value, seq): seq, binlog_id, ts_ms, db, tbl, op, old_pk, new_pk, cols, n_fields, and the fields
    themselves (parts), from which replay takes what it needs without cols.

    Broken lines are kept, with null where nothing could be read, for the quality report; replay passes
    over them. A line is split by a generator of one row: filters on changes stay above that, while below a plain
    projection each of their terms would make and split the line anew."""
    parts = lines_.select("seq", F.explode(F.array(L.fields(F.col("value")))).alias("parts"))
    part = lambda i: F.get("parts", F.lit(i))
    return parts.select("seq", part(0).alias("binlog_id"), part(1).try_cast("long").alias("ts_ms"), part(2).alias("db"), part(3).alias("tbl"), part(4).alias("op"), L.column_changes(F.col("parts")).alias("cols"), F.size("parts").alias("n_fields"), L.key_of(F.col("parts"), "old").alias("old_pk"), L.key_of(F.col("parts"), "new").alias("new_pk"), "parts")


def read_changelog(spark: SparkSession, path: str | list[str], complete: bool = False) -> DataFrame:
    """Changes of the log files under path; complete: of 1.txt, 2.txt, ..., where a missing number is an error."""
    return parse(lines(spark, complete_log(spark, path) if complete else path))


def of_table(changes: DataFrame, db: str, tbl: str) -> DataFrame:
    """Changes of one table, by exact schema and table name."""
    return changes.where((F.col("db") == db) & (F.col("tbl") == tbl))


def write_changes(changes: DataFrame, path: str) -> None:
    """Changes as Parquet by schema and table, so that a query reads only its table's files."""
    changes.drop("parts").write.mode("overwrite").partitionBy("db", "tbl").parquet(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(rows: DataFrame, path: str, null: str = L.NULL_WORDS[0], rows_per_file: int = 0) -> dict:
    """Rows as tab-separated lines, each closed by a newline. Part files keep the rows' order: those of
    a sorted DataFrame, put together by name, are the whole result. No task holds more than its part, and
    with rows_per_file no file has more rows than that. Returns the rows and bytes written, counted as they are written."""
    lines_ = rows.select(L.tsv_text(*[F.col(f"`{c}`") for c in rows.columns], null=null).alias("value"))
    seen = Observation()
    counted = lines_.observe(seen, F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("n_bytes"))
    counted.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)
    return dict(seen.get)


def write_log(lines_: DataFrame, path: str, files: int = 0) -> None:
    """Log lines (value, seq) as a log again: files 1.txt, 2.txt, ... under path, in the order of seq. Spark
    sorts by ranges, `files` of them (by default the session's number of shuffle partitions), and each task writes
    its own file; the driver only renames them. Ranges come from a sample, so a few may be empty and have no file."""
    spark = lines_.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines_.repartitionByRange(n, "seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)
    folder = Folder(spark, path)
    parts = {int(m[1]): (name, size) for name, size in folder.sizes().items() if (m := PART_NAME.match(name))}
    filled = [parts[i][0] for i in sorted(parts) if parts[i][1] or len(parts) == 1]
    for name, _ in parts.values():
        if name not in filled:
            folder.remove(name)
    for i, name in enumerate(filled):
        folder.move(name, f"{i + 1}.txt")


def publish_result(rows: DataFrame, path: str, name: str = "result", null: str = L.NULL_WORDS[0], rows_per_file: int = 0) -> dict:
    """The result as write_result makes it, as one published thing: `<path>/<name>.json` lists its parts in order, with
    each one's rows, bytes, MD5, and first row and byte in the whole. The rows lie in a folder of their own, and the list
    replaces the one before by a rename, so a rewrite that fails leaves the old result. Returns the list."""
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    data = f"{name}-{uuid.uuid4().hex}"
    write_result(rows, folder.at(data), null, rows_per_file)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder.at(data))
    part = F.element_at(F.split("path", "/"), -1)
    lines_in = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    about = files.select(part.alias("part"), F.col("length").alias("bytes"), lines_in.cast("long").alias("rows"), F.md5("content").alias("md5"))
    parts, row, byte = [], 0, 0
    for r in sorted(about.collect(), key=lambda r: (int(PART_NAME.match(r["part"])[1]), r["part"])):  # one row a file
        if r["bytes"]:
            parts.append({"part": r["part"], "first_row": row, "first_byte": byte, "rows": r["rows"], "bytes": r["bytes"], "md5": r["md5"]})
            row, byte = row + r["rows"], byte + r["bytes"]
    before = published(spark, path, name)
    said = {"data": data, "columns": rows.columns, "rows": row, "bytes": byte, "parts": parts, "number": (before or {"number": 0})["number"] + 1}
    folder.publish(f"{name}.{said['number']}.json", json.dumps(said))
    if before:
        folder.remove(f"{name}.{before['number']}.json")
        folder.remove(before["data"])
    return said


def published(spark: SparkSession, path: str, name: str = "result") -> dict | None:
    """The newest list of a published result, or None."""
    folder = Folder(spark, path)
    numbers = [int(m[1]) for f in folder.names() if (m := re.match(rf"^{re.escape(name)}\.([0-9]+)\.json$", f))]
    return json.loads(folder.read(f"{name}.{max(numbers)}.json")) if numbers else None


def read_published(spark: SparkSession, path: str, name: str = "result") -> DataFrame:
    """line, row (its number in the whole, from 0) of a published result. Parts are checked against the list first, in
    tasks; one that is missing or has other bytes is an error."""
    said = published(spark, path, name)
    if said is None:
        raise FileNotFoundError(f"no result {name} in {path}")
    listed = spark.createDataFrame([(p["part"], p["first_row"], p["md5"]) for p in said["parts"]], "part string, first_row long, md5 string")
    if not said["parts"]:
        return listed.select(F.col("part").alias("line"), F.col("first_row").alias("row"))
    folder = Folder(spark, path).at(said["data"])
    found = spark.read.format("binaryFile").load([f"{folder}/{p['part']}" for p in said["parts"]])
    last = F.element_at(F.split("path", "/"), -1)
    wrong = found.select(last.alias("part"), F.md5("content").alias("is")).join(F.broadcast(listed), "part", "right").where(~F.col("is").eqNullSafe(F.col("md5"))).first()
    if wrong:
        raise ValueError(f"part {wrong['part']} of {name} has changed")
    text = spark.read.text([f"{folder}/{p['part']}" for p in said["parts"]], wholetext=True).select("value", F.col("_metadata.file_name").alias("part"))
    split = text.join(F.broadcast(listed), "part").select("first_row", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    return split.select("line", (F.col("first_row") + F.col("at")).alias("row"))


def result_lines(rows: DataFrame, null: str = L.NULL_WORDS[0]) -> Iterator[str]:
    """The result's lines in order, handed on while Spark still makes the next ones; the driver holds two
    partitions at most."""
    text = rows.select(L.tsv_text(*[F.col(f"`{c}`") for c in rows.columns], null=null).alias("value"))
    return (r["value"] for r in text.toLocalIterator(prefetchPartitions=True))


@dataclass(frozen=True)
class TableSchema:
    """A table's columns in the order of its first insert: (name, type code, is key)."""

    columns: tuple[tuple[str, int, bool], ...]

    @property
    def key(self) -> str:
        return next(name for name, _, is_key in self.columns if is_key)

    @property
    def values(self) -> list[str]:
        return [name for name, _, is_key in self.columns if not is_key]

    def spark_type(self, name: str) -> str:
        return L.KEY_TYPE if next(kind for n, kind, _ in self.columns if n == name) == L.NUMBER else "string"

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.DecimalType(20, 0) if k == L.NUMBER else T.StringType(), not is_key) for n, k, is_key in self.columns])

    def of(self, name: str, text: Column) -> Column:
        return text.try_cast(self.spark_type(name))


def schemas(changes: DataFrame) -> DataFrame:
    """db, tbl, cols (name, type, is_pk, in order) of every table, from its first insert.

    The first insert is found by numbers alone, first of each split, then of all. One row a table tells where it is;
    for up to LISTED_TABLES of them that is a filter on the lines' places, below where lines are taken apart, and
    else a semi-join above."""
    about = F.transform("cols", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["is_pk"].alias("is_pk")))
    inserts = changes.where((F.col("op") == L.INSERT) & F.col("new_pk").isNotNull())
    table, file, block, rid = ["db", "tbl"], F.col("seq.file_no").alias("file"), F.col("seq.block_start").alias("block"), F.col("seq.rid")
    of_split = inserts.select(*table, file, block, rid.alias("rid")).groupBy(*table, "file", "block").agg(F.min("rid").alias("rid"))
    first = of_split.groupBy(*table).agg(F.min(F.struct("file", "block", "rid")).alias("at")).select(F.col("db").alias("_db"), F.col("tbl").alias("_tbl"), "at")
    listed = first.limit(LISTED_TABLES + 1).collect()
    if len(listed) <= LISTED_TABLES:
        first = changes.sparkSession.createDataFrame(listed, first.schema)
        places = [F.col("seq.file_no").eqNullSafe(F.lit(r["at"]["file"])) & F.col("seq.block_start").eqNullSafe(F.lit(r["at"]["block"])) & (rid == F.lit(r["at"]["rid"])) for r in listed]
        inserts = inserts.where(reduce(lambda a, b: a | b, places, F.lit(False)))
    at = F.col("at")
    same = (F.col("db") == F.col("_db")) & (F.col("tbl") == F.col("_tbl")) & F.col("seq.file_no").eqNullSafe(at["file"]) & F.col("seq.block_start").eqNullSafe(at["block"]) & (rid == at["rid"])
    return inserts.join(F.broadcast(first), same, "left_semi").select("db", "tbl", about.alias("cols"))


def infer_schema(changes: DataFrame, db: str, tbl: str) -> TableSchema:
    """The schema of one table; one row reaches the driver."""
    row = schemas(of_table(changes, db, tbl)).first()
    if row is None:
        raise ValueError(f"no insert into {db}.{tbl}")
    return TableSchema(tuple((c["name"], c["type"], c["is_pk"]) for c in row["cols"]))
