"""Incremental replay: log files that keep coming are merged, in the order of their numbers, into a table's state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relog.functions import logline as L
from relog.operators.lookup import BROADCAST_KEYS
from relog.operators.replay import replay
from relog.operators.running import reliable
from relog.sources.changelog import TableSchema, infer_schema, of_table, read_changelog
from relog.sources.files import Folder, log_files, next_files

#: A snapshot's rows come before all lines: file numbers start at 1.
SNAPSHOT_FILE = 0
#: Blocks that a snapshot's rows are dealt to.
BLOCKS = 1024
#: Buckets of a state, and versions whose rows are kept for readers that are under way.
BUCKETS, VERSIONS = 256, 2


def as_inserts(rows: DataFrame, db: str, tbl: str, schema: TableSchema) -> DataFrame:
    """Rows of a table as inserts that come before every line of the log. Each row's place there is a
    value of its own, made from the key: 128 hash bits and the key's own order stand behind each other."""
    key = F.col(schema.key)
    cols = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), F.lit(is_key).alias("is_pk"), F.lit(None).cast("string").alias("old"), F.col(n).cast("string").alias("new"))
        for n, kind, is_key in schema.columns
    ])
    # a key up to 2^64-1 is cut into its high and low half, which together are unique
    low = F.pmod(key, F.lit(1 << 32).cast(L.KEY_TYPE)).cast("long")
    high = F.floor(key / F.lit(1 << 32).cast(L.KEY_TYPE)).cast("long")
    seq = F.struct(F.lit(SNAPSHOT_FILE).alias("file_no"), (high * BLOCKS + F.pmod(low, F.lit(BLOCKS))).alias("block_start"), low.alias("rid"))
    return rows.select(seq.alias("seq"), F.lit(None).cast("string").alias("binlog_id"), F.lit(None).cast("long").alias("ts_ms"), F.lit(db).alias("db"), F.lit(tbl).alias("tbl"), F.lit(L.INSERT).alias("op"), cols.alias("cols"), F.lit(L.HEADER + 3 * len(schema.columns)).alias("n_fields"), F.lit(None).cast(L.KEY_TYPE).alias("old_pk"), key.cast(L.KEY_TYPE).alias("new_pk"))


class State:
    """A table's rows after the log files read so far, in a folder, as Parquet by key bucket.

    `versions/<n>.json` says, for the n-th merge, which file was read last, the schema, and the merge that last wrote
    each bucket; it appears by one rename, after the rows. A merge reads and writes only the buckets of keys that its
    lines name, which are closed over moves, as a move names both keys. So it costs the batch and its buckets, not the
    table. A merge that failed half-way has no version file; the next one writes over what it left. Rows that no
    version of the last VERSIONS needs are removed."""

    def __init__(self, spark: SparkSession, db: str, tbl: str, path: str, schema: TableSchema | None = None, buckets: int = BUCKETS):
        self.spark, self.db, self.tbl, self.folder = spark, db, tbl, Folder(spark, path)
        self._schema, self._buckets = schema, buckets

    def version(self, number: int | None = None) -> dict:
        """What a version (the newest by default) says; before the first merge, of nothing."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and n[0].isdigit()]
        if not numbers:
            return {"version": 0, "file": 0, "columns": self._schema and list(self._schema.columns), "buckets": self._buckets, "written": {}}
        return json.loads(self.folder.read(f"versions/{max(numbers) if number is None else number}.json"))

    def bucket(self, key: Column, said: dict) -> Column:
        return F.pmod(F.xxhash64(key.cast(L.KEY_TYPE)), F.lit(said["buckets"])).cast("int")

    def paths(self, said: dict, buckets: list[int] | None = None) -> list[str]:
        """Folders of a version's buckets; those given, or all."""
        return [self.folder.at(f"rows/{n}/bucket={b}") for b, n in sorted(said["written"].items()) if buckets is None or int(b) in buckets]

    def rows(self, keys: list[int] | None = None, said: dict | None = None) -> DataFrame:
        """The table; for given keys only their rows, of which only the buckets are read."""
        said = said or self.version()
        schema = schema_of(said)
        if schema is None:
            raise ValueError(f"no insert into {self.db}.{self.tbl} yet")
        if keys is None:
            return self._read(schema, self.paths(said))
        asked = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.col("k").cast(L.KEY_TYPE).alias("k"))
        buckets = [r[0] for r in asked.select(self.bucket(F.col("k"), said)).distinct().collect()]
        return self._read(schema, self.paths(said, buckets)).join(F.broadcast(asked.distinct()), F.col(schema.key) == F.col("k"), "left_semi")

    def _read(self, schema: TableSchema, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema.struct()).parquet(*paths) if paths else self.spark.createDataFrame([], schema.struct())

    def merge(self, changes: DataFrame, file: int) -> dict:
        """Replays changes, of log files after those read so far and up to number `file`, onto the state, and returns the
        new version. Files read before, again, are an error."""
        said = self.version()
        if file <= said["file"]:
            raise ValueError(f"file {file} came after file {said['file']}")
        changes = reliable(of_table(changes, self.db, self.tbl))
        if said["columns"] is None and not changes.where((F.col("op") == L.INSERT) & F.col("new_pk").isNotNull()).isEmpty():
            said["columns"] = [list(c) for c in infer_schema(changes, self.db, self.tbl).columns]
        schema, number = schema_of(said), said["version"] + 1
        written = dict(said["written"])
        self.folder.remove(f"rows/{number}")
        named = reliable(changes.select(F.explode(F.array("old_pk", "new_pk")).alias("pk")).where("pk is not null").distinct())
        touched = [r[0] for r in named.select(self.bucket(F.col("pk"), said)).distinct().collect()]  # at most as many as buckets
        if schema is not None and touched:
            held = self._read(schema, self.paths(said, touched))
            known = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
            same = held[schema.key] == known["pk"]
            replayed = replay(as_inserts(held.join(known, same, "left_semi"), self.db, self.tbl, schema).unionByName(changes.drop("parts")), self.db, self.tbl, schema)
            rows = held.join(known, same, "left_anti").unionByName(replayed).withColumn("bucket", self.bucket(F.col(schema.key), said))
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder.at(f"rows/{number}"))
            now = {n.removeprefix("bucket=") for n in self.folder.names(f"rows/{number}") if n.startswith("bucket=")}
            for b in map(str, touched):  # a bucket that lost all its rows is in no folder
                written.pop(b, None)
                if b in now:
                    written[b] = number
        after = said | {"version": number, "file": file, "written": written, "read": sorted(touched)}
        self.folder.publish(f"versions/{number}.json", json.dumps(after))
        self.clean()
        return after

    def clean(self) -> None:
        """Removes versions before the last VERSIONS, and buckets that none of those has."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and n[0].isdigit())
        old, kept = numbers[:-VERSIONS], numbers[-VERSIONS:]
        needed = {(n, b) for v in kept for b, n in self.version(v)["written"].items()}
        for n in self.folder.names("rows"):
            if int(n) <= (kept[-1] if kept else 0):
                there = [b for b in self.folder.names(f"rows/{n}") if b.startswith("bucket=")]
                useless = [b for b in there if (int(n), b.removeprefix("bucket=")) not in needed]
                if len(useless) == len(there):
                    self.folder.remove(f"rows/{n}")
                else:
                    for b in useless:
                        self.folder.remove(f"rows/{n}/{b}")
        for v in old:
            self.folder.remove(f"versions/{v}.json")

    def catch_up(self, logs: str, files_per_batch: int | None = None, gaps: str = "wait") -> int:
        """Merges the log files that come next by number, at most files_per_batch at a time, until none is left or one is
        missing (see next_files); returns how many merges that took."""
        merges = 0
        while True:
            files, last = log_files(self.spark, logs), self.version()["file"]
            chosen = next_files(list(files), last, files_per_batch, gaps)
            if not chosen:
                return merges
            self.merge(read_changelog(self.spark, [files[n] for n in chosen]), chosen[-1])
            merges += 1


def schema_of(said: dict) -> TableSchema | None:
    return said["columns"] and TableSchema(tuple((n, k, bool(p)) for n, k, p in said["columns"]))


def follow(logs: str, state: State, checkpoint: str, files_per_batch: int | None = None, gaps: str = "wait", **trigger) -> StreamingQuery:
    """Follow a folder of log files. The stream only tells that files have come, in whatever order; which are merged, and
    in what batches, their numbers and the state's last file decide. So files that came too early wait for the missing
    one (gaps="wait"), and a micro-batch that runs again after a failure merges nothing twice. trigger is as of
    writeStream.trigger (availableNow by default)."""
    stream = state.spark.readStream.format("text").load(logs)

    def came(_: DataFrame, __: int) -> None:
        state.catch_up(logs, files_per_batch, gaps)

    return stream.writeStream.foreachBatch(came).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
