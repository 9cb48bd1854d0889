"""A log's key events as Parquet that is clustered by key, so that a key's or a key range's history is a few files."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators.replay import key_events
from relog.sources.files import Folder

#: Bytes below which a file counts as small, and bytes that compaction makes of them. A task sorts the rows of one file, which
#: are several times as large in a shuffle.
SMALL, FULL = 32 << 20, 64 << 20


class EventStore:
    """Key events (db, tbl, pk, seq, op, kind, moved, cols, ts_ms) in files that are sorted by table, key and place.

    Each append is a run of files that cover the keys in ranges without overlap. `versions/<n>.json` lists the files with
    table, smallest and largest key, rows and bytes (one short entry a file; the only thing that the driver reads); it
    appears by one rename, so a failed append or compaction changes nothing. A query takes the files whose keys can match
    from the list, and in them Parquet's row-group statistics prune by the same keys. seq orders the events of all
    runs if it ordered the changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def version(self) -> dict:
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and n[0].isdigit()]
        return json.loads(self.folder.read(f"versions/{max(numbers)}.json")) if numbers else {"version": 0, "files": []}

    def _write(self, events: DataFrame, files: int) -> list[dict]:
        run = f"run-{uuid.uuid4().hex}"
        order = ["db", "tbl", "pk", "seq"]
        events.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(self.folder.at(run))
        sizes = self.folder.sizes(run)
        name = F.element_at(F.split("_metadata.file_path", "/"), -1)
        found = self.spark.read.parquet(self.folder.at(run)).groupBy(name.alias("file"), "db", "tbl").agg(F.min("pk").cast("string"), F.max("pk").cast("string"), F.count("*"))
        return [{"file": f"{run}/{f}", "db": d, "tbl": t, "low": low, "high": high, "rows": n, "bytes": sizes[f]} for f, d, t, low, high, n in found.collect()]

    def _publish(self, said: dict, files: list[dict]) -> dict:
        after = {"version": said["version"] + 1, "files": files}
        self.folder.publish(f"versions/{after['version']}.json", json.dumps(after))
        return after

    def append(self, changes: DataFrame, files: int = 0) -> dict:
        """Adds the changes' key events as a run of `files` files (by default the session's number of shuffle partitions)."""
        said = self.version()
        made = self._write(key_events(changes), files or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self._publish(said, said["files"] + made)

    def compact(self, small: int = SMALL, full: int = FULL) -> dict:
        """Puts all files under `small` bytes together into files of about `full`; the list then names those, and the old
        files and lists are removed."""
        said = self.version()
        paths = sorted({f["file"] for f in said["files"] if f["bytes"] < small})
        if len(paths) < 2:
            return said
        size = sum({f["file"]: f["bytes"] for f in said["files"] if f["file"] in set(paths)}.values())
        made = self._write(self.spark.read.parquet(*map(self.folder.at, paths)), max(1, math.ceil(size / full)))
        after = self._publish(said, [f for f in said["files"] if f["bytes"] >= small] + made)
        for n in range(1, after["version"]):
            self.folder.remove(f"versions/{n}.json")
        for path in paths:
            self.folder.remove(path)
        return after

    def events(self, db: str, tbl: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """The events of a table's keys between start and end, both included; None leaves a side open."""
        inside = lambda f: (start is None or int(f["high"]) >= start) and (end is None or int(f["low"]) <= end)
        paths = sorted({self.folder.at(f["file"]) for f in self.version()["files"] if (f["db"], f["tbl"]) == (db, tbl) and inside(f)})
        if not paths:
            raise FileNotFoundError(f"no events of such keys of {db}.{tbl}")
        found = self.spark.read.parquet(*paths).where((F.col("db") == db) & (F.col("tbl") == tbl))
        bound = lambda v: F.lit(str(v)).cast(L.KEY_TYPE)
        if start is not None:
            found = found.where(F.col("pk") >= bound(start))
        return found if end is None else found.where(F.col("pk") <= bound(end))
