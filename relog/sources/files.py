"""Folders in any store that Spark reads: listing, small texts that appear in one step, and log files by number."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Fixed value of the log format: names of its files.
LOG_NAME = re.compile(r"^([0-9]+)\.txt$")
GAPS = ("wait", "fail", "skip")


class Folder:
    """A folder by its Hadoop path; only names and small texts pass the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, below: str = "") -> list[str]:
        where = self._path(self.at(below) if below else self.path)
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []

    def sizes(self, below: str = "") -> dict[str, int]:
        where = self._path(self.at(below) if below else self.path)
        return {f.getPath().getName(): f.getLen() for f in self._files.listStatus(where)} if self._files.exists(where) else {}

    def move(self, name: str, to: str) -> None:
        """One rename; an existing target or a refusing store is an error."""
        if self._files.exists(self._path(self.at(to))) or not self._files.rename(self._path(self.at(name)), self._path(self.at(to))):
            raise FileExistsError(f"could not move {self.at(name)} to {self.at(to)}")

    def take(self, path: str) -> None:
        """Moves a file of the same store into the folder, which is made if there is none."""
        self._files.mkdirs(self._path(self.path))
        if not self._files.rename(self._path(path), self._path(self.at(path.rpartition("/")[2]))):
            raise FileExistsError(f"could not move {path} to {self.path}")

    def remove(self, name: str) -> None:
        self._files.delete(self._path(self.at(name)), True)

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A small text under a new name, seen whole or not at all."""
        folder, _, last = name.rpartition("/")
        part = f"{folder + '/' if folder else ''}.{last}.{uuid.uuid4().hex}"
        out = self._files.create(self._path(self.at(part)), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self.move(part, name)
        except FileExistsError:
            self.remove(part)
            raise


def log_files(spark: SparkSession, path: str) -> dict[int, str]:
    """Paths of the folder's log files by number."""
    found = {int(m[1]): f"{path.rstrip('/')}/{name}" for name in Folder(spark, path).names() if (m := LOG_NAME.match(name))}
    return dict(sorted(found.items()))


def next_files(present: list[int], last: int, limit: int | None = None, gaps: str = "wait") -> list[int]:
    """The numbers to read after file `last` (0: none was read yet), at most limit, in order.

    gaps: "wait" stops before the first missing number; "fail" raises where a later file is there without it; "skip" takes
    whatever numbers there are."""
    if gaps not in GAPS:
        raise ValueError(f"gaps is one of {GAPS}")
    later = sorted(n for n in present if n > last)
    if gaps != "skip":
        run = [n for i, n in enumerate(later) if n == last + 1 + i]
        if gaps == "fail" and len(run) < len(later):
            raise FileNotFoundError(f"log file {last + len(run) + 1} is missing, {later[len(run)]} is there")
        later = run
    return later[:limit]


def complete_log(spark: SparkSession, path: str) -> list[str]:
    """Paths of a log's files from 1.txt on, in order; a missing number is an error."""
    files = log_files(spark, path)
    return [files[n] for n in next_files(list(files), 0, gaps="fail")]
