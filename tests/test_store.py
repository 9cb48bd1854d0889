"""The clustered event store, numbering by ranges, lists in blocks, and counts of what is written."""

import pytest
from pyspark.sql import functions as F
from test_replay import STUDENT, as_tuples, core, line, row, write_logs  # noqa: F401

from relog.operators import lookup
from relog.operators.replay import key_events
from relog.sources import changelog as C
from relog.sources.files import Folder
from relog.sources.store import EventStore

SCHEMA = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))


def test_a_key_range_is_a_few_files(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    first = C.read_changelog(spark, write_logs(tmp_path / "a", [line("I", None, i, new=row("a", "b", "c", i)) for i in range(400)], [1, 2]))
    second = C.read_changelog(spark, write_logs(tmp_path / "b", [line("U", i, i + 1000, {}, {}) for i in range(0, 400, 50)], [3]))
    store = EventStore(spark, str(tmp_path / "store"))
    assert len({f["file"] for f in store.append(first, 8)["files"]}) == 8
    store.append(second, 2)
    rows = lambda df: sorted((int(r["pk"]), r["seq"]["file_no"], r["kind"], r["moved"]) for r in df.collect())
    want = rows(key_events(first.unionByName(second)))
    found = store.events("m", "student", 120, 130)
    assert rows(found) == [r for r in want if 120 <= r[0] <= 130] and len(found.inputFiles()) <= 3
    found.explain("formatted")
    assert "GreaterThanOrEqual(pk,120)" in capsys.readouterr().out
    assert rows(store.events("m", "student")) == want
    before = store.version()
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        store.compact()
    assert store.version() == before and rows(store.events("m", "student")) == want
    after = store.compact(full=20_000)
    assert len({f["file"] for f in after["files"]}) < 10 and rows(store.events("m", "student")) == want
    assert rows(store.events("m", "student", 1000)) == [r for r in want if r[0] >= 1000]
    assert store.compact(small=1) == after
    with pytest.raises(FileNotFoundError):
        store.events("m", "other")


def test_numbers_in_groups(spark):
    rows = spark.createDataFrame([((i * 7919) % 1000, "hot" if i % 3 else None if i % 2 else f"g{i % 4}", "x") for i in range(1000)], "k int, g string, place_ string").repartition(6)
    got = lookup.numbered_by_key(rows, "k", "g")
    assert got.columns == ["k", "g", "place_", "place"]
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["k"], r["place"]))
    assert all(p == i + 1 for v in by.values() for i, (_, p) in enumerate(sorted(v))) and sum(map(len, by.values())) == 1000


def test_a_hot_keys_list_is_many_rows(spark, tmp_path):
    lines = [line("I", None, 1, new=row("a", "b", "c", 0)), *[line("U", 1, 1, {"score": i}, {"score": i + 1}) for i in range(99)], line("I", None, 2, new=row("a", "b", "c", 0))]
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 10]))
    lists = {(int(r["pk"]), r["block"]): [(e["seq"]["file_no"], e["op"]) for e in r["events"]] for r in lookup.event_lists(changes, block=30).collect()}
    assert {k: len(v) for k, v in lists.items()} == {(1, 0): 30, (1, 1): 30, (1, 2): 30, (1, 3): 10, (2, 0): 1}
    assert lists[1, 0][-1] == (1, "I") and [f for f, _ in lists[1, 3]] == [10] * 10


def test_written_rows_are_counted(spark, core, tmp_path):  # noqa: F811
    rows = lookup.range_query(core, lookup.RangeQuery("m", "student", -1, 2**64), SCHEMA)
    said = C.write_result(rows, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert said == {"n_rows": text.count("\n"), "n_bytes": len(text.encode())}
    assert C.write_result(rows.where(F.lit(False)), str(tmp_path / "none")) == {"n_rows": 0, "n_bytes": 0}
