"""Log files by number, state by key buckets, and published results."""

import random

import pytest
from pyspark.sql import functions as F
from test_replay import NAMES, STUDENT, as_tuples, core, line, random_log, row, write_logs  # noqa: F401

from relog.operators import lookup
from relog.operators.replay import replay
from relog.sources import changelog as C
from relog.sources.files import Folder, log_files, next_files
from relog.streaming import snapshots
from relog.streaming.snapshots import State, follow

SCHEMA = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))


def by_key(df):
    return sorted(as_tuples(df), key=lambda r: r[0])


def test_files_come_by_number():
    assert next_files([10, 2, 1, 3], 0) == [1, 2, 3]
    assert next_files([10, 2, 1, 3], 0, limit=2) == [1, 2] and next_files([4, 5], 3) == [4, 5]
    assert next_files([2, 3], 0) == [] and next_files([], 0) == [] and next_files([1, 2], 2, gaps="fail") == []
    assert next_files([10, 2, 1, 3], 2, gaps="skip") == [3, 10]
    with pytest.raises(FileNotFoundError, match="log file 4 is missing, 10 is there"):
        next_files([10, 2, 1, 3], 0, gaps="fail")
    with pytest.raises(ValueError, match="gaps"):
        next_files([], 0, gaps="never")


def test_a_log_with_a_gap_is_an_error(spark, tmp_path):
    path = write_logs(tmp_path, [line("I", None, i, new=row("a", "b", "c", i)) for i in range(9)], [1, 2, 4])
    assert list(log_files(spark, path)) == [1, 2, 4]
    with pytest.raises(FileNotFoundError, match="log file 3"):
        C.read_changelog(spark, path, complete=True)
    (tmp_path / "4.txt").rename(tmp_path / "3.txt")
    assert C.read_changelog(spark, path, complete=True).count() == 9


def test_written_logs_have_many_files_in_order(spark, tmp_path):
    lines = spark.range(1000).select(F.concat(F.lit("line "), "id").alias("value"), F.struct(F.lit(1).alias("file_no"), (F.col("id") % 7).alias("block_start"), F.col("id").alias("rid")).alias("seq"))
    C.write_log(lines, str(tmp_path / "log"), files=12)
    names = log_files(spark, str(tmp_path / "log"))
    assert 10 < len(names) <= 12 and list(names) == list(range(1, len(names) + 1))
    texts = [x for p in names.values() for x in open(p, encoding="utf-8").read().splitlines()]
    assert texts == [f"line {i}" for i in sorted(range(1000), key=lambda i: (i % 7, i))]


def test_files_of_a_stream_come_shuffled(spark, tmp_path):
    """Twelve files in any order: none is merged before its turn, none twice; a batch is bounded."""
    lines, want = random_log(7)
    size = -(-len(lines) // 12)
    texts = ["".join(x + "\n" for x in lines[i * size : (i + 1) * size]) for i in range(12)]
    logs, order = tmp_path / "logs", list(range(1, 13))
    logs.mkdir()
    random.Random(5).shuffle(order)
    state, seen = State(spark, "m", "student", str(tmp_path / "state"), buckets=8), []
    for some in (order[:5], order[5:9], order[9:]):
        for n in some:
            (tmp_path / "part").write_text(texts[n - 1], encoding="utf-8")
            (tmp_path / "part").rename(logs / f"{n}.txt")
        follow(str(logs), state, str(tmp_path / "marks"), files_per_batch=6).awaitTermination()
        seen.append(state.version()["file"])
    there = [set(order[:5]), set(order[:9]), set(order)]
    assert seen == [next((n - 1 for n in range(1, 14) if n not in t), 12) for t in there] and seen[-1] == 12
    assert by_key(state.rows()) == want
    assert state.catch_up(str(logs)) == 0
    with pytest.raises(ValueError, match="came after"):
        state.merge(C.read_changelog(spark, str(logs)), 12)


def test_a_merge_reads_and_writes_few_buckets(spark, tmp_path):
    inserts = [line("I", None, i, new=row("a", "b", "c", i)) for i in range(200)]
    state = State(spark, "m", "student", str(tmp_path / "state"), buckets=32)
    first = state.merge(C.read_changelog(spark, write_logs(tmp_path, inserts, [1])), 1)
    assert len(first["written"]) == 32 and first["columns"][0][:2] == ["id", 1]
    few = [line("U", 5, 5, {"score": 5}, {"score": 50}), line("U", 7, 1007, {"sex": "c"}, {"sex": "x"}), line("D", 9, None, old=row("a", "b", "c", 9))]
    (tmp_path / "2").mkdir()
    changes = C.read_changelog(spark, write_logs(tmp_path / "2", few, [2]))
    second = state.merge(changes, 2)
    asked = spark.createDataFrame([(5,), (7,), (1007,), (9,)], "k long").select(state.bucket(F.col("k"), second)).distinct().collect()
    assert set(second["read"]) == {r[0] for r in asked} and len(second["read"]) <= 4
    assert {b for b, n in second["written"].items() if n == 2} <= {str(b) for b in second["read"]}
    want = {i: (i, "a", "b", "c", i) for i in range(200)} | {5: (5, "a", "b", "c", 50), 1007: (1007, "a", "b", "x", 7)}
    assert by_key(state.rows()) == [want[k] for k in sorted(want) if k not in (7, 9)]
    assert by_key(state.rows([5, 7, 1007, 9])) == [want[5], want[1007]]
    assert len(state.rows([5]).inputFiles()) < len(state.rows().inputFiles())


def test_a_failed_merge_is_made_again(spark, tmp_path, monkeypatch):
    state = State(spark, "m", "student", str(tmp_path / "state"), SCHEMA, buckets=4)
    log = lambda n, *lines: (tmp_path / str(n)).mkdir() or C.read_changelog(spark, write_logs(tmp_path / str(n), list(lines), [n]))
    state.merge(log(1, *[line("I", None, i, new=row("a", "b", "c", i)) for i in range(20)]), 1)
    late = log(2, line("D", 3, None, old=row("a", "b", "c", 3)))
    publish = Folder.publish
    monkeypatch.setattr(Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        state.merge(late, 2)
    monkeypatch.setattr(Folder, "publish", publish)
    assert state.version()["file"] == 1 and len(by_key(state.rows())) == 20
    state.merge(late, 2)
    assert [r[0] for r in by_key(state.rows())] == [i for i in range(20) if i != 3]
    for n in (3, 4):
        state.merge(log(n, line("U", 5, 5, {"score": n}, {"score": n + 1})), n)
    folder = Folder(spark, str(tmp_path / "state"))
    assert sorted(n for n in folder.names("versions") if n.endswith(".json")) == ["3.json", "4.json"] and len(by_key(state.rows())) == 19
    kept = {(int(n), b.removeprefix("bucket=")) for n in folder.names("rows") for b in folder.names(f"rows/{n}") if b.startswith("bucket=")}
    assert kept == {(n, b) for v in (3, 4) for b, n in state.version(v)["written"].items()}


def test_a_state_without_the_tables_insert(spark, tmp_path):
    state = State(spark, "m", "student", str(tmp_path / "state"))
    state.merge(C.read_changelog(spark, write_logs(tmp_path, [line("I", None, 1, new=row("a", "b", "c", 1), tbl="other")], [1])), 1)
    assert state.version()["file"] == 1
    with pytest.raises(ValueError, match="no insert"):
        state.rows()


def test_published_results(spark, core, tmp_path, monkeypatch):
    rows = lookup.range_query(core, lookup.RangeQuery("m", "student", -1, 2**64), SCHEMA)
    said = C.publish_result(rows, str(tmp_path), rows_per_file=2)
    read = C.read_published(spark, str(tmp_path)).orderBy("row").collect()
    text = [r["line"] for r in read]
    assert [r["row"] for r in read] == list(range(len(text)))
    assert [x.split("\t")[0] for x in text] == [str(r[0]) for r in as_tuples(rows)] and said["rows"] == len(text)
    assert said["bytes"] == sum(len(x.encode()) + 1 for x in text) and all(p["rows"] <= 2 for p in said["parts"])
    offsets = [(p["first_row"], p["first_byte"]) for p in said["parts"]]
    assert offsets[0] == (0, 0) and offsets == sorted(offsets) and len(offsets) > 1
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        C.publish_result(rows.limit(1), str(tmp_path))
    assert C.published(spark, str(tmp_path)) == said
    again = C.publish_result(rows.limit(1), str(tmp_path))
    assert again["rows"] == 1 and C.read_published(spark, str(tmp_path)).count() == 1
    assert not (tmp_path / said["data"]).exists()
    part = tmp_path / again["data"] / again["parts"][0]["part"]
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text("other\n")
    with pytest.raises(ValueError, match="has changed"):
        C.read_published(spark, str(tmp_path))
    empty = C.publish_result(rows.limit(0), str(tmp_path), "none")
    assert empty["rows"] == 0 and C.read_published(spark, str(tmp_path), "none").count() == 0


def test_state_by_any_batches_is_the_replay(spark, tmp_path):
    lines, want = random_log(31, 200)
    (tmp_path / "logs").mkdir()
    path = write_logs(tmp_path / "logs", lines, list(range(1, 7)))
    state = State(spark, "m", "student", str(tmp_path / "state"), SCHEMA, buckets=3)
    assert state.catch_up(path, files_per_batch=2) == 3 and by_key(state.rows()) == want
    assert by_key(replay(C.read_changelog(spark, path), "m", "student", SCHEMA)) == want
    assert len(NAMES) == len(SCHEMA.columns) and snapshots.VERSIONS == 2
