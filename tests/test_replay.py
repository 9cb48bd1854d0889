"""Log files, replay, lookups and streaming, against golden rows and a sequential model."""

import os
import random

import pytest
from pyspark.sql import functions as F

from relog.functions import logline as L
from relog.operators import lookup, stats
from relog.operators.replay import replay
from relog.sources import changelog as C

STUDENT = [("id", 1, 1), ("first_name", 2, 0), ("last_name", 2, 0), ("sex", 2, 0), ("score", 1, 0)]
NAMES = [c[0] for c in STUDENT]


def line(op, old_pk, new_pk, old=None, new=None, tbl="student", n=0, lead="|"):
    """One line; old and new map columns to values, None to NULL."""
    show = lambda v: "NULL" if v is None else str(v)
    out = f"{lead}b:{n}|1500000000000|m|{tbl}|{op}|id:1:1|{show(old_pk)}|{show(new_pk)}|"
    for name, kind, key in STUDENT:
        if not key and (name in (new or {}) or name in (old or {})):
            out += f"{name}:{kind}:0|{show((old or {}).get(name))}|{show((new or {}).get(name))}|"
    return out


def row(*values):
    return dict(zip(NAMES[1:], values, strict=True))


#: One case for each replay rule.
CORE = [
    line("I", None, 1, new=row("A", "a", "M", 10)),
    line("I", None, 2, new=row("B", "b", "F", 20)),
    line("I", None, 3, new=row("C", "c", "M", 30), lead=""),
    line("U", 2, 2, {"score": 20}, {"score": 25}),
    line("U", 3, 30, {"score": 30}, {"score": 35}),
    line("D", 1, None, old=row("A", "a", "M", 10)),
    line("I", None, 1, new=row("A2", "a2", "F", 11)),
    line("U", 30, 31),
    line("U", 31, 31, {"first_name": "C"}, {"first_name": "C9"}),
    line("U", 2, 200),
    line("I", None, 2, new=row("B2", "b2", "M", 22)),
    line("D", 2, None, old=row("B2", "b2", "M", 22)),
    line("U", 200, 200, {"last_name": "b"}, {"last_name": None}),
    line("I", None, 2**64 - 1, new=row("Z", "z", "M", 99)),
    line("I", None, 40, new=row("", "e", "M", 1)),
]
LIVE = [(1, "A2", "a2", "F", 11), (31, "C9", "c", "M", 35), (40, "", "e", "M", 1), (200, "B", None, "F", 25), (2**64 - 1, "Z", "z", "M", 99)]


def write_logs(folder, lines, names):
    size = -(-len(lines) // len(names))
    for i, name in enumerate(names):
        (folder / f"{name}.txt").write_text("".join(x + "\n" for x in lines[i * size : (i + 1) * size]), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def core(spark, tmp_path_factory):
    return C.read_changelog(spark, write_logs(tmp_path_factory.mktemp("core"), CORE, [1, 2, 10]))


def as_tuples(df):
    return [tuple(int(v) if hasattr(v, "as_tuple") else v for v in r) for r in df.collect()]


@pytest.mark.parametrize(("start", "end", "keys"), [(0, 100, [1, 31, 40]), (1, 31, []), (1, 32, [31]), (30, 201, [31, 40, 200]), (199, 201, [200]), (1, 4, []), (-1, 2**64, [r[0] for r in LIVE])])
def test_ranges(core, start, end, keys):
    got = as_tuples(lookup.range_query(core, lookup.RangeQuery("m", "student", start, end)))
    assert got == [r for r in LIVE if r[0] in keys]


def test_parse(spark):
    text = "|000001:106|1489133349000|test|user|I|id:1:1|NULL|102|name:2:0|<NULL>|ljh|score:1:0|NULL|98|"
    df = spark.createDataFrame([(text, (1, 0, 0)), ("broken", (1, 0, 1)), (text.replace("|I|", "|Q|"), (1, 0, 2)), (text.replace("|102|", "|x|"), (1, 0, 3))], "value string, seq struct<file_no:int,block_start:long,rid:long>")
    changes = C.parse(df)
    r = changes.where("seq.rid = 0").first()
    assert (r["binlog_id"], r["ts_ms"], r["db"], r["tbl"], r["op"], int(r["new_pk"]), r["old_pk"]) == ("000001:106", 1489133349000, "test", "user", "I", 102, None)
    assert [tuple(c) for c in r["cols"]] == [("id", 1, True, None, "102"), ("name", 2, False, None, "ljh"), ("score", 1, False, None, "98")]
    assert sorted((x["seq"]["rid"], x["problem"]) for x in stats.broken_lines(changes).collect()) == [(1, "fields"), (2, "op"), (3, "key")]
    schema = C.infer_schema(changes, "test", "user")
    assert schema.columns == (("id", 1, True), ("name", 2, False), ("score", 1, False)) and schema.struct().fieldNames() == ["id", "name", "score"]


def test_result_files(spark, core, tmp_path):
    out = str(tmp_path / "result")
    C.write_result(lookup.range_query(core, lookup.RangeQuery("m", "student", 0, 100)), out)
    parts = sorted(x for x in os.listdir(out) if x.startswith("part-"))
    assert "".join(open(f"{out}/{p}", encoding="utf-8").read() for p in parts) == "1\tA2\ta2\tF\t11\n31\tC9\tc\tM\t35\n40\t\te\tM\t1\n"


def test_changes_as_parquet(spark, core, tmp_path):
    C.write_changes(core, str(tmp_path / "changes"))
    changes = C.read_changes(spark, str(tmp_path / "changes"))
    assert sorted(as_tuples(replay(changes, "m", "student"))) == LIVE


def test_other_tables_and_split_files(spark, tmp_path):
    """Another table with the same keys in between, and splits of a few bytes."""
    lines = [x for pair in zip(CORE, [line("I", None, i, new=row("o", "o", "o", i), tbl="other") for i in range(len(CORE))], strict=True) for x in pair]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 10]))
        assert changes.rdd.getNumPartitions() > 5
        assert sorted(as_tuples(replay(changes, "m", "student"))) == LIVE
        assert replay(changes, "m", "other").count() == len(CORE)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lookups(spark, core):
    assert as_tuples(lookup.point_query(core, "m", "student", 200)) == [LIVE[3]]
    assert as_tuples(lookup.point_query(core, "m", "student", 3)) == []
    keys = spark.createDataFrame([(1, 200), (2, 9), (3, 1), (4, 200)], "ord int, pk long")
    assert [r[:2] for r in as_tuples(lookup.key_list_query(core, "m", "student", keys))] == [(1, 200), (3, 1), (4, 200)]
    assert [r["kind"] for r in lookup.history(core, 2).collect()] == ["END", "START", "END", "MOD", "START"]
    assert sorted(int(r["pk"]) for r in lookup.tombstones(core).collect()) == [2, 3, 30]
    assert sorted(int(r["pk"]) for r in lookup.origins(core, 30, 32).collect()) == [3, 30, 31]
    total = stats.counts_by_table(core).where("tbl is null").first()
    assert (total["inserts"], total["updates"], total["deletes"], total["key_moves"], total["total"]) == (7, 6, 2, 3, 15)


def test_quality_report(spark, tmp_path):
    bad = [line("U", 5, 5, {"score": 1}, {"score": 2}), line("I", None, 6, new=row("x", "y", "z", 1)), line("I", None, 6, new=row("x", "y", "z", 2)), line("I", None, 7, new={"score": 3}), line("D", 8, None), "|x|1|m|student|I|id:1:1|NULL|"]
    changes = C.read_changelog(spark, write_logs(tmp_path, bad, [1]))
    schema = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))
    found = sorted((int(r["pk"]) if r["pk"] is not None else None, r["problem"]) for r in stats.quality_report(changes, schema).collect() if r["pk"] is not None)
    assert found == [(5, "orphan"), (6, "occupied"), (7, "incomplete"), (8, "orphan")]
    assert stats.broken_lines(changes).count() == 1


def random_log(seed, n=250):
    """A valid log and its final rows, by plain sequential replay."""
    rng, state, lines = random.Random(seed), {}, []
    value = lambda: rng.choice([None, "", "v", "NULLX", "é", str(rng.randint(0, 9))])
    for i in range(n):
        op = rng.choice("IIUUUMMD")
        free = [k for k in range(12) if k not in state]
        if op == "I" and free:
            pk, new = rng.choice(free), row(value(), value(), value(), rng.randint(0, 99))
            lines.append(line("I", None, pk, new=new, n=i))
            state[pk] = dict(new)
        elif state and op in "UMD":
            pk = rng.choice(list(state))
            if op == "D":
                lines.append(line("D", pk, None, old=state.pop(pk), n=i))
                continue
            new = {c: (rng.randint(0, 99) if c == "score" else value()) for c in NAMES[1:] if rng.random() < 0.4}
            to = rng.choice(free) if op == "M" and free else pk
            if to == pk and not new:
                continue
            old = {c: state[pk][c] for c in new}
            lines.append(line("U", pk, to, old, new, n=i))
            state[to] = state.pop(pk) | new
    return lines, sorted((k, *[v[c] for c in NAMES[1:]]) for k, v in state.items())


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, tmp_path, seed):
    lines, want = random_log(seed)
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 3, 10, 11]))
    schema = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))
    assert sorted(as_tuples(replay(changes, "m", "student", schema)), key=lambda r: r[0]) == want
    assert stats.misplaced_events(changes).count() == 0


def test_long_chain(spark, tmp_path):
    """A row that moves 100 times keeps what was set on the way."""
    lines = [line("I", None, 0, new=row("a", "b", "c", 0))]
    lines += [line("U", i, i + 1, *(({"score": 0}, {"score": i}) if i % 10 == 0 else ({}, {}))) for i in range(100)]
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2]))
    assert as_tuples(replay(changes, "m", "student")) == [(100, "a", "b", "c", 90)]


def test_empty_log(spark, tmp_path):
    (tmp_path / "1.txt").write_text("")
    changes = C.read_changelog(spark, str(tmp_path))
    schema = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))
    assert replay(changes, "m", "student", schema).count() == 0
    with pytest.raises(ValueError, match="no insert"):
        C.infer_schema(changes, "m", "student")


def test_text_helpers(spark):
    df = spark.createDataFrame([("a", None, 3), ("", "x", None)], "a string, b string, c int")
    assert [r[0] for r in df.select(L.tsv_text(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["a\tNULL\t3", "\tx\tNULL"]


def test_logs_and_bounded_files(spark, core, tmp_path):
    """Lines written as a log keep their order; result files have bounded rows; results come as an iterator."""
    lines = C.lines(spark, write_logs((tmp_path / "in"), CORE, [1, 2, 10])) if (tmp_path / "in").mkdir() is None else None
    C.write_log(lines.where(F.col("value").contains("|student|")), str(tmp_path / "log"))
    assert all(x.split(".")[0].isdigit() for x in os.listdir(tmp_path / "log") if x.endswith(".txt"))
    assert sorted(as_tuples(replay(C.read_changelog(spark, str(tmp_path / "log")), "m", "student"))) == LIVE
    rows = lookup.range_query(core, lookup.RangeQuery("m", "student", -1, 2**64))
    C.write_result(rows, str(tmp_path / "out"), rows_per_file=2)
    parts = [open(tmp_path / "out" / p, encoding="utf-8").read() for p in sorted(os.listdir(tmp_path / "out")) if p.startswith("part-")]
    assert all(p.count("\n") <= 2 for p in parts) and [int(x.split("\t")[0]) for x in "".join(parts).splitlines()] == [r[0] for r in LIVE]
    assert [x.split("\t")[0] for x in C.result_lines(rows)] == [str(r[0]) for r in LIVE]


def test_key_in_any_column(spark):
    """The key is found wherever it stands, also beside values that look like columns."""
    text = "|b:1|5|m|t|U|name:2:0|x:1:1|9:1:1|id:1:1|4|7|"
    r = C.parse(spark.createDataFrame([(text, (1, 0, 0))], "value string, seq struct<file_no:int,block_start:long,rid:long>")).first()
    assert (int(r["old_pk"]), int(r["new_pk"])) == (4, 7)


def test_as_of_join(spark, core):
    states = spark.createDataFrame([("m", "t", 1, (1, 0, i), f"v{i}") for i in range(0, 10, 3)], "db string, tbl string, pk int, seq struct<file_no:int,block_start:long,rid:long>, v string")
    asked = spark.createDataFrame([("m", "t", p, (1, 0, i)) for p, i in ((1, 0), (1, 3), (1, 4), (1, 99), (2, 5))], "db string, tbl string, pk int, seq struct<file_no:int,block_start:long,rid:long>")
    got = sorted((r["pk"], r["seq"]["rid"], r["state"] and r["state"]["v"]) for r in lookup.as_of_join(states, asked).collect())
    assert got == [(1, 0, None), (1, 3, "v0"), (1, 4, "v3"), (1, 99, "v9"), (2, 5, None)]
