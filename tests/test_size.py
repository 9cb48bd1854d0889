"""What keeps work in proportion to the input: lines taken apart once, windows over keys, small compacted files."""

import re

from pyspark.sql import functions as F

from relog.operators import replay as R
from relog.operators.running import running
from relog.plans.derived import event_lines, order_lines
from relog.sources import changelog as C
from relog.sources import store
from relog.sources.store import EventStore

SF = "/root/testdata/sf0.001"


def test_filters_on_changes_split_a_line_once(spark, capsys):
    inserts = C.parse(event_lines(spark, SF)).where("op = 'I' and new_pk is not null and db = 'shop' and tbl = 'users'")
    inserts.select("db", "tbl", "op").explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert len(re.findall(r"split\(CASE WHEN EndsWith", plan)) == 1


def test_first_inserts_are_looked_for_by_place(spark, capsys, monkeypatch):
    changes = C.parse(event_lines(spark, SF))
    found = C.schemas(changes)
    found.explain("extended")
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_id,", capsys.readouterr().out)
    want = found.collect()
    monkeypatch.setattr(C, "LISTED_TABLES", 0)
    assert C.schemas(changes).collect() == want and len(want) == 1


def test_running_values_of_small_and_large_keys(spark, capsys):
    """A key with a third of the rows is worked on in blocks, all others by one window over the key."""
    rows = [("d", "t", 7 if i % 3 == 0 else 100 + i % 50, (i // 200, i // 20, i), i % 5, i if i % 4 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "db string, tbl string, pk int, seq struct<file_no:int,block_start:long,rid:long>, x long, y int").repartition(5)
    state, want = {}, {}
    for _, _, pk, at, x, y in rows:
        total, last = state.get(pk, (0, None))
        want[at[2]] = (total + x, last)
        state[pk] = (total + x, last if y is None else y)
    for held, windows in ((10**6, 1), (100, 3), (1, 2)):
        got = running(df, sums={"total": F.col("x")}, lasts={"last": F.col("y")}, held=held)
        got.explain()
        assert len(re.findall(r"Window \[", capsys.readouterr().out)) >= windows
        assert {r["seq"]["rid"]: (r["total"], r["last"]) for r in got.collect()} == want


def test_compaction_makes_files_that_tasks_can_sort(spark, tmp_path):
    assert store.FULL <= 64 << 20
    changes = C.parse(event_lines(spark, SF))
    kept = EventStore(spark, str(tmp_path / "store"))
    kept.append(changes, 4)
    size = sum(f["bytes"] for f in kept.append(changes, 4)["files"])
    after = kept.compact(full=size * 2 // 3)  # one and a half times what a file should hold
    assert len({f["file"] for f in after["files"]}) == 2 and sum(f["rows"] for f in after["files"]) == 2 * changes.count()


def test_lines_are_made_by_code_that_the_jvm_compiles(spark, capsys):
    """The JVM interprets methods of more than 8000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        order_lines(spark, SF).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_a_value_is_found_without_lambdas(spark, capsys):
    cols = [("id", 1, True, None, "x"), ("a", 1, False, None, None), ("a", 2, False, None, "late"), ("c", 2, True, "p", "q"), ("c", 2, False, "p", "r"), (None, 2, False, None, "s")]
    df = spark.createDataFrame([(cols,), ([],), (None,)], "cols array<struct<name:string,type:int,is_pk:boolean,old:string,new:string>>")
    got = df.select(*[R.value_at(F.col("cols"), n).alias(n) for n in ("id", "a", "c", "none")])
    got.explain()
    assert "lambda" not in capsys.readouterr().out
    assert [tuple(r) for r in got.collect()] == [(None, (None,), ("r",), None), (None,) * 4, (None,) * 4]


def test_only_later_moves_of_a_chain_are_doubled(spark, monkeypatch):
    """A segment whose parent no move began has that as its root at once; one without a parent is its own root."""
    moved = spark.createDataFrame([("d", "t", s, e, f, a) for s, e, f, a in ((1, 3, False, True), (3, 5, True, True), (5, 7, True, True), (7, None, True, False), (2, 4, False, True), (4, None, True, False), (6, None, True, False))], "db string, tbl string, start_seq int, end_seq int, from_move boolean, moved_away boolean")
    seen, doubled = [], R.doubled
    monkeypatch.setattr(R, "doubled", lambda rooted, open_: seen.append(open_.count()) or doubled(rooted, open_))
    assert {r["start_seq"]: r["root"] for r in R.roots(moved).collect()} == {3: 1, 5: 1, 7: 1, 4: 2, 6: 6}
    assert seen == [2]


def test_keys_that_led_to_a_move_take_no_join_for_known_places(spark, monkeypatch):
    """Each link of moves leads to a move, so no join asks whether it does."""
    from relog.operators import lookup

    at = lambda i: (1, 0, i)
    moves = spark.createDataFrame([("d", "t", at(i), a, b) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 4), (8, 9)])], "db string, tbl string, seq struct<file_no:int,block_start:long,rid:long>, old_pk int, new_pk int")
    seen, doubled = [], R.doubled
    monkeypatch.setattr(lookup, "doubled", lambda rooted, open_: seen.append(open_.count()) or doubled(rooted, open_))
    assert {r["pk"] for r in lookup.led_from(moves, moves.where("new_pk = 4")).collect()} == {1, 2, 3}
    assert seen == [2]


def test_values_are_read_from_fields(spark, capsys):
    """Columns are only built for lines that are not as the schema says; the values are the same for all lines."""
    schema = C.TableSchema((("id", 1, True), ("a", 2, False), ("b", 1, False)))
    usual = ["|x|1|d|t|I|id:1:1|NULL|1|a:2:0|NULL|p|b:1:0|NULL|7|", "x|1|d|t|U|id:1:1|1|1|b:1:0|7|NULL", "|x|1|d|t|U|id:1:1|1|2|", "|x|1|d|t|D|id:1:1|2|NULL|a:2:0|p|NULL|b:1:0|NULL|<NULL>|"]
    odd = [
        "|x|1|d|t|I|a:2:0|NULL|first|id:1:1|NULL|3|",  # the key comes second
        "|x|1|d|t|I|id:1:1|NULL|4|a:1:0|NULL|1|a:2:0|NULL|2|",  # twice, once under another type
        "|x|1|d|t|I|id:1:1|NULL|5|a:2:0|NULL|1|a:2:0|NULL|2|",
        "|x|1|d|t|I|id:1:1|NULL|6|b:1:0|a:2:0|a:2:0|a:2:0|NULL|v|",  # values that read like a column's head
        "|a:2:0|1|d|t|I|id:1:1|NULL|7|a:2:0|NULL|v|",
        "|x|1|d|t|I|id:1:1|NULL|8|a:2:1|NULL|key|a|NULL|bare|c:2:0|NULL|more|",
        "|x|1|d|t|I|id:1:1|NULL|9|a:2:0|NULL|",  # fields that don't come out even
        "|x|1|d|t|Q|id:1:1|NULL|10|a:2:0|NULL|v|",
        "|x|1|d|t|I|id:1:1|NULL|no number|a:2:0|NULL|v|",
        "|x|1",
    ]
    rows = [(text, (1, 0, i)) for i, text in enumerate(usual + odd)]
    changes = C.parse(spark.createDataFrame(rows, "value string, seq struct<file_no:int,block_start:long,rid:long>"))
    events = R.value_events(changes, schema)
    assert sorted(map(repr, events.collect())) == sorted(map(repr, R.value_events(changes.drop("parts"), schema).collect()))
    firsts = {int(r["pk"]): (r["v0"] and r["v0"]["v"], r["v1"] and r["v1"]["v"]) for r in events.where("kind = 'START'").collect()}
    assert firsts == {1: ("p", "7"), 2: (None, None), 3: ("first", None), 4: ("1", None), 5: ("1", None), 6: ("v", "a:2:0"), 7: ("v", None), 8: ("bare", None)}
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = R.value_events(C.parse(order_lines(spark, SF)), schema)
        made.explain("extended")
        taken_apart = [x for x in capsys.readouterr().out.split("== Physical Plan ==")[1].splitlines() if "lambda" in x]
        assert taken_apart and all(".odd" in x and not re.search(r"transform\([^)]*parts#", x) for x in taken_apart)
        made.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)) < 8000
