"""Rows that change their key: as-of states, and lookups that replay only what could have led to the asked keys."""

import pytest
from pyspark.sql import functions as F
from test_replay import NAMES, STUDENT, as_tuples, line, random_log, row, write_logs

from relog.functions import logline as L
from relog.operators import lookup
from relog.operators.replay import END, running_state
from relog.sources import changelog as C

SCHEMA = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))
COLUMNS = NAMES[1:]


def states_by_hand(lines):
    """pk, kind and values after each event, by walking through the log."""
    state, out = {}, []
    for text in lines:
        parts = text.rstrip("\n").removeprefix("|").removesuffix("|").split("|")
        cols = [(parts[i].split(":")[0], parts[i + 1], parts[i + 2]) for i in range(5, len(parts), 3)]
        old, new = cols[0][1:]
        sets = {n: None if v in L.NULL_WORDS else v for n, _, v in cols[1:]}
        show = lambda pk, kind, r: (pk, kind, *[r.get(c) for c in COLUMNS])
        if parts[4] == "I":
            state[new] = dict(sets)
            out.append(show(int(new), "START", sets))
        elif parts[4] == "D":
            out.append(show(int(old), "END", state.pop(old)))
        else:
            before = state.pop(old)
            if old != new:
                out.append(show(int(old), "END", before))
            state[new] = before | sets
            out.append(show(int(new), "MOD" if old == new else "START", state[new]))
    return out


@pytest.mark.parametrize("seed", [11])
def test_states_follow_moves(spark, tmp_path, seed):
    lines, _ = random_log(seed)
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 10]))
    got = running_state(changes, COLUMNS).select(F.col("pk").cast("long"), "kind", *COLUMNS)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, states_by_hand(lines)))


def test_as_of_a_long_chain(spark, tmp_path):
    """What each of 120 keys in a chain stood for at its move, and just before it came."""
    n = 120
    lines = [line("I", None, 0, new=row("a", "b", "c", 0))]
    lines += [line("U", i, i + 1, *(({"score": 0}, {"score": i}) if i % 10 == 0 else ({}, {}))) for i in range(n)]
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 3]))
    states = running_state(changes, COLUMNS)
    ends = {int(r["pk"]): r["score"] for r in states.where(F.col("kind") == END).collect()}
    assert ends == {i: str(max(0, (i - 1) // 10 * 10)) if i else "0" for i in range(n)}
    asked = states.where(F.col("kind") == END).select("db", "tbl", "pk", "seq")
    found = lookup.as_of_join(states.select("db", "tbl", "pk", "seq", "kind", *COLUMNS), asked).select("pk", "state.*").collect()
    assert {int(r["pk"]): (r["kind"], r["first_name"], r["score"]) for r in found} == {i: ("START", "a", s) for i, s in ends.items()}
    moves = lookup.key_moves(changes)
    assert sorted(int(r["pk"]) for r in lookup.led_from(moves, moves.where(F.col("new_pk") == 80)).collect()) == list(range(80))
    assert as_tuples(lookup.point_query(changes, "m", "student", n)) == [(n, "a", "b", "c", n - 10)]


@pytest.mark.parametrize("seed", [21])
def test_lookups_replay_only_what_they_need(spark, tmp_path, seed):
    lines, want = random_log(seed, 400)
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2, 3, 10]))
    for start, end in ((2, 7), (8, 2**64 - 1)):
        got = as_tuples(lookup.range_query(changes, lookup.RangeQuery("m", "student", start, end), SCHEMA))
        assert got == [r for r in want if start < r[0] < end]
    for pk in (0, 5):
        assert as_tuples(lookup.point_query(changes, "m", "student", pk, SCHEMA)) == [r for r in want if r[0] == pk]
    asked = [(1, 3), (2, 11), (3, 99), (4, 3), (5, None)]
    keys = spark.createDataFrame(asked, "ord int, pk long")
    got = [(r[0], *r[1:]) for r in as_tuples(lookup.key_list_query(changes, "m", "student", keys, SCHEMA))]
    assert got == [(o, *r) for o, pk in asked for r in want if r[0] == pk]


def test_many_keys_meet_the_lines_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "LISTED_KEYS", 0)
    lines, want = random_log(24)
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1, 2]))
    keys = spark.createDataFrame([(i, i) for i in range(12)], "ord int, pk long")
    for most in (0, 100):
        monkeypatch.setattr(lookup, "BROADCAST_KEYS", most)
        assert [r[1:] for r in as_tuples(lookup.key_list_query(changes, "m", "student", keys, SCHEMA))] == want
        assert as_tuples(lookup.range_query(changes, lookup.RangeQuery("m", "student", 2, 7), SCHEMA)) == [r for r in want if 2 < r[0] < 7]


def test_lines_of_other_keys_are_dropped(spark, tmp_path):
    lines = [line("I", None, i, new=row("a", "b", "c", i)) for i in range(50)] + [line("U", 3, 100, {}, {}), line("U", 100, 200, {}, {}), line("U", 4, 101, {}, {})]
    changes = C.read_changelog(spark, write_logs(tmp_path, lines, [1]))
    kept = lookup.of_rows(changes, lambda pk: pk == 200)
    assert sorted((r["op"], int(r["new_pk"])) for r in kept.collect()) == [("I", 3), ("U", 100), ("U", 200)]
