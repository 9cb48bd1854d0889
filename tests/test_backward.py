"""Rows of keys from the newest files backwards: the same as replay's, and no older file than needed."""

import pytest
from test_replay import STUDENT, as_tuples, line, random_log, row, write_logs

from relog.operators.backward import latest_rows
from relog.sources import changelog as C

SCHEMA = C.TableSchema(tuple((n, k, bool(p)) for n, k, p in STUDENT))


def listed(spark, path, pks):
    keys = spark.createDataFrame(list(enumerate(pks)), "ord int, pk long")
    rows, files = latest_rows(spark, path, "m", "student", keys, SCHEMA)
    return as_tuples(rows), files


@pytest.mark.parametrize("seed", [41, 42])
def test_any_log(spark, tmp_path, seed):
    lines, want = random_log(seed, 300)
    pks = [*range(12), 5, 99, None]
    got, files = listed(spark, write_logs(tmp_path, lines, [1, 2, 3, 4, 10, 11]), pks)
    assert got == [(o, *r) for o, pk in enumerate(pks) for r in want if r[0] == pk]
    assert files[0] == 11


def test_older_files_are_not_read(spark, tmp_path):
    """Rows set, inserted, moved with all columns, or ended in the newest files need no older ones."""
    old = [line("I", None, i, new=row("a", "b", "c", i)) for i in range(40)]
    whole = {"first_name": "x", "last_name": "y", "sex": "z", "score": 9}
    new = [line("U", 3, 3, row("a", "b", "c", 3), whole), line("U", 4, 104, row("a", "b", "c", 4), whole), line("D", 5, None, old=row("a", "b", "c", 5)), line("I", None, 5, new=row("n", "n", "n", 1)), line("D", 6, None, old=row("a", "b", "c", 6)), line("U", 7, 107, {}, {}), line("U", 8, 8, {"sex": "c"}, {"sex": None}), *old[:0]]
    path = write_logs(tmp_path, old, [1, 2, 3, 4])
    (tmp_path / "new").mkdir()
    write_logs(tmp_path / "new", new, [5])
    (tmp_path / "new" / "5.txt").rename(tmp_path / "5.txt")
    (tmp_path / "new").rmdir()
    set_ = ("x", "y", "z", 9)
    assert listed(spark, path, [3, 104, 5, 6, 4]) == ([(0, 3, *set_), (1, 104, *set_), (2, 5, "n", "n", "n", 1)], [5])
    got, files = listed(spark, path, [107, 8])
    assert got == [(0, 107, "a", "b", "c", 7), (1, 8, "a", "b", None, 8)] and files == [5, 4, 2, 3, 1][: len(files)] and len(files) > 1
    got, files = listed(spark, path, [35, 38])  # the newest but one
    assert [r[1] for r in got] == [35, 38] and files == [5, 4]
