"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from relog.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("orders", "events", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    show = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(tuple(repr(show(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "status", "priority", "cust", "cents"]
