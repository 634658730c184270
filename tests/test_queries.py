"""Every registered query of the engine against its statement in DuckDB, at the smallest size."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from aerolith.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


#: The smallest tables have no two days with all features.
TOO_SMALL = {"time_split"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TOO_SMALL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(str, ([plain(v) for v in r] for r in df.select(*columns).collect())))
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(map(str, ([plain(r[i]) for i in at] for r in result.fetchall())))
    assert got == want


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
