"""Every named query against its DuckDB oracle on the smallest scale factor."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, table_digest  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

from sessionlake.plans.catalog import QUERIES  # noqa: E402

SLOW = {"sessionize_stream"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(entry.oracle_sql())
    assert not missing


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_oracle(spark, duck, name):
    got = table_digest(entry.queries()[name](spark, SF_SMALL).toPandas())
    want = table_digest(duck.execute(entry.oracle_sql()[name]).df())
    assert got[0] == want[0], "columns"
    assert got[1] == want[1], "row count"
    assert got[2] == want[2], "values"


def test_stream_matches_batch(spark, duck):
    got = table_digest(entry.queries()["sessionize_stream"](spark, SF_SMALL).toPandas())
    want = table_digest(duck.execute(entry.oracle_sql()["sessionize_stream"]).df())
    assert got[1:3] == want[1:3]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["stream_key", "is_active", "app_id", "workspace", "total_time"]
