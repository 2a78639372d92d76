"""Every registered query with an SQL oracle matches DuckDB on the small
tables (rows, columns and values)."""

import duckdb
import pytest

import __spark_entry__ as E
from dyadic.plans import ORACLES
from check_oracles import TABLES, compare

NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    assert compare(E.queries()[name](spark, sf).toArrow(), con.sql(ORACLES[name])) is None


def test_every_query_has_callable_and_entry(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    out = E.entry(spark)
    rows = out.collect()
    assert {r["model"] for r in rows} == {"GM", "UR"}
