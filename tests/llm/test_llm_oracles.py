"""Corpus queries with SQL give the same rows as DuckDB, values and all."""

import os

import duckdb
import pytest

from dyadic.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    got = QUERIES[name](spark, sf).toArrow()
    cols = sorted(got.column_names)
    want = con.sql(ORACLES[name])
    assert cols == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.to_pylist())
    names = want.columns
    assert rows == sorted(repr(tuple(v for _, v in sorted(zip(names, r)))) for r in want.fetchall())


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
