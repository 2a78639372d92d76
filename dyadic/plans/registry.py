"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# SQL view D (same mapping as dyadic.sources.tables.dyads) for oracles.
D_SQL = """d AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity,
         l.l_extendedprice, l.l_shipdate,
         o.o_custkey AS uid, l.l_partkey AS iid,
         CAST(year(o.o_orderdate) AS BIGINT) AS term,
         l.l_quantity / 10.0 AS y,
         c.c_mktsegment, p.p_brand, o.o_orderpriority, l.l_returnflag,
         l.l_discount, l.l_tax, p.p_retailprice, c.c_acctbal
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

# SQL view E (same mapping as dyadic.sources.tables.events_dyads).
E_SQL = """e AS (
  SELECT event_id, user_id AS sid, event_type AS cid,
         CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS term,
         LEAST(4.0, GREATEST(0.0, value / 100.0)) AS grade,
         CAST(1 + event_id % 4 AS DOUBLE) AS hours
  FROM events)"""

# Train / test split of D by the last term.
SPLIT_SQL = D_SQL + """,
mx AS (SELECT max(term) AS last FROM d),
ds AS (SELECT d.*, CASE WHEN term = (SELECT last FROM mx) THEN 'test' ELSE 'train' END AS split FROM d)"""
