"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c) -> Column:
    """Round to 6 decimals; ``+ 0.0`` turns -0.0 into 0.0 (same in SQL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(ROUND({expr}, 6) + 0.0)"


def cnt() -> Column:
    return F.count(F.lit(1)).cast("long")


# Row draw id for D: the counter RNG takes (l_orderkey, stream, draw) with
# draw = l_partkey * 8 + l_linenumber.
def row_draw() -> Column:
    return F.col("l_partkey") * 8 + F.col("l_linenumber")


ROW_DRAW_SQL = "(l_partkey * 8 + l_linenumber)"


def r2(c) -> Column:
    """Round large sums (money-scale) to 2 decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 2) + F.lit(0.0)


def s2(expr: str) -> str:
    return f"(ROUND({expr}, 2) + 0.0)"


def rn(c, d: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, d) + F.lit(0.0)


def sn(expr: str, d: int) -> str:
    return f"(ROUND({expr}, {d}) + 0.0)"


def held_dyads(spark, sf, *columns):
    """View D, or the named columns of it, materialised once in the checkpoint
    folder (queries that read it several times: hold-out term, ids, statistics,
    scoring)."""
    from dyadic.operators.iterate import cut
    from dyadic.sources.tables import dyads
    d = dyads(spark, sf)
    return cut(d.select(*columns) if columns else d, spread=True)


def hold_out(d):
    """Temporal hold-out of view D; the year split is also given as an
    order-date range so it reaches the orders scan."""
    from dyadic.operators.prep import temporal_holdout
    return temporal_holdout(d, "term", date_col="o_orderdate" if "o_orderdate" in d.columns else None)
