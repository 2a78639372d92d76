"""Reshaping (RS-1/2/3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sparse_entries(df: DataFrame, uid: str, iid: str, target: str,
                   order_key: Sequence[str]) -> DataFrame:
    """Deduplicated (uid, iid, value): for repeated pairs the value of the
    row with the largest ``order_key`` wins (RS-2)."""
    key = F.struct(*[F.col(c) for c in order_key])
    return df.groupBy(uid, iid).agg(F.max_by(F.col(target), key).alias("value"))


def pivot_ratings(df: DataFrame, uid: str, iid: str, target: str, order_key: Sequence[str],
                  users: DataFrame, items: Sequence) -> DataFrame:
    """users x items matrix, every user of ``users`` present, missing = 0
    (RS-1).  ``items``, the caller's choice, become columns; ``n_other`` counts
    a user's entries for all other items, whose long form is
    :func:`sparse_entries`."""
    items = list(items)
    entries = sparse_entries(df, uid, iid, target, order_key)
    cells = [F.max(F.when(F.col(iid) == F.lit(i), F.col("value"))).alias(str(i)) for i in items]
    wide = entries.groupBy(uid).agg(*cells, F.count(F.when(~F.col(iid).isin(items), 1)).alias("n_other"))
    return users.select(uid).join(wide, uid, "left").fillna(0.0, subset=[str(i) for i in items]).fillna(0, subset=["n_other"])


def rating_blocks(df: DataFrame, uid: str, iid: str, target: str, order_key: Sequence[str], users: DataFrame,
                  codes: DataFrame, width: int = 16) -> DataFrame:
    """The users x items matrix in blocks of ``width`` items (RS-1): ``(uid,
    block, cells array<double>)``, cell j of block b being item code ``b * width
    + j``, missing = 0.  ``codes``: (iid, code) of every item, from the data.
    Blocks without an entry are left out, as their cells are all 0; a user
    without any entry has block 0.  A group holds at most ``width`` entries."""
    entries = sparse_entries(df, uid, iid, target, order_key).join(codes, iid)
    at = entries.select(uid, F.expr(f"code div {width}").alias("block"), (F.col("code") % width).cast("int").alias("pos"), "value")
    cells = at.groupBy(uid, "block").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    empty = F.array(*[F.lit(0.0)] * width)
    out = users.select(uid).distinct().join(cells, uid, "left")
    return out.select(uid, F.coalesce("block", F.lit(0).cast("long")).alias("block"),
                      F.when(F.col("m").isNull(), empty).otherwise(wide).alias("cells"))


def unpivot_stats(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                  var: str = "feature", val: str = "value") -> DataFrame:
    """Wide -> long (RS-3)."""
    return df.unpivot(list(ids), list(values), var, val)
