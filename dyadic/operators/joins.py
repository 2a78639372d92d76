"""Join helpers (JN-2/3/5): lookups of parameter tables by id, with the
broadcast decision taken from a known row count instead of a guess."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameter / dictionary tables are broadcast up to this many rows and bytes.
# The row count is always known exactly (field cardinality or entity count) and
# a row's width follows from its schema and, for vectors, ``width``, so nothing
# that grows with the fact table is ever broadcast.  A job joins at most half
# a dozen such tables at once.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
VECTOR_BYTES = 128  # of an array column whose length is not given


def row_bytes(schema: T.StructType, width: int | None = None) -> int:
    """Bytes of a row: 16 a field, arrays by their length."""
    return sum((8 * width if width else VECTOR_BYTES) if isinstance(f.dataType, T.ArrayType) else 16 for f in schema)


def fits_broadcast(schema: T.StructType, nrows: int | None, limit: int = BROADCAST_ROWS, width: int | None = None) -> bool:
    return nrows is not None and nrows <= limit and nrows * row_bytes(schema, width) <= BROADCAST_BYTES


def sized_broadcast(df: DataFrame, nrows: int | None, limit: int = BROADCAST_ROWS, width: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its exact row count is under ``limit`` and
    its rows fit ``BROADCAST_BYTES``; otherwise leave the strategy to the
    planner (sort-merge, AQE skew split)."""
    if fits_broadcast(df.schema, nrows, limit, width):
        return F.broadcast(df)
    return df


def packable(cards: Mapping[str, int]) -> list[str]:
    """The fields whose codes (0 to ``cards`` - 1, or null) share one long."""
    out, n = [], 1
    for c in sorted(cards, key=lambda f: cards[f]):
        n *= cards[c] + 1
        if n > 1 << 62:
            break
        out.append(c)
    return out


def packed_codes(fields: Sequence[str], cards: Mapping[str, int]) -> Column:
    """Codes of several fields as one long, 0 of a field standing for null:
    rows that move are narrower by a column a field."""
    p = F.lit(0).cast("long")
    for c in fields:
        p = p * F.lit(cards[c] + 1) + F.coalesce(F.col(c).cast("long") + 1, F.lit(0))
    return p


def unpacked_codes(fields: Sequence[str], cards: Mapping[str, int], kinds: Mapping[str, str], packed: str = "__packed") -> dict[str, Column]:
    """The columns that :func:`packed_codes` put together, of their old types."""
    out, below = {}, 1
    for c in reversed(fields):
        x = F.pmod(F.expr(f"{packed} div {below}L"), F.lit(cards[c] + 1))
        out[c] = F.when(x > 0, (x - 1).cast(kinds[c]))
        below *= cards[c] + 1
    return out


def gather(fact: DataFrame, params: DataFrame, on: str | Sequence[str],
           nrows: int | None = None, how: str = "inner") -> DataFrame:
    """Equi lookup of parameters by id (JN-2)."""
    return fact.join(sized_broadcast(params, nrows), on, how)


def gather_cold_start(fact: DataFrame, params: DataFrame, on: str, value_cols: Sequence[str],
                      zero_vec_len: dict[str, int] | None = None,
                      nrows: int | None = None) -> DataFrame:
    """Left lookup; unseen ids get bias 0 / zero vectors and ``is_cold``
    (JN-3)."""
    marked = params.withColumn("__seen", F.lit(True))
    out = fact.join(sized_broadcast(marked, nrows), on, "left")
    zero_vec_len = zero_vec_len or {}
    fills = {}
    for c in value_cols:
        if c in zero_vec_len:
            fills[c] = F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), zero_vec_len[c]))
        else:
            fills[c] = F.coalesce(F.col(c), F.lit(0.0))
    fills["is_cold"] = F.col("__seen").isNull()
    return out.withColumns(fills).drop("__seen")


# ---------------------------------------------------------------- skew-safe co-partitioned lookups
from dataclasses import dataclass, field  # noqa: E402


@dataclass
class SaltPlan:
    """Salting of a row frame for lookups of a table keyed by ``keys`` that
    is too large to broadcast (parameters, per-group totals).

    A key holding more rows than one partition's share (a *hot* key; at most
    ``nparts`` of them exist) is split over several salt values, every other
    key uses salt 0, and the looked-up table repeats a hot key's row once per
    salt.  The join on (keys, salt) then gives no task more than about one
    partition's share of rows, whatever the key skew, without relying on
    runtime skew detection.  ``hot`` is the (bounded) table of hot keys and
    their salt counts; it joins as a broadcast constant."""
    keys: list
    nparts: int
    hot: DataFrame | None = None
    salts: dict = field(default_factory=dict)
    total: int = 0  # rows counted

    @property
    def key(self) -> str:
        return self.keys[0]


def plan_salts(rows: DataFrame, key, nparts: int, counts: DataFrame | None = None) -> SaltPlan:
    """``counts``: an existing (keys..., n) aggregate of ``rows`` to reuse."""
    keys = [key] if isinstance(key, str) else list(key)
    if counts is None:
        total = rows.count()
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))   # partial sums per task
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // nparts))
    # keys above one partition's share: at most nparts of them by construction
    hot = (counts.filter(F.col("n") > share)
                 .select(*keys, F.ceil(F.col("n") / F.lit(share)).cast("int").alias("__nsalt")).collect())
    if not hot:
        return SaltPlan(keys, nparts, total=total)
    schema = counts.select(*keys).schema.add("__nsalt", T.IntegerType())
    hot_df = rows.sparkSession.createDataFrame([tuple(r) for r in hot], schema)
    salts = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["__nsalt"] for r in hot}
    return SaltPlan(keys, nparts, hot_df, salts, total)


def _with_nsalt(df: DataFrame, plan: SaltPlan) -> DataFrame:
    if plan.hot is None:
        return df.withColumn("__nsalt", F.lit(1))
    return (df.join(F.broadcast(plan.hot), plan.keys, "left")
              .withColumn("__nsalt", F.coalesce(F.col("__nsalt"), F.lit(1))))


def salt_rows(rows: DataFrame, plan: SaltPlan, salt_col: str = "__salt") -> DataFrame:
    """Add ``salt_col``: a hash of the row's values modulo its key's salt
    count (0 for every key that is not hot)."""
    h = F.xxhash64(*[F.col(c) for c in rows.columns])
    out = _with_nsalt(rows.withColumn("__h", h), plan)
    return out.withColumn(salt_col, F.pmod(F.col("__h"), F.col("__nsalt")).cast("int")).drop("__h", "__nsalt")


def salt_params(params: DataFrame, plan: SaltPlan, salt_col: str = "__salt") -> DataFrame:
    """Rows of the looked-up table for a join on (keys, salt): hot keys
    repeated once per salt (at most nparts keys, each a few times)."""
    out = _with_nsalt(params, plan)
    return out.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.col("__nsalt") - 1))).drop("__nsalt")


def salted_lookup(rows: DataFrame, params: DataFrame, plan: SaltPlan, how: str = "left",
                  salt_col: str = "__salt") -> DataFrame:
    """Join a large keyed table to salted rows: the shuffle on (keys, salt)
    spreads a hot key over several tasks."""
    return rows.join(salt_params(params, plan, salt_col), [*plan.keys, salt_col], how)
