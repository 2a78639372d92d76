"""Row frames that look parameters up by key and sum by key, whatever the
keys' skew (JN-2, AG-9).

The tables that one job looks up share one broadcast budget, filled from the
smallest up by their real widths.  A table beyond it is joined by a shuffle,
and then a hot key (one with more rows than a partition's share) is dealt over
several salts, stored with the rows: the join runs on (key, salt).  A sum by
such a key has two levels: by (key, salt), which the join has already put
together, and, after a second exchange of at most one row per (key, salt), by
key.  So no task ever sees more of a key than one share.

Rows that are read many times stay at home (:func:`settle`): they are written
once, bucketed by a spot of their widest key, a hot key being dealt over several
spots.  That key's tables come to the rows and its sums end where the rows lie,
so neither moves a row.  Of any other large key only values travel: to the rows,
next to a row's spot and number, and from them, next to the key.

``Generations`` holds the state of the rows while a fit moves (residuals and
what else is kept up to date): a new Parquet table per block, from which each
step reads only its own columns; the table before the last is removed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.operators.iterate import cut, row_partitions, table_at
from dyadic.operators.joins import BROADCAST_BYTES, SaltPlan, packable, packed_codes, plan_salts, salt_params, salt_rows, unpacked_codes
from dyadic.session import remove_path, scratch_path

ROW_BYTES = 32  # of a broadcast row beside its numbers


def salt_of(key: str) -> str:
    return f"__salt_{key}"


def within_budget(tables: Mapping[str, tuple[int | None, int]], budget: int = BROADCAST_BYTES) -> set[str]:
    """Which of the tables (name -> rows, numbers to a row) go out together:
    the smallest first, as long as their bytes fit."""
    out, used = set(), 0
    for name, (n, width) in sorted(tables.items(), key=lambda t: (t[1][0] is None, (t[1][0] or 0) * (ROW_BYTES + 8 * t[1][1]))):
        size = None if n is None else n * (ROW_BYTES + 8 * width)
        if size is None or used + size > budget:
            break
        used += size
        out.add(name)
    return out


@dataclass
class Lookups:
    """How the rows of one job reach the tables keyed by each of its keys."""
    small: set
    plans: dict[str, SaltPlan] = field(default_factory=dict)

    def salts(self) -> list[str]:
        """Salt columns that the rows have to keep."""
        return [salt_of(k) for k in self.plans]

    def attach(self, rows: DataFrame, key: str, table: DataFrame, cols: Mapping[str, str], how: str = "left") -> DataFrame:
        """Rows with the table's columns (source -> new name) of their key."""
        t = table.select(F.col(key), *[F.col(s).alias(d) for s, d in cols.items()])
        if key in self.small:
            return rows.join(F.broadcast(t), key, how)
        plan, salt = self.plans.get(key), salt_of(key)
        if plan is None or salt not in rows.columns:
            return rows.join(t, key, how)
        return rows.join(salt_params(t, plan, salt), [key, salt], how)

    def sums(self, rows: DataFrame, key: str, aggs: Mapping[str, Column]) -> DataFrame:
        """Per key the sums of ``aggs`` (name -> column)."""
        salt = salt_of(key)
        if key in self.small or salt not in rows.columns:
            return rows.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
        parts = rows.groupBy(key, salt).agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
        return parts.groupBy(key).agg(*[F.sum(n).alias(n) for n in aggs])

    def gram(self, rows: DataFrame, key: str, z: Sequence[Column], r: Column) -> DataFrame:
        """Per key: n, sum z z^T (upper triangle g_a_b) and sum z r (b_a)."""
        d = len(z)
        aggs = {"n": F.lit(1).cast("long")}
        aggs |= {f"g_{a}_{b}": z[a] * z[b] for a in range(d) for b in range(a, d)}
        aggs |= {f"b_{a}": z[a] * r for a in range(d)}
        return self.sums(rows, key, aggs)


def prepare(rows: DataFrame, tables: Mapping[str, tuple[int | None, int]], budget: int | None = None,
            salted: Sequence[str] = ()) -> tuple[DataFrame, Lookups]:
    """(rows with a salt column per key whose table is not broadcast, their
    lookups).  ``tables``: key -> (rows, numbers to a row) of all tables with
    that key; ``salted`` names keys to salt in any case (tests)."""
    small = within_budget(tables, BROADCAST_BYTES if budget is None else budget) - set(salted)
    looks = Lookups(small)
    for key in tables:
        if key not in small:
            plan = plan_salts(rows, key, row_partitions(rows.sparkSession))
            rows, looks.plans[key] = salt_rows(rows, plan, salt_of(key)), plan
    return rows, looks


ROWS_TO_BUCKET = 500_000
SPOTS_TO_BUCKET = 16


@dataclass
class Homes(Lookups):
    """Lookups of rows that lie bucketed by the spot of their key ``home``;
    ``edges``: per other large key its rows' (spot, number), at the key's spots."""
    home: str = ""
    buckets: int = 1
    edges: dict[str, DataFrame] = field(default_factory=dict)
    pinned: list = field(default_factory=list)

    def salts(self) -> list[str]:
        return [*super().salts(), "__home", "__at"]

    def spot(self, key: str) -> Column:
        return F.pmod(F.hash(key) + F.col(salt_of(key)), F.lit(self.buckets * SPOTS_TO_BUCKET)).cast("int")

    def at_spots(self, t: DataFrame, key: str, spot: str) -> DataFrame:
        """The table at its key's spots, a hot key's row at each of its own."""
        t = salt_params(t, self.plans[key], salt_of(key)).withColumn(spot, self.spot(key)).drop(salt_of(key))
        return t.repartition(self.buckets, spot).hint("shuffle_hash")

    def sent(self, key: str, t: DataFrame) -> DataFrame:
        """The table's columns for each row of its key: (spot, number, columns)."""
        j = self.edges[key].join(self.at_spots(t, key, "__away"), ["__away", key])
        return j.select("__home", "__at", *[c for c in t.columns if c != key]).repartition(self.buckets, "__home")

    def pin(self, key: str, table: DataFrame) -> None:
        """Keep what ``table`` has for the rows beside them, until another table
        of this key is pinned: later lookups of it send nothing."""
        if key in self.edges and not any(t is table for _, t, _ in self.pinned):
            held = bucketed(self.sent(key, table), "__home", self.buckets, "pinned")
            for old in [p for p in self.pinned if p[0] == key and p[1].columns == table.columns]:
                self.pinned.remove(old)
            self.pinned.append((key, table, held))

    def attach(self, rows: DataFrame, key: str, table: DataFrame, cols: Mapping[str, str], how: str = "left") -> DataFrame:
        if key in self.small or key not in self.plans:
            return super().attach(rows, key, table, cols, how)
        t = table.select(F.col(key), *[F.col(s).alias(d) for s, d in cols.items()])
        if key == self.home:
            return rows.join(self.at_spots(t, key, "__home"), ["__home", key], how)
        held = next((h.select("__home", "__at", *[F.col(s).alias(d) for s, d in cols.items()]) for _, own, h in self.pinned if own is table), None)
        return rows.join((self.sent(key, t) if held is None else held).hint("shuffle_hash"), ["__home", "__at"], how)

    def sums(self, rows: DataFrame, key: str, aggs: Mapping[str, Column], inputs: Mapping[str, Column] | None = None) -> DataFrame:
        """``inputs``: named columns that ``aggs`` are made of, if not those themselves."""
        if key in self.small or key not in self.plans:
            return super().sums(rows if inputs is None else rows.withColumns(dict(inputs)), key, aggs)
        if key == self.home:
            rows, spot = rows if inputs is None else rows.withColumns(dict(inputs)), "__home"
        else:
            sent = dict(aggs) if inputs is None else dict(inputs)
            rows = rows.select(self.spot(key).alias("__away"), key, *[c.alias(n) for n, c in sent.items()]).repartition(self.buckets, "__away")
            aggs, spot = ({n: F.col(n) for n in aggs} if inputs is None else aggs), "__away"
        parts = rows.groupBy(spot, key).agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
        if self.plans[key].hot is None:
            return parts.drop(spot)
        return parts.groupBy(key).agg(*[F.sum(n).alias(n) for n in aggs])

    def gram(self, rows: DataFrame, key: str, z: Sequence[Column], r: Column) -> DataFrame:
        d = len(z)
        x, y = [F.col(f"__z{a}") for a in range(d)], F.col("__zr")
        aggs = {"n": F.lit(1).cast("long")}
        aggs |= {f"g_{a}_{b}": x[a] * x[b] for a in range(d) for b in range(a, d)}
        aggs |= {f"b_{a}": x[a] * y for a in range(d)}
        return self.sums(rows, key, aggs, {**{f"__z{a}": c for a, c in enumerate(z)}, "__zr": r})


def bucketed(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """``df``, whose rows are partitioned by ``by`` into ``n`` already, as a table of
    ``n`` buckets in the checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    table = "dyadic_" + os.path.basename(path).replace("-", "_")
    df.write.bucketBy(n, by).option("path", path).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def _small_codes(rows: DataFrame, looks: Lookups) -> dict[str, int]:
    """Key columns of broadcast tables that hold codes (no negative values)
    -> values up to the largest."""
    keys = [k for k in looks.small if dict(rows.dtypes).get(k) in ("int", "bigint")]
    if not keys:
        return {}
    b = rows.agg(*[F.min(k).alias(f"lo{i}") for i, k in enumerate(keys)], *[F.max(k).alias(f"hi{i}") for i, k in enumerate(keys)]).first()
    return {k: (-1 if b[f"hi{i}"] is None else b[f"hi{i}"]) + 1 for i, k in enumerate(keys) if (b[f"lo{i}"] or 0) >= 0}


def settle(rows: DataFrame, looks: Lookups, tables: Mapping[str, tuple[int | None, int]]) -> tuple[DataFrame, Lookups]:
    """Prepared rows, written, and their lookups.  Unless all tables are
    broadcast the rows lie at the home of the key with the widest tables."""
    if not looks.plans:
        return cut(rows, spread=True), looks
    # rows and tables lie by spot alone: a join on (spot, key) may stay there
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    home = max(looks.plans, key=lambda k: (tables[k][1], tables[k][0] or 0))
    n = max(row_partitions(rows.sparkSession), -(-looks.plans[home].total // ROWS_TO_BUCKET))
    homes = Homes(looks.small, looks.plans, home, n)
    cols, kinds, cards = rows.columns, dict(rows.dtypes), _small_codes(rows, looks)
    packed = packable(cards)
    rows = rows.withColumn("__home", homes.spot(home))
    if packed:
        rows = rows.withColumn("__packed", packed_codes(packed, cards)).drop(*packed)
    rows = rows.repartition(n, "__home")
    if packed:
        rows = rows.withColumns(unpacked_codes(packed, cards, kinds)).select(*cols, "__home")
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    rows = bucketed(rows, "__home", n, "rows")
    for key in looks.plans:
        if key != home:
            away = rows.select(homes.spot(key).alias("__away"), key, "__home", "__at").repartition(n, "__away")
            homes.edges[key] = bucketed(away, "__away", n, "edges")
    return rows, homes


class Generations:
    """The rows of a fit, written anew when they change."""

    def __init__(self, spark, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The rows as a table of their own, ``by`` a column if given (a read of
        some of its values then reads only their files)."""
        path = scratch_path(self.spark, self.name)
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
        self.paths.append(path)
        while len(self.paths) > 2:  # the one before this is still read from, should a task run again
            remove_path(self.spark, self.paths.pop(0))
        return table_at(self.spark, path, df.schema)

    def close(self) -> None:
        while self.paths:
            remove_path(self.spark, self.paths.pop(0))
