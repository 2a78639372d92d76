"""Projections, filters and set operations (PRJ-1/2/8, FLT-1/2, SE-1/2/3, SO-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_uniform


def feature_columns(df: DataFrame, keys: Sequence[str], target: str) -> list[str]:
    """All columns but the keys and the target, in table order (PRJ-2)."""
    drop = set(keys) | {target}
    return [c for c in df.columns if c not in drop]


def design_projection(df: DataFrame, uid: str, iid: str, target: str,
                      features: Sequence[str] | None = None,
                      keep: Sequence[str] = ()) -> DataFrame:
    """Split rows into (uid, iid, target, x array<double>) (PRJ-1)."""
    feats = list(features) if features is not None else feature_columns(df, [uid, iid, *keep], target)
    return df.select(*keep, F.col(uid), F.col(iid), F.col(target).cast("double").alias(target),
                     F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))


def max_term(df: DataFrame, term: str = "term"):
    """The last term: one aggregate reading only the term column (a scalar
    reaches the driver, nothing sized by the data)."""
    return df.agg(F.max(term)).first()[0]


def temporal_holdout(df: DataFrame, term: str = "term", last=None,
                     date_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """train = term < max(term), test = term == max(term) (FLT-1).

    The maximum becomes a literal, so the filters reach the scan and prune
    partitions of a table stored by term.  When the term is the calendar
    year of ``date_col``, the same split is also stated as a date range,
    which Parquet can skip row groups on (a predicate on year(date) cannot
    be pushed)."""
    last = max_term(df, term) if last is None else last
    train, test = F.col(term) < F.lit(last), F.col(term) == F.lit(last)
    if date_col is not None:
        start = F.make_timestamp_ntz(F.lit(int(last)), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        end = F.make_timestamp_ntz(F.lit(int(last) + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        train = train & (F.col(date_col) < start)
        test = test & (F.col(date_col) >= start) & (F.col(date_col) < end)
    return df.filter(train), df.filter(test)


def with_split(df: DataFrame, term: str = "term", last=None) -> DataFrame:
    """Label rows 'train' / 'test' by the temporal hold-out in one pass."""
    last = max_term(df, term) if last is None else last
    return df.withColumn("split", F.when(F.col(term) == F.lit(last), F.lit("test"))
                                  .otherwise(F.lit("train")))


def observed_mask(df: DataFrame, target: str, positive_only: bool = False) -> DataFrame:
    """Rows present are observed; optionally only ratings > 0 (FLT-2)."""
    return df.filter(F.col(target) > 0) if positive_only else df.filter(F.col(target).isNotNull())


def fit_zscore(train: DataFrame, reals: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per real, fitted on train: one aggregate,
    two scalars per feature on the driver."""
    aggs = []
    for r in reals:
        aggs += [F.avg(r).alias(f"m{len(aggs)}"), F.stddev_pop(r).alias(f"s{len(aggs)}")]
    row = train.agg(*aggs).first()
    return {r: (row[2 * i], row[2 * i + 1]) for i, r in enumerate(reals)}


def apply_zscore(df: DataFrame, stats: dict, reals: Sequence[str]) -> DataFrame:
    """(x - mean) / std, std 0 keeps scale 1 (PRJ-8)."""
    def scaled(r):
        m, s = stats[r]
        return (F.col(r) - F.lit(float(m))) / F.lit(float(s) if s else 1.0)
    return df.withColumns({r: scaled(r) for r in reals})


def zscore(train: DataFrame, test: DataFrame, reals: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    st = fit_zscore(train, reals)
    return apply_zscore(train, st, reals), apply_zscore(test, st, reals)


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack train and test with a ``split`` label (SE-1)."""
    return (train.withColumn("split", F.lit("train"))
                 .unionByName(test.withColumn("split", F.lit("test"))))


def union_ids(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Distinct ids of train and test (SE-2)."""
    return train.select(col).union(test.select(col)).distinct()


def append_terms(frames: Sequence[DataFrame]) -> DataFrame:
    """Accumulate per-term dyad frames (SE-3)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def minibatch_column(id_col, draw_col, epoch: int, nbatches: int) -> Column:
    """Batch number of a row in an epoch from a counter draw (SO-3): no sort,
    no shuffle; each epoch reshuffles because the stream is the epoch."""
    return F.floor(crng_uniform(id_col, F.lit(epoch), draw_col) * nbatches).cast("int")
