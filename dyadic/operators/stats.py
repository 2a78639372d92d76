"""Aggregates and the sum kernels every fit is built from (AG-1..14).

Every kernel is a sum, so Spark's map-side partial aggregation collapses a
hot key inside each task before the shuffle: a key holding a third of the
rows costs one partial row per task, not a third of the data in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_uniform


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def global_mean(df: DataFrame, target: str) -> float:
    """Mean response (AG-1): one scalar."""
    return df.agg(F.avg(target)).first()[0]


def rmse_expr(y, yhat) -> Column:
    d = _c(y) - _c(yhat)
    return F.sqrt(F.avg(d * d))


def residuals(df: DataFrame, y: str, yhat: str, name: str = "resid") -> DataFrame:
    return df.withColumn(name, F.col(y) - F.col(yhat))


def rmse(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """sqrt(mean((y - yhat)^2)), optionally per group (AG-2)."""
    g = df.groupBy(*by) if by else df
    return g.agg(rmse_expr(y, yhat).alias("rmse"), F.count(F.lit(1)).cast("long").alias("n"))


def baseline_predictions(test: DataFrame, train_mean: float, id_col, draw_col,
                         lo: float = 0.0, hi: float = 4.0, seed: int = 1234) -> DataFrame:
    """Add GM (train mean) and UR (uniform on [lo, hi] from the counter RNG)
    predictions (AG-3)."""
    u = crng_uniform(id_col, F.lit(seed), draw_col)
    return test.withColumns({
        "pred_gm": F.lit(float(train_mean)),
        "pred_ur": F.lit(float(lo)) + u * float(hi - lo)})


def entity_counts(df: DataFrame, entity: str) -> DataFrame:
    """Observations per entity (AG-4)."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).cast("long").alias("n"))


def level_counts(df: DataFrame, who: str, level: str) -> DataFrame:
    """Picks per (who, level) (AG-5)."""
    return df.groupBy(who, level).agg(F.count(F.lit(1)).cast("long").alias("count"))


def field_cardinality(df: DataFrame, fields: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """Distinct values per field and running offsets (AG-6):
    [(field, n_values, start, end)].  One aggregate for all fields; the
    offsets are a loop over the (few) fields on the driver."""
    row = df.agg(*[F.countDistinct(f).alias(f"n{i}") for i, f in enumerate(fields)]).first()
    out, start = [], 0
    for i, f in enumerate(fields):
        n = int(row[i])
        out.append((f, n, start, start + n))
        start += n
    return out


def vector_moments(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """n, sum x_i and sum x_i x_j (i <= j) of an array column in one pass;
    partial sums per task, a single row out."""
    x = [F.element_at(vec, i + 1).cast("double") for i in range(dim)]
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(x[i]).alias(f"s_{i}") for i in range(dim)]
    aggs += [F.sum(x[i] * x[j]).alias(f"ss_{i}_{j}") for i in range(dim) for j in range(i, dim)]
    return df.agg(*aggs)


def covariance_matrix(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Sample covariance (ddof=1) as a long (i, j, cov) frame (AG-7).  Each
    task sums x and x x^T of its batches (one matrix product each); the
    partial (n, sum, Gram) cells are added by (i, j), dim^2 rows a task.
    Vectors that are null, hold a null
    or are of another length take no part."""
    import numpy as np
    import pyarrow as pa

    whole = df.filter((F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())).select(F.col(vec).cast("array<double>").alias(vec))
    # sums around one of the vectors keep their digits where means are large
    first = whole.first()
    around = np.zeros(dim) if first is None else np.array(first[0])

    def partial(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - around
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        i, j = np.meshgrid(np.arange(dim, dtype=np.int64), np.arange(dim, dtype=np.int64), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(np.full(dim * dim, float(n))), pa.array(np.repeat(s, dim)),
             pa.array(np.tile(s, dim)), pa.array(g.ravel())], names=["i", "j", "n", "si", "sj", "sij"])

    cells = whole.mapInArrow(partial, "i long, j long, n double, si double, sj double, sij double").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    return cells.select("i", "j", ((F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def moment_matrix(df: DataFrame, cols: Sequence[Column]):
    """sum x x^T over all rows of the vector x of ``cols``, as a numpy array
    (bounded by the number of columns): each task multiplies its batches, the
    partial cells are added by (i, j).  Rows with a null take no part."""
    import numpy as np
    import pyarrow as pa
    d = len(cols)

    def partial(batches):
        g = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                g += x @ x.T
        i, j = np.meshgrid(np.arange(d, dtype=np.int64), np.arange(d, dtype=np.int64), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())], names=["i", "j", "x"])

    x = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    out = np.zeros((d, d))
    for r in x.mapInArrow(partial, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def vector_mean(df: DataFrame, vec: str) -> DataFrame:
    """Component-wise mean (AG-8): (pos, mean)."""
    return (df.select(F.posexplode(vec).alias("pos", "x"))
              .groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
              .select(F.col("pos").cast("long").alias("pos"), "mean"))


def entity_gram(df: DataFrame, entity: str, z: str, r: str, dim: int) -> DataFrame:
    """Per entity: sum z z^T (upper triangle) and sum z r (AG-9).  The core
    kernel of every alternating / Gibbs step: k(k+1)/2 + k + 1 JVM sums."""
    zz = [F.element_at(z, i + 1) for i in range(dim)]
    aggs = [F.count(F.lit(1)).cast("long").alias("n")]
    aggs += [F.sum(zz[a] * zz[b]).alias(f"g_{a}_{b}") for a in range(dim) for b in range(a, dim)]
    aggs += [F.sum(zz[a] * F.col(r)).alias(f"b_{a}") for a in range(dim)]
    return df.groupBy(entity).agg(*aggs)


def global_gram(df: DataFrame, x: str, y: str, dim: int) -> DataFrame:
    """X^T X (upper triangle) and X^T y over all rows (AG-10), one row."""
    xx = [F.element_at(x, i + 1) for i in range(dim)]
    aggs = [F.count(F.lit(1)).cast("long").alias("n")]
    aggs += [F.sum(xx[a] * xx[b]).alias(f"g_{a}_{b}") for a in range(dim) for b in range(a, dim)]
    aggs += [F.sum(xx[a] * F.col(y)).alias(f"b_{a}") for a in range(dim)]
    return df.agg(*aggs)


def gram_to_numpy(row, dim: int):
    """Rebuild the symmetric k x k matrix and k-vector from one gram row."""
    import numpy as np
    G = np.zeros((dim, dim))
    for a in range(dim):
        for b in range(a, dim):
            G[a, b] = G[b, a] = row[f"g_{a}_{b}"] or 0.0
    bvec = np.array([row[f"b_{a}"] or 0.0 for a in range(dim)])
    return G, bvec


def feature_sufficient_stats(df: DataFrame, field: str, value, err) -> DataFrame:
    """Per code of one field: sum v^2 and sum e v (AG-11); all codes of the
    field in one pass."""
    v, e = _c(value), _c(err)
    return df.groupBy(field).agg(F.sum(v * v).alias("sum_vv"), F.sum(e * v).alias("sum_ev"),
                                 F.count(F.lit(1)).cast("long").alias("n"))


def all_feature_stats(df: DataFrame, values: dict, err) -> DataFrame:
    """(field, code, sum_vv, sum_ev, n) of every field in one scan and one
    shuffle (AG-11); ``values``: field of integer codes -> value column."""
    from dyadic.operators.iterate import group_sums
    e = _c(err)
    g = group_sums(df, [(f, f, [_c(v) * _c(v), e * _c(v)]) for f, v in values.items()])
    return g.select(F.col("set").alias("field"), F.col("key").alias("code"), F.col("v0").alias("sum_vv"), F.col("v1").alias("sum_ev"), "n")


def term_quality_points(dyads: DataFrame, spine: DataFrame, sid: str = "sid",
                        term: str = "term", grade: str = "grade",
                        hours: str = "hours") -> DataFrame:
    """Per (student, term): quality points sum(grade * hours) and hours; a
    student of the spine without dyads in a term gets 0 (AG-12)."""
    agg = dyads.groupBy(sid, term).agg(F.sum(F.col(grade) * F.col(hours)).alias("qpts"),
                                       F.sum(hours).alias("term_hours"))
    return (spine.join(agg, [sid, term], "left")
                 .select(sid, term, F.coalesce("qpts", F.lit(0.0)).alias("qpts"),
                         F.coalesce("term_hours", F.lit(0.0)).alias("term_hours")))


def trace_stats(trace: DataFrame, groups: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Per (param, sample): Frobenius norm, mean, population std; optional
    label from the first substring in ``groups`` found in the name (AG-13)."""
    out = trace.groupBy("param", "sample").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if groups:
        lab = None
        for sub, name in groups:
            cond = F.col("param").contains(sub)
            lab = F.when(cond, F.lit(name)) if lab is None else lab.when(cond, F.lit(name))
        out = out.withColumn("group", lab.otherwise(F.col("param")))
    return out


def running_prediction_mean(draws: DataFrame, key: Sequence[str], t: str = "sample",
                            pred: str = "pred") -> DataFrame:
    """Posterior-mean prediction over stored draws (AG-14):
    the incremental (t avg + new) / (t + 1) equals the plain mean."""
    return draws.groupBy(*key).agg(F.avg(pred).alias("pred_mean"),
                                   F.count(F.lit(1)).cast("long").alias("ndraws"))
