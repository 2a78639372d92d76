"""Registered training-job queries and the queries over their outputs
(TR-1, SNK-2/3, SRC-1..4, AG-13/14, JN-4, RS-3 on traces)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from dyadic.operators import stats
from dyadic.operators.train_pmf import fit_pmf, pmf_predict
from dyadic.plans.common import cnt, r6, row_draw, s6
from dyadic.plans.params import init_sql
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import SPLIT_SQL, query
from dyadic.session import scratch_path
from dyadic.sources.tables import ROW_KEY

# Fixed settings of the registered PMF run: 2 epochs, one batch, rank 2.
PMF = dict(epsilon=50.0, lambda_=0.01, momentum=0.8, max_epoch=2, nbatches=1, nf=2,
           init_std=0.1, seed=71)


def _pmf_sql_states(epochs: int = 2) -> str:
    e, lam, mu, std, seed = PMF["epsilon"], PMF["lambda_"], PMF["momentum"], PMF["init_std"], PMF["seed"]
    parts = [f"""{SPLIT_SQL},
m AS (SELECT avg(y) AS mean FROM ds WHERE split = 'train'),
r AS (SELECT uid, iid, y - mean AS r FROM ds, m WHERE split = 'train'),
nn AS (SELECT count(*) AS n FROM r),
u0 AS (SELECT uid, {init_sql('uid', seed, 0, std)} AS a0, {init_sql('uid', seed, 1, std)} AS a1, 0.0 AS c0, 0.0 AS c1
       FROM (SELECT DISTINCT uid FROM ds)),
i0 AS (SELECT iid, {init_sql('iid', seed + 1, 0, std)} AS a0, {init_sql('iid', seed + 1, 1, std)} AS a1, 0.0 AS c0, 0.0 AS c1
       FROM (SELECT DISTINCT iid FROM ds))"""]
    for t in range(1, epochs + 1):
        p = t - 1
        parts.append(f"""e{t} AS (SELECT r.uid, r.iid, u.a0 * i.a0 + u.a1 * i.a1 - r.r AS e,
              u.a0 AS ua0, u.a1 AS ua1, i.a0 AS ia0, i.a1 AS ia1
       FROM r JOIN u{p} u ON r.uid = u.uid JOIN i{p} i ON r.iid = i.iid),
gu{t} AS (SELECT uid, sum(2.0 * e * ia0 + {lam} * ua0) AS g0, sum(2.0 * e * ia1 + {lam} * ua1) AS g1 FROM e{t} GROUP BY uid),
gi{t} AS (SELECT iid, sum(2.0 * e * ua0 + {lam} * ia0) AS g0, sum(2.0 * e * ua1 + {lam} * ia1) AS g1 FROM e{t} GROUP BY iid),
ux{t} AS (SELECT u.uid, u.a0, u.a1, {mu} * u.c0 + ({e} / n) * COALESCE(g.g0, 0.0) AS c0,
                 {mu} * u.c1 + ({e} / n) * COALESCE(g.g1, 0.0) AS c1 FROM u{p} u LEFT JOIN gu{t} g ON u.uid = g.uid, nn),
u{t} AS (SELECT uid, a0 - c0 AS a0, a1 - c1 AS a1, c0, c1 FROM ux{t}),
ix{t} AS (SELECT i.iid, i.a0, i.a1, {mu} * i.c0 + ({e} / n) * COALESCE(g.g0, 0.0) AS c0,
                 {mu} * i.c1 + ({e} / n) * COALESCE(g.g1, 0.0) AS c1 FROM i{p} i LEFT JOIN gi{t} g ON i.iid = g.iid, nn),
i{t} AS (SELECT iid, a0 - c0 AS a0, a1 - c1 AS a1, c0, c1 FROM ix{t}),
h{t} AS (SELECT {t} AS epoch,
   (SELECT sqrt(avg((u.a0 * i.a0 + u.a1 * i.a1 - r.r) * (u.a0 * i.a0 + u.a1 * i.a1 - r.r)
      + {0.5 * lam} * ((u.a0 * u.a0 + u.a1 * u.a1) + (i.a0 * i.a0 + i.a1 * i.a1))))
    FROM r JOIN u{t} u ON r.uid = u.uid JOIN i{t} i ON r.iid = i.iid) AS train_rmse,
   (SELECT sqrt(avg((y - LEAST(5.0, GREATEST(0.0, u.a0 * i.a0 + u.a1 * i.a1 + mean)))
                  * (y - LEAST(5.0, GREATEST(0.0, u.a0 * i.a0 + u.a1 * i.a1 + mean)))))
    FROM ds JOIN u{t} u ON ds.uid = u.uid JOIN i{t} i ON ds.iid = i.iid, m WHERE split = 'test') AS test_rmse)""")
    return ",\n".join(parts)


def _run_pmf(spark, sf, **kw):
    train, test = hold_out(held_dyads(spark, sf))
    return fit_pmf(train, test, row_draw=row_draw(), **{**PMF, **kw})


@query("fit_pmf", f"""WITH {_pmf_sql_states()}
SELECT CAST(epoch AS INTEGER) AS iter, {s6('train_rmse')} AS train_rmse, {s6('test_rmse')} AS test_rmse
FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""")
def q_fit_pmf(spark, sf):
    res = _run_pmf(spark, sf)
    return res.history.select("iter", r6("train_rmse").alias("train_rmse"), r6("test_rmse").alias("test_rmse"))


def _factor_sums_sql(t):
    return f"""SELECT 'w_u' AS side, CAST({t} AS INTEGER) AS epoch, CAST(count(*) AS BIGINT) AS n,
       {s6('sum(a0 + a1)')} AS sum_v, {s6('sum(a0 * a0 + a1 * a1)')} AS sumsq_v FROM u{t}
UNION ALL SELECT 'w_i', {t}, count(*), {s6('sum(a0 + a1)')}, {s6('sum(a0 * a0 + a1 * a1)')} FROM i{t}"""


def _vec_sums(df, side, epoch_col=None):
    e = F.col(epoch_col).cast("int") if epoch_col else F.lit(PMF["max_epoch"])
    g = df.groupBy(e.alias("epoch")) if epoch_col else df.groupBy(F.lit(PMF["max_epoch"]).alias("epoch"))
    return g.agg(cnt().alias("n"), r6(F.sum(F.col("vec")[0] + F.col("vec")[1])).alias("sum_v"),
                 r6(F.sum(F.col("vec")[0] * F.col("vec")[0] + F.col("vec")[1] * F.col("vec")[1])).alias("sumsq_v")
                 ).select(F.lit(side).alias("side"), F.col("epoch").cast("int").alias("epoch"), "n", "sum_v", "sumsq_v")


@query("pmf_factors", f"WITH {_pmf_sql_states()}\n{_factor_sums_sql(2)}")
def q_pmf_factors(spark, sf):
    res = _run_pmf(spark, sf)
    return _vec_sums(res.U, "w_u").unionByName(_vec_sums(res.I, "w_i"))


@query("factor_checkpoint", f"WITH {_pmf_sql_states()}\n{_factor_sums_sql(1)}\nUNION ALL {_factor_sums_sql(2)}")
def q_factor_ckpt(spark, sf):
    path = scratch_path(spark, "pmf-factors")
    _run_pmf(spark, sf, checkpoint_every=1, checkpoint_path=path)
    u = spark.read.parquet(os.path.join(path, "w_u"))
    i = spark.read.parquet(os.path.join(path, "w_i"))
    return _vec_sums(u, "w_u", "epoch").unionByName(_vec_sums(i, "w_i", "epoch"))


# ---------------------------------------------------------------- traces
def _trace_frame(spark, sf):
    """Long trace (sample, param, i, j, value) of the checkpointed factors."""
    path = scratch_path(spark, "pmf-trace")
    _run_pmf(spark, sf, checkpoint_every=1, checkpoint_path=path)
    parts = []
    for side in ("w_u", "w_i"):
        f = spark.read.parquet(os.path.join(path, side))
        parts.append(f.select(F.col("epoch").cast("int").alias("sample"), F.lit(side).alias("param"),
                              F.col("id").cast("long").alias("i"),
                              F.posexplode("vec").alias("j", "value"))
                      .withColumn("j", F.col("j").cast("long")))
    return parts[0].unionByName(parts[1])


def _trace_sql():
    parts = []
    for t in (1, 2):
        for side, tab, key in (("w_u", "u", "uid"), ("w_i", "i", "iid")):
            for j in (0, 1):
                parts.append(f"SELECT {t} AS sample, '{side}' AS param, {key} AS i, {j} AS j, a{j} AS value FROM {tab}{t}")
    return "tr AS (" + "\nUNION ALL ".join(parts) + ")"


_TRACE_STATS_SQL = f"""WITH {_pmf_sql_states()}, {_trace_sql()},
ts AS (SELECT param, CAST(sample AS INTEGER) AS sample, sqrt(sum(value * value)) AS norm, avg(value) AS mean,
              stddev_pop(value) AS std FROM tr GROUP BY param, sample)"""


@query("trace_stats", _TRACE_STATS_SQL + f"""
SELECT param, sample, {s6('norm')} AS norm, {s6('mean')} AS mean, {s6('std')} AS std,
       CASE WHEN contains(param, '_u') THEN 'user' WHEN contains(param, '_i') THEN 'item' ELSE param END AS "group"
FROM ts""")
def q_trace_stats(spark, sf):
    ts = stats.trace_stats(_trace_frame(spark, sf), groups=[("_u", "user"), ("_i", "item")])
    return ts.select("param", "sample", *[r6(c).alias(c) for c in ("norm", "mean", "std")], "group")


@query("merge_stats", _TRACE_STATS_SQL + f""",
a AS (SELECT param AS rvar, sample, norm FROM ts),
b AS (SELECT param AS rvar, sample, mean, std FROM ts WHERE sample > 1)
SELECT a.rvar, a.sample, {s6('a.norm')} AS norm, {s6('b.mean')} AS mean, {s6('b.std')} AS std
FROM a LEFT JOIN b ON a.rvar = b.rvar AND a.sample = b.sample""")
def q_merge_stats(spark, sf):
    ts = stats.trace_stats(_trace_frame(spark, sf))
    a = ts.select(F.col("param").alias("rvar"), "sample", "norm")
    b = ts.filter(F.col("sample") > 1).select(F.col("param").alias("rvar"), "sample", "mean", "std")
    m = a.join(b, ["rvar", "sample"], "left")
    return m.select("rvar", "sample", *[r6(c).alias(c) for c in ("norm", "mean", "std")])


@query("unpivot_trace_stats", _TRACE_STATS_SQL + f"""
SELECT param, sample, stat, {s6('value')} AS value FROM (
  SELECT param, sample, 'norm' AS stat, norm AS value FROM ts
  UNION ALL SELECT param, sample, 'mean', mean FROM ts UNION ALL SELECT param, sample, 'std', std FROM ts)""")
def q_unpivot_trace(spark, sf):
    from dyadic.operators.reshape import unpivot_stats
    ts = stats.trace_stats(_trace_frame(spark, sf))
    return unpivot_stats(ts, ["param", "sample"], ["norm", "mean", "std"], "stat", "value").withColumn(
        "value", r6("value"))


@query("running_prediction_mean", f"""WITH {_pmf_sql_states()},
tt AS (SELECT unnest([1, 2]) AS t),
pr AS (SELECT tt.t, ds.*, LEAST(5.0, GREATEST(0.0, COALESCE(u.a0 * i.a0 + u.a1 * i.a1, 0.0) + mean)) AS pred
       FROM ds CROSS JOIN tt
       LEFT JOIN (SELECT 1 AS t, * FROM u1 UNION ALL SELECT 2, * FROM u2) u ON ds.uid = u.uid AND u.t = tt.t
       LEFT JOIN (SELECT 1 AS t, * FROM i1 UNION ALL SELECT 2, * FROM i2) i ON ds.iid = i.iid AND i.t = tt.t, m
       WHERE split = 'test')
SELECT {', '.join(ROW_KEY)}, {s6('avg(pred)')} AS pred_mean, CAST(count(*) AS BIGINT) AS ndraws
FROM pr GROUP BY {', '.join(ROW_KEY)}""")
def q_running_mean(spark, sf):
    path = scratch_path(spark, "pmf-draws")
    train, test = hold_out(held_dyads(spark, sf, *ROW_KEY, "uid", "iid", "term", "y"))
    res = fit_pmf(train, test, row_draw=row_draw(), checkpoint_every=1, checkpoint_path=path, **PMF)
    u = spark.read.parquet(os.path.join(path, "w_u")).withColumnRenamed("id", "uid")
    i = spark.read.parquet(os.path.join(path, "w_i")).withColumnRenamed("id", "iid")
    draws = None
    for t in range(1, PMF["max_epoch"] + 1):
        p = pmf_predict(test, u.filter(F.col("epoch") == t), i.filter(F.col("epoch") == t), res.mean)
        p = p.select(*ROW_KEY, F.lit(t).alias("sample"), "pred")
        draws = p if draws is None else draws.unionByName(p)
    out = stats.running_prediction_mean(draws, list(ROW_KEY))
    return out.withColumn("pred_mean", r6("pred_mean"))
