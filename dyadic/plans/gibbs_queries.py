"""Registered Gibbs jobs (TR-2, TR-8): exact conditional moments and whole
sampled runs, both with SQL oracles (k = 2; the draws are replayable)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.functions.arrays import dot_k
from dyadic.operators import prep, stats
from dyadic.operators.score import real_block
from dyadic.operators.train_bpmf import _draw_side, conditional_moments, fit_bpmf
from dyadic.functions.draws import inverse_sql, select_sql, times_sql
from dyadic.operators.iterate import cut
from dyadic.operators.train_bpmlr import bias_conditional, fit_bpmlr, membership_conditional, weight_conditional
from dyadic.plans.common import r6, s6
from dyadic.plans.params import init_sql, scalar_table, vec_table
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import SPLIT_SQL, query
from dyadic.plans.gibbs_sql import bpmf_sql, bpmlr_sql, bpmlr_trace_sql, bpmlr_variants_sql
from dyadic.plans.score_queries import REALS, W_MLR, Z_SQL, ZCOLS, _wx

import numpy as np

BETA = 2.0


@query("bpmf_conditional", f"""WITH {SPLIT_SQL},
m AS (SELECT avg(y) AS mean FROM ds WHERE split = 'train'),
u AS (SELECT uid, {init_sql('uid', 11, 0)} AS u0, {init_sql('uid', 11, 1)} AS u1 FROM (SELECT DISTINCT uid FROM ds WHERE split = 'train')),
g AS (SELECT iid, count(*) AS n, sum(u0 * u0) AS g00, sum(u0 * u1) AS g01, sum(u1 * u1) AS g11,
             sum(u0 * (y - mean)) AS b0, sum(u1 * (y - mean)) AS b1
      FROM ds JOIN u USING (uid), m WHERE split = 'train' GROUP BY iid),
l AS (SELECT iid, n, 1.0 + {BETA} * g00 AS l00, {BETA} * g01 AS l01, 1.0 + {BETA} * g11 AS l11,
             {BETA} * b0 AS c0, {BETA} * b1 AS c1 FROM g)
SELECT iid, CAST(n AS BIGINT) AS n, {s6('l00')} AS lam_0_0, {s6('l01')} AS lam_0_1, {s6('l11')} AS lam_1_1,
       {s6('(l11 * c0 - l01 * c1) / (l00 * l11 - l01 * l01)')} AS mean_0,
       {s6('(l00 * c1 - l01 * c0) / (l00 * l11 - l01 * l01)')} AS mean_1 FROM l""")
def q_bpmf_cond(spark, sf):
    train, _ = hold_out(held_dyads(spark, sf))
    mean = stats.global_mean(train, "y")
    rows = train.select("uid", "iid", (F.col("y") - F.lit(mean)).alias("__r"))
    U = vec_table(train.select("uid").distinct(), "uid", 11, 2)
    g = conditional_moments(rows, "iid", "uid", U, 2)
    means = _draw_side(g.select("iid"), "iid", g, 2, np.eye(2), np.zeros(2), BETA, 0, draw=False)
    out = g.join(means, "iid")
    return out.select("iid", "n", r6(F.lit(1.0) + BETA * F.col("g_0_0")).alias("lam_0_0"),
                      r6(F.lit(BETA) * F.col("g_0_1")).alias("lam_0_1"),
                      r6(F.lit(1.0) + BETA * F.col("g_1_1")).alias("lam_1_1"),
                      r6(F.col("vec")[0]).alias("mean_0"), r6(F.col("vec")[1]).alias("mean_1"))


@query("fit_bpmf", bpmf_sql())
def q_fit_bpmf(spark, sf):
    """Two epochs of Gibbs from formula factors; posterior-mean probe RMSE."""
    d = held_dyads(spark, sf)
    train, test = hold_out(d)
    ids_u = d.select("uid").distinct()
    ids_i = d.select("iid").distinct()
    res = fit_bpmf(train, test, vec_table(ids_u, "uid", 11, 2, std=0.1), vec_table(ids_i, "iid", 12, 2, std=0.1),
                   max_epoch=2, stopping_threshold=-1.0)
    return res.history.select("iter", r6("test_rmse").alias("test_rmse"))


ALPHA_G, ALPHA_S, MU_S = 4.0, 1.0, 0.0


def _conditional_sql() -> str:
    """(block, id, n, i, j, prec, mean): precision (i <= j) and, beside its
    diagonal, mean of each block given all others; unit priors."""
    r, k = len(REALS), 2
    ix = [(l, j) for l in range(k) for j in range(r)]
    w = {(l, j): float(W_MLR[l, j]) for l, j in ix}

    def scalar(block, key, resid):
        return f"""SELECT '{block}' AS block, {key} AS id, CAST(n AS BIGINT) AS n, 0 AS i, 0 AS j, {s6(f'CAST({ALPHA_S} + {ALPHA_G} * n AS DOUBLE)')} AS prec,
  {s6(f'({ALPHA_S * MU_S} + {ALPHA_G} * sr) / ({ALPHA_S} + {ALPHA_G} * n)')} AS mean FROM (SELECT {key}, count(*) AS n, sum({resid}) AS sr FROM f GROUP BY {key})"""

    def vector(block, ident, source, G, rhs, d):
        out = []
        prec = [[f"({float(a == b)!r} + {ALPHA_G} * ({G(a, b)}))" for b in range(d)] for a in range(d)]
        mean = times_sql(inverse_sql(prec, "i", out), [f"({ALPHA_G} * ({rhs(a)}))" for a in range(d)], "m", out)
        rows = [f"SELECT '{block}' AS block, {ident} AS id, CAST(n AS BIGINT) AS n, {a} AS i, {b} AS j, {s6(prec[a][b])} AS prec, "
                f"{s6(mean[a]) if a == b else 'CAST(NULL AS DOUBLE)'} AS mean FROM q" for a in range(d) for b in range(a, d)]
        return f"SELECT * FROM (WITH q AS (SELECT * FROM {select_sql(out, source)}) {' UNION ALL '.join(rows)})"

    gram = lambda z, y: ", ".join([f"sum({z[a]} * {z[b]}) AS g_{a}_{b}" for a in range(len(z)) for b in range(a, len(z))]
                                  + [f"sum({z[a]} * ({y})) AS r_{a}" for a in range(len(z))] + ["count(*) AS n"])
    g2, r2_ = (lambda a, b: f"g_{min(a, b)}_{max(a, b)}"), (lambda a: f"r_{a}")
    flat = [f"p{l} * z{j}" for l, j in ix]
    parts = [scalar("s", "uid", "y - c - (p0 * g0 + p1 * g1)"), scalar("c", "iid", "y - s - (p0 * g0 + p1 * g1)"),
             vector("P", "uid", f"(SELECT uid, {gram(['g0', 'g1'], 'y - s - c')} FROM f GROUP BY uid)", g2, r2_, k)]
    for l in range(k):
        others = lambda a, l=l: f"r_{l * r + a}" + "".join(f" - {g2(l * r + a, m * r + j)} * ({w[m, j]!r})" for m, j in ix if m != l)
        parts.append(vector("W", str(l), f"(SELECT {gram(flat, 'y - s - c')} FROM f)", lambda a, b, l=l: g2(l * r + a, l * r + b), others, r))
    parts.append(vector("p", "0", f"(SELECT {gram(['g0', 'g1'], 'y')} FROM f)", g2, r2_, k))
    return f"""WITH {SPLIT_SQL}, {Z_SQL},
tu AS (SELECT DISTINCT uid FROM ds WHERE split = 'train'), ti AS (SELECT DISTINCT iid FROM ds WHERE split = 'train'),
s AS (SELECT uid, {init_sql('uid', 13, 0)} AS s, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1 FROM tu),
c AS (SELECT iid, {init_sql('iid', 14, 0)} AS c FROM ti),
z AS (SELECT ds.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM ds, st WHERE split = 'train'),
f AS MATERIALIZED (SELECT z.*, s, c, p0, p1, {_wx[0]} AS g0, {_wx[1]} AS g1 FROM z JOIN s ON z.uid = s.uid JOIN c ON z.iid = c.iid)
{' UNION ALL '.join(parts)}"""


@query("bpmlr_conditional", _conditional_sql())
def q_bpmlr_cond(spark, sf):
    """Conditionals of s, c, P and the rows of W given all other blocks, and of
    the shared membership of the model without biases."""
    k, r = 2, len(REALS)
    train, _ = hold_out(held_dyads(spark, sf))
    st = prep.fit_zscore(train, REALS)
    z = prep.apply_zscore(train, st, REALS)
    tu, ti = train.select("uid").distinct(), train.select("iid").distinct()
    f = (z.join(vec_table(tu, "uid", 15, k).withColumnRenamed("vec", "__p"), "uid")
          .join(scalar_table(tu, "uid", 13).withColumnRenamed("b", "__s"), "uid")
          .join(scalar_table(ti, "iid", 14).withColumnRenamed("b", "__c"), "iid")
          .withColumn("__reg", real_block(REALS, W_MLR)))
    f = cut(f.select("uid", "iid", "y", *REALS, "__s", "__c", "__p", "__reg"), spread=True)
    y, s, c, fit = F.col("y"), F.col("__s"), F.col("__c"), dot_k("__p", "__reg", k)
    g = [F.col("__reg")[l] for l in range(k)]
    lamP, muP = np.eye(k), np.zeros(k)

    def scalar(block, key, resid):
        d = bias_conditional(f, key, resid, ALPHA_G, ALPHA_S, MU_S)
        return d.select(F.lit(block).alias("block"), F.col(key).alias("id"), "n", F.lit(0).alias("i"), F.lit(0).alias("j"),
                        r6("prec").alias("prec"), r6("mean").alias("mean"))

    d = membership_conditional(f, "uid", g, y - s - c, ALPHA_G, lamP, muP)
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), r6(f"prec_{a}_{b}").alias("prec"),
                      (r6(f"mean_{a}") if a == b else F.lit(None).cast("double")).alias("mean")) for a in range(k) for b in range(a, k)]
    out = scalar("s", "uid", y - c - fit).unionByName(scalar("c", "iid", y - s - fit)).unionByName(
        d.select(F.lit("P").alias("block"), F.col("uid").alias("id"), "n", F.explode(F.array(*cells)).alias("x")).select("block", "id", "n", "x.*"))
    # W and the shared membership: one matrix of moments each, solved here
    px = [F.col("__p")[l] * F.col(x) for l in range(k) for x in REALS]
    M, n = stats.moment_matrix(f, [*px, y - s - c - fit]), f.count()
    small = []

    def put(block, ident, prec, mean):
        small.extend((block, ident, n, a, b, round(float(prec[a, b]), 6) + 0.0, round(float(mean[a]), 6) + 0.0 if a == b else None)
                     for a in range(len(mean)) for b in range(a, len(mean)))
    for l in range(k):
        put("W", l, *weight_conditional(M, W_MLR, l, ALPHA_G, np.eye(r), np.zeros(r)))
    M = stats.moment_matrix(f, [*g, y])
    prec = lamP + ALPHA_G * M[:-1, :-1]
    put("p", 0, prec, np.linalg.solve(prec, lamP @ muP + ALPHA_G * M[:-1, -1]))
    return out.unionByName(spark.createDataFrame(small, out.schema))


def _bpmlr_dyads(spark, sf):
    return held_dyads(spark, sf, "uid", "iid", "term", "y", *REALS)


def _bpmlr(d, variant):
    train, test = hold_out(d)
    st = prep.fit_zscore(train, REALS)
    train, test = prep.apply_zscore(train, st, REALS), prep.apply_zscore(test, st, REALS)
    res = fit_bpmlr(train, test, REALS, k=2, nsamples=3, burnin=1, thin=1, variant=variant)
    return res


@query("fit_bpmlr", bpmlr_sql())
def q_fit_bpmlr(spark, sf):
    res = _bpmlr(_bpmlr_dyads(spark, sf), "full")
    return res.history.select("iter", r6("train_rmse").alias("train_rmse"), r6("test_rmse").alias("test_rmse"))


@query("fit_bpmlr_variants", bpmlr_variants_sql())
def q_fit_bpmlr_variants(spark, sf):
    out, d = None, _bpmlr_dyads(spark, sf)
    for v in ("s", "nb", "np"):
        h = _bpmlr(d, v).history.select(F.lit(v).alias("variant"), "iter",
                                                r6("train_rmse").alias("train_rmse"),
                                                r6("test_rmse").alias("test_rmse"))
        out = h if out is None else out.unionByName(h)
    return out


@query("bpmlr_trace_stats", bpmlr_trace_sql())
def q_bpmlr_trace(spark, sf):
    res = _bpmlr(_bpmlr_dyads(spark, sf), "full")
    return stats.trace_stats(res.trace, groups=[("P", "profile"), ("W", "weights")]).select(
        "param", "sample", r6("norm").alias("norm"), r6("mean").alias("mean"), r6("std").alias("std"), "group")
