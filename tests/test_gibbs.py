"""Gibbs samplers on planted data: posterior-mean predictions beat the
global-mean baseline; traces have the expected shape."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dyadic.operators.train_bpmf import fit_bpmf, wishart_draw
from dyadic.operators.train_bpmlr import fit_bpmlr, start_from_trace
from dyadic.plans.params import vec_table


def _planted_factors(spark, n=60, m=50, rows=1500, k=2, seed=3):
    rng = np.random.default_rng(seed)
    U, V = rng.normal(0, 1, (n, k)), rng.normal(0, 1, (m, k))
    u, i = rng.integers(0, n, rows), rng.integers(0, m, rows)
    y = 3.0 + np.sum(U[u] * V[i], axis=1) + rng.normal(0, 0.1, rows)
    pdf = pd.DataFrame({"l_orderkey": np.arange(rows, dtype="int64"), "l_linenumber": np.ones(rows, dtype="int32"),
                        "l_partkey": i.astype("int64"), "uid": u.astype("int64"), "iid": i.astype("int64"), "y": y})
    df = spark.createDataFrame(pdf)
    return df.filter(F.col("l_orderkey") % 5 != 0), df.filter(F.col("l_orderkey") % 5 == 0)


def test_bpmf_beats_global_mean(spark):
    train, test = _planted_factors(spark)
    mean = train.agg(F.avg("y")).first()[0]
    gm = test.agg(F.sqrt(F.avg((F.col("y") - F.lit(mean)) ** 2))).first()[0]
    U = vec_table(train.select("uid").union(test.select("uid")).distinct(), "uid", 11, 2, std=0.5)
    I = vec_table(train.select("iid").union(test.select("iid")).distinct(), "iid", 12, 2, std=0.5)
    res = fit_bpmf(train, test, U, I, max_epoch=4, stopping_threshold=-1.0, bounds=None)
    rm = [r["test_rmse"] for r in res.history.orderBy("iter").collect()]
    # the posterior mean averages every epoch from the first draw on, so it
    # lags the current draw; it must still beat the baseline and improve
    assert len(rm) == 4 and rm[-1] < gm and rm[-1] < rm[0]


def test_wishart_mean():
    rng = np.random.default_rng(0)
    W = np.array([[1.0, 0.3], [0.3, 0.5]])
    draws = np.mean([wishart_draw(W, 6.0, rng) for _ in range(4000)], axis=0)
    assert np.allclose(draws, 6.0 * W, rtol=0.08, atol=0.08)


def test_bpmlr_runs_and_traces(spark):
    rng = np.random.default_rng(9)
    n, m, rows = 40, 30, 800
    s, c = rng.normal(0, 1, n), rng.normal(0, 1, m)
    u, i = rng.integers(0, n, rows), rng.integers(0, m, rows)
    X = rng.normal(0, 1, (rows, 2))
    y = s[u] + c[i] + X @ np.array([0.8, -0.5]) + rng.normal(0, 0.1, rows)
    pdf = pd.DataFrame({"l_orderkey": np.arange(rows, dtype="int64"), "uid": u.astype("int64"),
                        "iid": i.astype("int64"), "x0": X[:, 0], "x1": X[:, 1], "y": y})
    df = spark.createDataFrame(pdf)
    train, test = df.filter(F.col("l_orderkey") % 4 != 0), df.filter(F.col("l_orderkey") % 4 == 0)
    gm = test.agg(F.sqrt(F.avg((F.col("y") - F.lit(train.agg(F.avg("y")).first()[0])) ** 2))).first()[0]
    res = fit_bpmlr(train, test, ["x0", "x1"], k=2, nsamples=4, burnin=2, thin=2, row_key=["l_orderkey"])
    h = res.history.orderBy("iter").collect()
    assert len(h) == 4 and h[-1]["test_rmse"] < 0.6 * gm
    params = {r["param"] for r in res.trace.select("param").distinct().collect()}
    assert params == {"P", "s", "c", "W", "alpha_G", "alpha_s", "mu_s", "alpha_c", "mu_c", "lambda_P", "mu_P", "lambda_W", "mu_W"}
    assert res.trace.select("sample").distinct().count() == 2
    assert res.pred.count() == test.count()
    # a fit that starts from the trace is near the end of the first one at once
    again = fit_bpmlr(train, test, ["x0", "x1"], k=2, nsamples=1, burnin=0, thin=1, start=start_from_trace(res.trace))
    assert again.history.first()["train_rmse"] < 2 * h[-1]["train_rmse"]


def test_bpmlr_shared_membership_and_simple_traces(spark):
    rng = np.random.default_rng(4)
    rows = 400
    X = rng.normal(0, 1, (rows, 2))
    pdf = pd.DataFrame({"uid": rng.integers(0, 9, rows), "iid": rng.integers(0, 7, rows), "x0": X[:, 0], "x1": X[:, 1],
                        "y": X @ np.array([1.0, -2.0]) + rng.normal(0, 0.1, rows)})
    df = spark.createDataFrame(pdf)
    for variant, want in (("np", {"p", "W", "alpha_G", "alpha_p", "mu_p", "lambda_W", "mu_W"}),
                          ("s", {"P", "s", "c", "W", "alpha_G", "alpha_s", "mu_s", "alpha_c", "mu_c", "lambda_P", "mu_P", "lambda_W", "mu_W"})):
        res = fit_bpmlr(df, df, ["x0", "x1"], k=2, nsamples=5, burnin=4, thin=1, variant=variant)
        assert {r["param"] for r in res.trace.select("param").distinct().collect()} == want
        lam = {(r["i"], r["j"]): r["value"] for r in res.trace.filter("param = 'lambda_W'").collect()}
        assert lam[0, 1] == lam[1, 0] == 0.0
        if variant == "np":  # the planted slope is p W, up to noise
            v = {(r["param"], r["i"], r["j"]): r["value"] for r in res.trace.collect()}
            slope = [sum(v["p", 0, l] * v["W", l, j] for l in range(2)) for j in range(2)]
            assert np.allclose(slope, [1.0, -2.0], atol=0.1)


def test_bpmf_keeps_every_probe_row(spark):
    train, test = _planted_factors(spark, rows=400)
    probe = test.union(test.limit(1)).union(test.limit(1).withColumn("uid", F.lit(10**12)))
    n = probe.count()
    U = vec_table(train.select("uid").distinct(), "uid", 11, 2, std=0.5)
    I = vec_table(train.select("iid").distinct(), "iid", 12, 2, std=0.5)
    for epochs in (1, 3):
        res = fit_bpmf(train, probe, U, I, max_epoch=epochs, stopping_threshold=-1.0)
        assert res.pred.count() == n
        cold = res.pred.filter("is_cold").select("uid").distinct().collect()
        assert 10**12 in [r[0] for r in cold]
