"""Training jobs against brute-force numpy runs of the same algorithm on the
small tables, plus invariants and planted-parameter recovery."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_init_np, crng_uniform_np
from dyadic.operators import prep
from dyadic.operators.encode import encode
from dyadic.operators.train_fm import fit_fm_als, init_fm_model
from dyadic.operators.train_pmf import fit_pmf
from dyadic.operators.train_profile import fit_profile_cd, fit_profile_gd, init_profile_model
from dyadic.plans.common import row_draw
from dyadic.sources.tables import DYAD_GUIDE, dyads


# ---------------------------------------------------------------- PMF
def _pmf_numpy(tr: pd.DataFrame, te: pd.DataFrame, nf, eps, lam, mom, epochs, nb, std, seed):
    mean = tr.y.mean()
    uids = np.union1d(tr.uid.unique(), te.uid.unique())
    iids = np.union1d(tr.iid.unique(), te.iid.unique())
    U = {u: np.array([crng_init_np(u, seed, l, std) for l in range(nf)]) for u in uids}
    I = {i: np.array([crng_init_np(i, seed + 1, l, std) for l in range(nf)]) for i in iids}
    incU = {u: np.zeros(nf) for u in uids}
    incI = {i: np.zeros(nf) for i in iids}
    r = tr.y.to_numpy() - mean
    out = []
    for ep in range(epochs):
        b = np.floor(crng_uniform_np(tr.l_orderkey, ep, tr.l_partkey * 8 + tr.l_linenumber) * nb).astype(int)
        for batch in range(nb):
            idx = np.where(b == batch)[0]
            n = len(idx)
            if n == 0:
                continue
            gu = {u: np.zeros(nf) for u in uids}
            gi = {i: np.zeros(nf) for i in iids}
            for t in idx:
                u, i = tr.uid.iat[t], tr.iid.iat[t]
                e = U[u] @ I[i] - r[t]
                gu[u] += 2 * e * I[i] + lam * U[u]
                gi[i] += 2 * e * U[u] + lam * I[i]
            for u in uids:
                incU[u] = mom * incU[u] + eps / n * gu[u]
            for i in iids:
                incI[i] = mom * incI[i] + eps / n * gi[i]
            for u in uids:
                U[u] = U[u] - incU[u]
            for i in iids:
                I[i] = I[i] - incI[i]
        e = np.array([U[u] @ I[i] for u, i in zip(tr.uid, tr.iid)]) - r
        reg = np.array([U[u] @ U[u] + I[i] @ I[i] for u, i in zip(tr.uid, tr.iid)])
        out.append(np.sqrt(np.mean(e * e + 0.5 * lam * reg)))
    return out


def test_pmf_matches_numpy(spark, sf):
    d = dyads(spark, sf)
    train, test = prep.temporal_holdout(d)
    kw = dict(epsilon=50.0, lambda_=0.01, momentum=0.8, max_epoch=2, nbatches=3, nf=3, init_std=0.1, seed=71)
    res = fit_pmf(train, test, row_draw=row_draw(), **kw)
    got = [r["train_rmse"] for r in res.history.orderBy("iter").collect()]
    cols = ["uid", "iid", "y", "l_orderkey", "l_partkey", "l_linenumber"]
    want = _pmf_numpy(train.select(*cols).toPandas(), test.select(*cols).toPandas(), 3, 50.0, 0.01, 0.8,
                      2, 3, 0.1, 71)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


# ---------------------------------------------------------------- IPR gradient
def _ipr_numpy(pdf, cards, k, std, seed, lr, lam_w, lam_b, iters, reals, cats):
    n = len(pdf)
    bu = np.array([crng_init_np(c, seed, 0, std) for c in range(cards["uid"])])
    bi = np.array([crng_init_np(c, seed + 1, 0, std) for c in range(cards["iid"])])
    P = np.array([[crng_init_np(c, seed + 10, l, std) for l in range(k)] for c in range(cards["uid"])])
    Wc = {f: np.array([[crng_init_np(c, seed + 20 + i, l, std) for l in range(k)] for c in range(cards[f])])
          for i, f in enumerate(cats)}
    Wr = np.array([[crng_init_np(j, seed + 40, l, std) for j in range(len(reals))] for l in range(k)])
    w0 = 0.0
    u, it_, y = pdf.uid.to_numpy(), pdf.iid.to_numpy(), pdf.y.to_numpy()
    X = pdf[reals].to_numpy()
    hist = []
    step = 2 * lr
    for t in range(iters + 1):
        reg = X @ Wr.T + sum(Wc[f][pdf[f].to_numpy()] for f in cats)
        pred = w0 + bu[u] + bi[it_] + np.sum(P[u] * reg, axis=1)
        e = pred - y
        hist.append(np.sqrt(np.mean(e * e)))
        if t == iters:
            break

        def avg_by(codes, vals, size):
            s = np.zeros((size,) + vals.shape[1:])
            c = np.zeros(size)
            np.add.at(s, codes, vals)
            np.add.at(c, codes, 1)
            return s, c

        g0 = e.mean()
        gWr = (e[:, None, None] * P[u][:, :, None] * X[:, None, :]).mean(axis=0)
        su, cu = avg_by(u, e, cards["uid"])
        si, ci = avg_by(it_, e, cards["iid"])
        sp, cp = avg_by(u, e[:, None] * reg, cards["uid"])
        new_bu = np.where(cu > 0, bu - step * (su / np.maximum(cu, 1) + lam_b * bu), bu)
        new_bi = np.where(ci > 0, bi - step * (si / np.maximum(ci, 1) + lam_b * bi), bi)
        new_P = np.where(cp[:, None] > 0, P - step * (sp / np.maximum(cp, 1)[:, None] + lam_w * P), P)
        new_Wc = {}
        for f in cats:
            sw, cw = avg_by(pdf[f].to_numpy(), e[:, None] * P[u], cards[f])
            new_Wc[f] = np.where(cw[:, None] > 0, Wc[f] - step * (sw / np.maximum(cw, 1)[:, None] + lam_w * Wc[f]), Wc[f])
        w0 = w0 - step * g0
        Wr = Wr - step * (gWr + lam_w * Wr)
        bu, bi, P, Wc = new_bu, new_bi, new_P, new_Wc
    return hist


def _encoded_train(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    return enc, enc.frame.filter(F.col("split") == "train")


def test_ipr_gradient_matches_numpy(spark, sf):
    enc, tr = _encoded_train(spark, sf)
    ids = {f: enc.codes(f) for f in DYAD_GUIDE.fields}
    reals, cats = list(DYAD_GUIDE.reals), list(DYAD_GUIDE.cats)
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", cats, reals, std=0.1, seed=100, sizes=enc.cards)
    _, h = fit_profile_gd(tr, m0, lrate=0.05, lambda_w=0.01, lambda_b=0.02, iters=2, eps=-1.0)
    got = [r["train_rmse"] for r in h.orderBy("iter").collect()]
    want = _ipr_numpy(tr.toPandas(), enc.cards, 2, 0.1, 100, 0.05, 0.01, 0.02, 2, reals, cats)
    assert np.allclose(got, want, rtol=1e-9)


# ---------------------------------------------------------------- closed form
def test_ipr_cd_objective_non_increasing(spark, sf):
    enc, tr = _encoded_train(spark, sf)
    ids = {f: enc.codes(f) for f in DYAD_GUIDE.fields}
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", list(DYAD_GUIDE.cats), list(DYAD_GUIDE.reals),
                            std=0.1, sizes=enc.cards)
    _, h = fit_profile_cd(tr, m0, lambda_w=1.0, lambda_b=1.0, sweeps=2, eps=-1.0, track_objective=True)
    obj = [r["objective"] for r in h.orderBy("iter").collect()]
    assert all(b <= a + 1e-9 for a, b in zip(obj, obj[1:]))


def _planted(spark, n=40, m=30, rows=900, k=2, noise=0.05, seed=5):
    rng = np.random.default_rng(seed)
    s, c = rng.normal(0, 1, n), rng.normal(0, 1, m)
    P = np.abs(rng.normal(0, 1, (n, k)))
    W = rng.normal(0, 1, (k, 2))
    u, i = rng.integers(0, n, rows), rng.integers(0, m, rows)
    X = rng.normal(0, 1, (rows, 2))
    y = 2.0 + s[u] + c[i] + np.sum(P[u] * (X @ W.T), axis=1) + rng.normal(0, noise, rows)
    pdf = pd.DataFrame({"uid": u.astype("int64"), "iid": i.astype("int64"), "x0": X[:, 0], "x1": X[:, 1], "y": y})
    return spark.createDataFrame(pdf)


def test_planted_mlr_als_beats_global_mean(spark):
    df = _planted(spark)
    ids = {"uid": df.select("uid").distinct(), "iid": df.select("iid").distinct()}
    mean = df.agg(F.avg("y")).first()[0]
    gm = df.agg(F.sqrt(F.avg((F.col("y") - F.lit(mean)) ** 2))).first()[0]
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", [], ["x0", "x1"], std=0.5, w0=mean, learn_w0=False)
    _, h = fit_profile_cd(df, m0, lambda_w=0.1, lambda_b=0.1, sweeps=4, eps=-1.0)
    rm = [r["train_rmse"] for r in h.orderBy("iter").collect()]
    assert rm[-1] < 0.5 * gm


def test_planted_fm_beats_global_mean(spark):
    df = _planted(spark)
    ids = {"uid": df.select("uid").distinct(), "iid": df.select("iid").distinct()}
    mean = df.agg(F.avg("y")).first()[0]
    gm = df.agg(F.sqrt(F.avg((F.col("y") - F.lit(mean)) ** 2))).first()[0]
    m0 = init_fm_model(ids, 2, ["uid", "iid"], ["x0", "x1"], init_std=0.1)
    _, h = fit_fm_als(df, m0, iters=3, threshold=-1.0, lambda_w=0.1, lambda_v=0.1)
    rm = [r["train_rmse"] for r in h.orderBy("iter").collect()]
    assert rm[-1] < 0.7 * gm
    assert all(b <= a + 1e-9 for a, b in zip(rm, rm[1:]))


def test_salted_entity_lookups_give_same_fit(spark, sf):
    """Salting hot users for the P lookups changes the plan, not the result."""
    enc, tr = _encoded_train(spark, sf)
    ids = {f: enc.codes(f) for f in DYAD_GUIDE.fields}
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", list(DYAD_GUIDE.cats), list(DYAD_GUIDE.reals),
                            std=0.1, sizes=enc.cards)
    _, a = fit_profile_gd(tr, m0, lrate=0.05, iters=2, eps=-1.0, salt_entities=False)
    mb, b = fit_profile_gd(tr, m0, lrate=0.05, iters=2, eps=-1.0, salt_entities=True)
    assert mb.salt is not None
    ra = [r["train_rmse"] for r in a.orderBy("iter").collect()]
    rb = [r["train_rmse"] for r in b.orderBy("iter").collect()]
    assert np.allclose(ra, rb, rtol=1e-12)
    _, c = fit_profile_cd(tr, m0, lambda_w=1.0, lambda_b=1.0, sweeps=1, eps=-1.0, salt_entities=True)
    _, d = fit_profile_cd(tr, m0, lambda_w=1.0, lambda_b=1.0, sweeps=1, eps=-1.0, salt_entities=False)
    assert np.allclose([r["train_rmse"] for r in c.orderBy("iter").collect()],
                       [r["train_rmse"] for r in d.orderBy("iter").collect()], rtol=1e-12)


def test_plan_salts_splits_a_third_of_rows(spark):
    from dyadic.operators.joins import plan_salts, salt_rows
    rows = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("u"), F.col("id").alias("v"))
    plan = plan_salts(rows, "u", 8)
    assert set(plan.salts) == {0} and plan.salts[0] >= 3
    per_salt = salt_rows(rows, plan).filter(F.col("u") == 0).groupBy("__salt").count().collect()
    assert len(per_salt) == plan.salts[0] and max(r["count"] for r in per_salt) < 10000 * 0.5


def test_gradient_batches_make_more_steps_a_pass(spark):
    df = _planted(spark)
    ids = {"uid": df.select("uid").distinct(), "iid": df.select("iid").distinct()}
    mean = df.agg(F.avg("y")).first()[0]
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", [], ["x0", "x1"], std=0.5, w0=mean, learn_w0=False)
    last = {}
    for batches in (1, 4):
        _, h = fit_profile_gd(df, m0, lrate=0.1, lambda_w=0.0, iters=2, eps=-1e9, nbatches=batches)
        rm = [r["train_rmse"] for r in h.orderBy("iter").collect()]
        assert len(rm) == 3 and rm[-1] < rm[0]
        last[batches] = rm[0] - rm[-1]
    assert last[4] > 2 * last[1]
