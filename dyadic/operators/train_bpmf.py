"""Bayesian PMF by Gibbs sampling (TR-2).

Per epoch: Normal-Wishart hyperparameters for each side are drawn on the
driver from the side's k-vector mean and k x k covariance (AG-7/AG-8, one
aggregate each); then each Gibbs sweep draws every item vector, then every
user vector, from

    Lambda = alpha + beta sum_{ratings} v v^T,
    mean   = Lambda^-1 (beta sum v r + alpha mu),      r = rating - global mean.

The sums are one grouped Gram per entity (AG-9, JVM sums, in two levels where
the partner's table is not broadcast); the k x k solve and the draw run in
numpy per Arrow batch (mapInPandas).  Every draw is a function of (seed, sweep,
block, index): vectors by the counter RNG of their id, hyperparameters by a
:class:`~dyadic.functions.draws.CounterRNG` of their side and epoch.  So a
redrawn task after an executor loss gives the same vectors, the result does not
depend on partitioning, and a whole run can be repeated in SQL.  Decisions: lower Cholesky factor
for the draw, bounds an argument, each side uses its own hyperparameters,
one running prediction average per epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.arrays import dot_k
from dyadic.functions.crng import crng_uniform_np
from dyadic.functions.draws import CounterRNG, stream_of
from dyadic.functions.scalar import clip
from dyadic.operators import stats
from dyadic.operators.epochs import Epochs
from dyadic.operators.iterate import History, cut
from dyadic.operators.keyed import Lookups, prepare
from dyadic.operators.train_pmf import save_factors


def _normals(ids: np.ndarray, stream: int, k: int) -> np.ndarray:
    """k standard normals per id from counter draws (Box-Muller)."""
    ids = np.asarray(ids, dtype=np.int64)
    u1 = np.stack([crng_uniform_np(ids, stream, 2 * l) for l in range(k)], axis=1)
    u2 = np.stack([crng_uniform_np(ids, stream, 2 * l + 1) for l in range(k)], axis=1)
    u1 = np.maximum(u1, 1e-300)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def conditional_moments(rows: DataFrame, key: str, other_key: str, other: DataFrame, k: int,
                        r: str = "__r", other_rows: int | None = None, looks: Lookups | None = None) -> DataFrame:
    """Per entity: n, sum v v^T (upper triangle g_a_b), sum v r (b_a) over its
    ratings, v the partner vectors (AG-9).  ``looks``: of prepared rows."""
    if looks is None:
        rows, looks = prepare(rows, {other_key: (other_rows, k)}) if other_rows is not None else (rows, Lookups(set()))
    j = looks.attach(rows, other_key, other, {"vec": "__v"}, "inner")
    return looks.gram(j, key, [F.col("__v")[l] for l in range(k)], F.col(r))


def _draw_side(ids: DataFrame, key: str, grams: DataFrame, k: int, alpha: np.ndarray,
               mu: np.ndarray, beta: float, stream: int, draw: bool = True) -> DataFrame:
    """New vectors for every id of a side (ids without ratings draw from the
    prior)."""
    j = ids.join(grams, key, "left")
    a_flat = [float(x) for x in alpha.reshape(-1)]
    mu_l = [float(x) for x in mu]

    def solve(it):
        A = np.array(a_flat).reshape(k, k)
        m = np.array(mu_l)
        for pdf in it:
            n = len(pdf)
            G = np.zeros((n, k, k))
            for a in range(k):
                for b in range(a, k):
                    col = pdf[f"g_{a}_{b}"].fillna(0.0).to_numpy()
                    G[:, a, b] = G[:, b, a] = col
            bv = np.stack([pdf[f"b_{a}"].fillna(0.0).to_numpy() for a in range(k)], axis=1)
            Lam = A[None] + beta * G
            cov = np.linalg.inv(Lam)
            mean = np.einsum("nab,nb->na", cov, beta * bv + (A @ m)[None])
            if draw:
                L = np.linalg.cholesky(cov)
                z = _normals(pdf[key].to_numpy(), stream, k)
                vec = mean + np.einsum("nab,nb->na", L, z)
            else:
                vec = mean
            yield pd.DataFrame({key: pdf[key].to_numpy(), "vec": list(vec)})

    return j.mapInPandas(solve, f"`{key}` {dict(j.dtypes)[key]}, vec array<double>")


def wishart_draw(W: np.ndarray, df: float, rng: np.random.Generator) -> np.ndarray:
    """Wishart(W, df) by the Bartlett decomposition (k x k, driver)."""
    k = W.shape[0]
    L = np.linalg.cholesky(W)
    A = np.zeros((k, k))
    for i in range(k):
        A[i, i] = np.sqrt(rng.chisquare(df - i))
        for j in range(i):
            A[i, j] = rng.standard_normal()
    LA = L @ A
    return LA @ LA.T


def _moments_of(vecs: DataFrame, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(number, mean, covariance) of the vectors of a table."""
    mom = stats.vector_moments(vecs, "vec", k).first()
    N = mom["n"]
    s = np.array([mom[f"s_{i}"] or 0.0 for i in range(k)])
    SS = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            SS[i, j] = SS[j, i] = mom[f"ss_{i}_{j}"] or 0.0
    return N, s / max(N, 1), (SS - np.outer(s, s) / max(N, 1)) / (N - 1) if N > 1 else np.zeros((k, k))


def _hyper(vecs: DataFrame, k: int, mu0, b0, df0, W0, rng):
    return hyper_of_moments(*_moments_of(vecs, k), mu0, b0, df0, W0, rng)


def hyper_of_moments(N, xbar, S, mu0, b0, df0, W0, rng, diagonal: bool = False):
    """(precision, mean) of N vectors with mean ``xbar`` and covariance ``S``
    from their Normal-Wishart posterior; ``diagonal`` keeps only the diagonal
    of the precision and draws the mean around its prior."""
    d = (mu0 - xbar).reshape(-1, 1)
    Wp = np.linalg.inv(np.linalg.inv(W0) + N * S + N * b0 * (d @ d.T) / (b0 + N))
    Wp = (Wp + Wp.T) / 2
    alpha = wishart_draw(Wp, df0 + N, rng)
    mu_tmp = (b0 * mu0 + N * xbar) / (b0 + N)
    if diagonal:
        alpha, mu_tmp = np.diag(np.diag(alpha)), mu0
    Lc = np.linalg.cholesky(np.linalg.inv((b0 + N) * alpha))
    return alpha, mu_tmp + Lc @ rng.standard_normal(len(mu0))


# blocks of an epoch's hyperparameter streams
ITEM_HYPER, USER_HYPER = 0, 1


@dataclass
class BPMFResult:
    U: DataFrame
    I: DataFrame
    pred: DataFrame      # probe rows with the running posterior-mean prediction
    history: DataFrame


def fit_bpmf(train: DataFrame, probe: DataFrame, U: DataFrame, I: DataFrame, uid="uid", iid="iid",
             target="y", max_epoch: int = 50, beta: float = 2.0, b0: float = 2.0,
             stopping_threshold: float = 1e-5, ngibbs: int = 2, seed: int = 1234,
             bounds=(0.0, 5.0), probe_key=("l_orderkey", "l_linenumber", "l_partkey"),
             resume_path: str | None = None, save_path: str | None = None, salted=()) -> BPMFResult:
    """U, I: starting (id, vec) tables, e.g. from :func:`fit_pmf`.  Every probe
    row keeps its own running mean (``probe_key`` need not be unique); a row
    whose user or item has no vector is predicted by the mean, ``is_cold``.
    ``resume_path``: each epoch is committed there and a later call goes on
    behind the last one.  ``save_path``: folder for the final factors."""
    spark = train.sparkSession
    k = len(U.select("vec").first()["vec"])
    mean = train.agg(F.avg(target)).first()[0]
    epochs = Epochs(spark, resume_path)
    done = epochs.last()
    rows = train.select(uid, iid, (F.col(target) - F.lit(mean)).alias("__r"))
    uids = cut(U.select(uid).union(rows.select(uid)).distinct())
    iids = cut(I.select(iid).union(rows.select(iid)).distinct())
    rows, looks = prepare(rows, {uid: (uids.count(), k), iid: (iids.count(), k)}, salted=salted)
    rows = cut(rows, spread=True)
    mu0, W0, df0 = np.zeros(k), np.eye(k), float(k)
    hist = History(stopping_threshold)
    if done:
        U, I, avg = done[2]["U"], done[2]["I"], done[2]["avg"]
        hist.rows = [tuple(r) for r in done[1]["history"]]
        probe = avg
    else:
        avg = None
        # rows are numbered once and the numbers stored with them
        probe = cut(probe.select(*probe_key, uid, iid, target).withColumn("__row", F.monotonically_increasing_id()))
    for epoch in range(done[0] if done else 0, max_epoch):
        a_i, m_i = _hyper(I, k, mu0, b0, df0, W0, CounterRNG(stream_of(seed, epoch, ITEM_HYPER)))
        a_u, m_u = _hyper(U, k, mu0, b0, df0, W0, CounterRNG(stream_of(seed, epoch, USER_HYPER)))
        for g in range(ngibbs):
            sweep = epoch * ngibbs + g
            gi = conditional_moments(rows, iid, uid, U, k, looks=looks)
            I = cut(_draw_side(iids, iid, gi, k, a_i, m_i, beta, seed * 1000 + 2 * sweep + 1))
            gu = conditional_moments(rows, uid, iid, I, k, looks=looks)
            U = cut(_draw_side(uids, uid, gu, k, a_u, m_u, beta, seed * 1000 + 2 * sweep))
        now = probe if avg is None else avg
        p = (now.join(U.select(uid, F.col("vec").alias("__u")), uid, "left")
                .join(I.select(iid, F.col("vec").alias("__i")), iid, "left"))
        cold = F.col("__u").isNull() | F.col("__i").isNull()
        new = F.when(cold, F.lit(float(mean))).otherwise(dot_k("__u", "__i", k) + F.lit(float(mean)))
        if bounds is not None:
            new = clip(new, *bounds)
        if avg is not None:
            t = float(epoch)
            new = (F.lit(t) * F.col("pred") + new) / (t + 1)
        avg = cut(p.select("__row", *probe_key, uid, iid, target, new.alias("pred"), cold.alias("is_cold")))
        rmse = avg.agg(F.sqrt(F.avg((F.col(target) - F.col("pred")) ** 2))).first()[0]
        stop = _stop(hist, epoch + 1, rmse)
        epochs.commit(epoch + 1, {"U": U, "I": I, "avg": avg}, {"history": hist.rows})
        if stop:
            break
    if save_path:
        save_factors(U, I, save_path, len(hist.rows))
    return BPMFResult(U, I, avg.drop("__row") if avg is not None else None, hist.frame(spark))


def _stop(hist: History, it: int, rmse: float) -> bool:
    prev = hist.rows[-1][2] if hist.rows else None
    hist.rows.append((it, None, rmse, None))
    return prev is not None and (prev - rmse) <= hist.eps
