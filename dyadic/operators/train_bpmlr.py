"""Bayesian mixed-membership linear regression by Gibbs sampling (TR-8).

    y ~ N(s_u + c_i + P_u^T W x, 1 / alpha_G)

Variants: ``full``; ``s`` (simplified: means of the hyperparameters are drawn
around their prior, precisions of W are diagonal, that of P is held); ``nb``
(no biases); ``np`` (no biases, one membership vector shared by all users, with
a scalar mean and precision of its own).  One sweep draws, in order: s (per
user), c (per item), P (per user, k x k conditional), the rows W_l of W, then
alpha_G and the hyperparameters, those of W included.  A sample is ``thin``
sweeps.

The rows carry their residual e, their p and W x; the blocks s, c and P join
only their own table and write the rows anew.  All rows W_l come from one pass:
sum (p (x) x)(p (x) x)^T and sum (p (x) x) e hold the conditional of each W_l
given the others, so they are drawn one after the other on the driver, and the
sum of squares after them is known without another pass.  What W's change makes
of e and W x enters the next block's reading.  A sweep so has 7 passes, whatever
k is.

Every draw is a function of (seed, sweep, block, index): those per entity by
the counter RNG of the id, those on the driver by a
:class:`~dyadic.functions.draws.CounterRNG` per block.  Samples after burn-in go
to a long trace table ``(sample, param, i, j, value)`` with the hyperparameters;
a prediction is the running mean over them, kept per test row.  A fit can start
from given values, such as a saved trace's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.arrays import dot_k
from dyadic.functions.crng import crng_uniform
from dyadic.functions.draws import CounterRNG, stream_of
from dyadic.operators import stats
from dyadic.operators.iterate import cut
from dyadic.operators.keyed import Generations, Lookups, prepare, settle
from dyadic.session import scratch_path
from dyadic.operators.train_bpmf import _hyper, _moments_of, _normals, hyper_of_moments
from dyadic.operators.score import real_block


def _gauss(id_col, stream: int) -> F.Column:
    u1 = F.greatest(crng_uniform(id_col, F.lit(stream), F.lit(0)), F.lit(1e-300))
    u2 = crng_uniform(id_col, F.lit(stream), F.lit(1))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)


# blocks of a sweep's streams on the driver
START, SHARED_P, W_ROWS, NOISE, HYPER_S, HYPER_C, HYPER_P, HYPER_W = range(8)


def bias_conditional(rows: DataFrame, key: str, resid: F.Column, alpha_g: float, alpha: float,
                     mu: float, looks: Lookups | None = None) -> DataFrame:
    """Per entity: precision alpha + alpha_G n and mean
    (alpha mu + alpha_G sum resid) / precision (resid excludes this bias);
    ``seen``: rows whose resid is not null."""
    g = (looks or Lookups(set())).sums(rows, key, {"n": F.lit(1).cast("long"), "sr": resid, "seen": F.when(resid.isNotNull(), 1).otherwise(0)})
    prec = F.lit(alpha) + F.lit(alpha_g) * F.col("n")
    return g.select(key, "n", "seen", prec.alias("prec"),
                    ((F.lit(alpha * mu) + F.lit(alpha_g) * F.col("sr")) / prec).alias("mean"))


def membership_conditional(rows: DataFrame, key: str, z: list, resid: F.Column, alpha_g: float, lam: np.ndarray,
                           mu: np.ndarray, looks: Lookups | None = None) -> DataFrame:
    """Per entity: n, precision lam + alpha_G sum z z^T (``prec_a_b``) and
    the mean of its membership (``mean_a``), z = W x, resid = y - s - c."""
    k = len(z)
    g = (looks or Lookups(set())).gram(rows, key, z, resid)
    means = _solve_p(g.select(key), g, key, k, alpha_g, lam, mu)
    return g.join(means, key).select(
        key, "n", *[(F.lit(float(lam[a, b])) + alpha_g * F.col(f"g_{a}_{b}")).alias(f"prec_{a}_{b}") for a in range(k) for b in range(a, k)],
        *[F.col("vec")[a].alias(f"mean_{a}") for a in range(k)])


def weight_conditional(M: np.ndarray, W: np.ndarray, l: int, alpha_g: float, lam: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(precision, mean) of row l of W given the others; M: the moments of
    (p (x) x, e), profile by profile, e the residual under W."""
    r = W.shape[1]
    at = slice(l * r, (l + 1) * r)
    G = M[at, at]
    prec = lam + alpha_g * G
    return prec, np.linalg.solve(prec, lam @ mu + alpha_g * (M[at, -1] + G @ W[l]))


def move_row(M: np.ndarray, l: int, change: np.ndarray) -> None:
    """The moments after row l of W has changed."""
    r = len(change)
    at = slice(l * r, (l + 1) * r)
    d = M[:, at] @ change
    ee = M[-1, -1] - 2.0 * change @ M[at, -1] + change @ M[at, at] @ change
    M[:-1, -1] -= d[:-1]
    M[-1, :-1] = M[:-1, -1]
    M[-1, -1] = ee


@dataclass
class BPMLRResult:
    trace: DataFrame     # (sample, param, i, j, value)
    pred: DataFrame      # test rows with posterior-mean prediction
    history: DataFrame   # (iter, train_rmse, test_rmse)


def start_from_trace(trace: DataFrame, uid: str = "uid", iid: str = "iid") -> dict:
    """Starting values for :func:`fit_bpmlr` from the last sample of a trace."""
    last = trace.filter(F.col("sample") == trace.agg(F.max("sample")).first()[0])
    of = lambda name: last.filter(F.col("param") == name)
    out = {}
    for name, key in (("s", uid), ("c", iid)):
        if not of(name).isEmpty():
            out[name] = of(name).select(F.col("i").alias(key), F.col("value").alias("b"))
    if not of("P").isEmpty():
        vec = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"])
        out["P"] = of("P").groupBy(F.col("i").alias(uid)).agg(vec.alias("vec"))
    small = last.filter(F.col("param").isin("W", "p", "alpha_G")).orderBy("param", "i", "j").collect()
    out["alpha_G"] = next((r["value"] for r in small if r["param"] == "alpha_G"), 1.0)
    w = [r for r in small if r["param"] == "W"]
    out["W"] = np.zeros((1 + max(r["i"] for r in w), 1 + max(r["j"] for r in w)))
    for r in w:
        out["W"][r["i"], r["j"]] = r["value"]
    if any(r["param"] == "p" for r in small):
        out["p"] = np.array([r["value"] for r in small if r["param"] == "p"])
    return out


def _checked(start: dict, k: int, r: int, users: DataFrame, items: DataFrame, uid: str, iid: str) -> None:
    """Refuse starting values of another size or that lack ids."""
    if "W" in start and np.shape(start["W"]) != (k, r):
        raise ValueError(f"W is {np.shape(start['W'])}, not {(k, r)}")
    if "p" in start and np.shape(start["p"]) != (k,):
        raise ValueError(f"p has {np.size(start['p'])} values, not {k}")
    for name, ids, key in (("s", users, uid), ("c", items, iid), ("P", users, uid)):
        if name not in start:
            continue
        lacks = ids.join(start[name].select(key), key, "left_anti").count()
        if lacks:
            raise ValueError(f"{name} lacks {lacks} of the ids of {key}")
        if name == "P" and start[name].filter(F.size("vec") != k).limit(1).count():
            raise ValueError(f"P has rows that are not of length {k}")


def _spread(vecs: np.ndarray) -> np.ndarray | None:
    """Inverse covariance of the rows, None where it has not full rank."""
    if len(vecs) < 2:
        return None
    cov = np.atleast_2d(np.cov(vecs.T))
    return np.linalg.inv(cov) if np.linalg.matrix_rank(cov) == len(cov) else None


def fit_bpmlr(train: DataFrame, test: DataFrame, reals, uid="uid", iid="iid", target="y", k: int = 3,
              nsamples: int = 50, burnin: int = 5, thin: int = 2, variant: str = "full",
              seed: int = 1234, init_std: float = 0.1, a0: float = 1.0, b0: float = 1.0,
              row_key=(), start: dict | None = None, trace_path: str | None = None, salted=()):
    """``row_key``: columns of ``test`` to keep beside each prediction (they
    need not be unique).  ``start``: any of s, c (id, b), P (id, vec), W (k x r
    array), p, alpha_G; values of another size or without some id are an
    error, and the means and precisions start from the given values.
    ``trace_path``: folder for the trace, a scratch one if not given."""
    spark = train.sparkSession
    r = len(reals)
    start = start or {}
    rng = lambda sweep, block: CounterRNG(stream_of(seed, sweep, block))
    rows = train.select(uid, iid, F.col(target).cast("double").alias("__y"), *reals)
    keys = [x for x in dict.fromkeys([*row_key, uid, iid, target])]
    # rows are numbered once and the numbers stored with them
    probe = cut(test.select(*dict.fromkeys([*keys, *reals])).withColumn("__row", F.monotonically_increasing_id()))
    users = cut(rows.select(uid).union(test.select(uid)).distinct())
    items = cut(rows.select(iid).union(test.select(iid)).distinct())
    use_b, shared = variant not in ("nb", "np"), variant == "np"
    _checked(start, k, r, users, items, uid, iid)

    def begin(name, ids, key, col, default):
        if name not in start:
            return ids.select(key, default.alias(col))
        return cut(ids.join(start[name].select(key, col), key))

    s = begin("s", users, uid, "b", F.lit(0.0))
    c = begin("c", items, iid, "b", F.lit(0.0))
    P = begin("P", users, uid, "vec", F.array(*[F.lit(1.0 / k) for _ in range(k)]))
    p_shared = np.array(start["p"], dtype=float) if "p" in start else np.full(k, 1.0 / k)
    W = np.array(start["W"], dtype=float) if "W" in start else rng(0, START).normal(0.0, init_std, (k, r))
    alpha_g, h = start.get("alpha_G", 1.0), {"alpha_s": 1.0, "mu_s": 0.0, "alpha_c": 1.0, "mu_c": 0.0, "alpha_p": 1.0, "mu_p": 0.0}
    LamP, muP = np.eye(k), np.zeros(k)
    LamW, muW = np.eye(r), np.zeros(r)
    for name, tab in (("s", s), ("c", c)):  # means and precisions of what is given
        if name in start:
            a = tab.agg(F.avg("b").alias("m"), F.var_samp("b").alias("v")).first()
            h[f"mu_{name}"] = a["m"] or 0.0
            h[f"alpha_{name}"] = 1.0 / a["v"] if a["v"] else 1.0
    if "P" in start:
        mean, S = _moments_of(P, k)[1:]
        muP, LamP = mean, np.linalg.inv(S) if np.linalg.matrix_rank(S) == k else LamP
    if "W" in start:
        muW, LamW = W.mean(axis=0), LamW if _spread(W) is None else _spread(W)
    nu, ni = users.count(), items.count()
    tables = {} if shared else {uid: (nu, 2 * (k + 1))}
    if use_b:
        tables |= {uid: (nu, 2 * (k + 1)), iid: (ni, 2)}
    rows, looks = prepare(rows, tables, salted=salted)
    gens = Generations(spark, "bpmlr-rows")
    keep = [uid, iid, *reals, *looks.salts()]
    p, g, X = [f"__p{l}" for l in range(k)], [f"__g{l}" for l in range(k)], [F.col(x) for x in reals]
    homes = bool(looks.plans)
    if homes:
        rows, looks = settle(rows.select(*keep, "__y"), looks, tables)
        keep = [uid, iid, *reals, *looks.salts()]
    held = [] if shared else p

    def now_scored():
        """The rows under the present tables: residual, membership, W x."""
        f = rows
        if use_b:
            if homes:
                looks.pin(uid, s), looks.pin(iid, c)
            f = looks.attach(f, uid, s, {"b": "__s"}, "inner")
            f = looks.attach(f, iid, c, {"b": "__c"}, "inner")
        else:
            f = f.withColumns({"__s": F.lit(0.0), "__c": F.lit(0.0)})
        if homes:
            looks.pin(uid, P)
        f = f.withColumn("__p", F.array(*[F.lit(float(v)) for v in p_shared])) if shared else looks.attach(f, uid, P, {"vec": "__p"}, "inner")
        f = f.withColumn("__g", real_block(reals, W))
        return f.select(*keep, (F.col("__y") - F.col("__s") - F.col("__c") - dot_k("__p", "__g", k)).alias("__e"),
                        *[F.col("__p")[l].alias(p[l]) for l in range(len(held))], *[F.col("__g")[l].alias(g[l]) for l in range(k)])

    state = now_scored() if homes else gens.write(now_scored().hint("rebalance"))
    N = state.count()
    trace_path = trace_path or scratch_path(spark, "bpmlr-trace")
    acc, kept = None, 0
    hist = []

    def pv():
        return [F.lit(float(v)) for v in p_shared] if shared else [F.col(x) for x in p]

    def form(coef, cols):
        return sum((F.lit(float(a)) * x for a, x in zip(coef, cols, strict=True)), F.lit(0.0))

    e, G = F.col("__e"), [F.col(x) for x in g]

    def bias(ids, tab, key, name, stream):
        """New values of one side's biases, and how their change reaches the rows."""
        cond = bias_conditional(state, key, e, alpha_g, h[f"alpha_{name}"], h[f"mu_{name}"], looks)
        j = ids.join(cond, key, "left").join(tab.withColumnRenamed("b", "__old"), key)
        mean = F.col("mean") + F.lit(alpha_g) * F.col("seen") * F.col("__old") / F.col("prec")
        new = cut(j.select(key, (F.coalesce(mean, F.lit(h[f"mu_{name}"])) + _gauss(key, stream) /
                                 F.sqrt(F.coalesce("prec", F.lit(h[f"alpha_{name}"])))).alias("b"), "__old"))

        def far():
            j = looks.attach(state, key, new.withColumn("d", F.col("b") - F.col("__old")), {"d": "__d"}, "inner")
            return j.select(*keep, (e - F.col("__d")).alias("__e"), *held, *[x.alias(y) for x, y in zip(G, g, strict=True)])
        return new.select(key, "b"), far

    def moved(new):
        """Rows at home are scored anew in the next pass, which moves nothing;
        others are written as ``new`` makes them."""
        return (now_scored() if homes else gens.write(new())), F.col("__e"), [F.col(x) for x in g]

    for sweep in range(1, nsamples * thin + 1):
        st = seed * 100 + sweep * 10
        if use_b:
            s, far = bias(users, s, uid, "s", st)
            state, e, G = moved(far)
            c, far = bias(items, c, iid, "c", st + 1)
            state, e, G = moved(far)
        # P: per user k x k conditional (or one shared vector)
        now = pv()
        back = e + sum((now[l] * G[l] for l in range(k)), F.lit(0.0))
        if shared:
            M = stats.moment_matrix(state, [*G, back])
            cov = np.linalg.inv(LamP + alpha_g * M[:-1, :-1])
            mean = cov @ (LamP @ muP + alpha_g * M[:-1, -1])
            change = mean + np.linalg.cholesky(cov) @ rng(sweep, SHARED_P).standard_normal(k) - p_shared
            p_shared = p_shared + change
            e = e - form(change, G)
        else:
            gram = looks.gram(state, uid, G, back)
            new = _solve_p(users, gram, uid, k, alpha_g, LamP, muP, st + 2)
            both = cut(new.join(P.withColumnRenamed("vec", "__old"), uid))

            def far():
                j = looks.attach(state, uid, both.select(uid, *[(F.col("vec")[l] - F.col("__old")[l]).alias(f"d{l}") for l in range(k)]),  # noqa: B023
                                 {f"d{l}": f"__d{l}" for l in range(k)}, "inner")
                return j.select(*keep, (e - sum((F.col(f"__d{l}") * G[l] for l in range(k)), F.lit(0.0))).alias("__e"),  # noqa: B023
                                *[(F.col(p[l]) + F.col(f"__d{l}")).alias(p[l]) for l in range(k)],
                                *[x.alias(y) for x, y in zip(G, g, strict=True)])  # noqa: B023
            P = both.select(uid, "vec")
            state, e, G = moved(far)
        # the rows of W, one after the other, from one matrix of moments
        now = pv()
        M = stats.moment_matrix(state, [*[now[l] * x for l in range(k) for x in X], e])
        draws, old = rng(sweep, W_ROWS), W.copy()
        for l in range(k):
            prec, mean = weight_conditional(M, W, l, alpha_g, LamW, muW)
            row = mean + np.linalg.cholesky(np.linalg.inv(prec)) @ draws.standard_normal(r)
            move_row(M, l, row - W[l])
            W[l] = row
        if homes:
            state, e, G = now_scored(), F.col("__e"), [F.col(x) for x in g]
        elif shared:  # written, so that the next sweep reads plain columns
            e, G = e - sum((now[l] * form(W[l] - old[l], X) for l in range(k)), F.lit(0.0)), [G[l] + form(W[l] - old[l], X) for l in range(k)]
            state = gens.write(state.select(*keep, e.alias("__e"), *[x.alias(y) for x, y in zip(G, g, strict=True)]))
            e, G = F.col("__e"), [F.col(x) for x in g]
        else:
            e = e - sum((now[l] * form(W[l] - old[l], X) for l in range(k)), F.lit(0.0))
            G = [G[l] + form(W[l] - old[l], X) for l in range(k)]
        # observation precision and hyperparameters
        sse = float(M[-1, -1])
        alpha_g = rng(sweep, NOISE).gamma(a0 + N / 2.0, 1.0 / (b0 + sse / 2.0))
        simple = variant in ("s", "np")
        if use_b:
            h["alpha_s"], h["mu_s"] = _normal_gamma(s, rng(sweep, HYPER_S), at_prior=simple)
            h["alpha_c"], h["mu_c"] = _normal_gamma(c, rng(sweep, HYPER_C), at_prior=simple)
        if shared:
            h["alpha_p"], h["mu_p"] = normal_gamma(k, float(p_shared.mean()), float(k * p_shared.var()), rng(sweep, HYPER_P))
            LamP, muP = h["alpha_p"] * np.eye(k), np.full(k, h["mu_p"])
        elif variant == "s":  # the precision of P is held, its mean drawn around the prior
            muP = rng(sweep, HYPER_P).multivariate_normal(np.zeros(k), np.linalg.inv((2.0 + nu) * LamP))
        else:
            LamP, muP = _hyper(P, k, np.zeros(k), 2.0, float(k), np.eye(k), rng(sweep, HYPER_P))
        LamW, muW = hyper_of_moments(k, W.mean(axis=0), np.cov(W.T, bias=False).reshape(r, r) if k > 1 else np.zeros((r, r)),
                                     np.zeros(r), 2.0, float(r), np.eye(r), rng(sweep, HYPER_W), simple)
        if sweep % thin:
            continue
        t = sweep // thin
        train_rmse, test_rmse = float(np.sqrt(sse / N)), None
        if t > burnin:
            kept += 1
            scored = _score(probe if acc is None else acc, uid, iid, reals, s, c, P, W, use_b, variant, p_shared, k)
            so_far = F.lit(0.0) if acc is None else F.col("__sum")
            acc = cut(scored.withColumn("__sum", so_far + F.col("__pred")).select("__row", *dict.fromkeys([*keys, *reals]), "__sum"))
            scalars = {"alpha_G": alpha_g, **{n: v for n, v in h.items() if (n[-1] == "p") == shared and (use_b or n[-1] == "p")}}
            arrays = {"W": W, "lambda_W": LamW, "mu_W": muW}
            arrays |= {"p": p_shared} if shared else {"lambda_P": LamP, "mu_P": muP}
            # kept samples go straight to the trace table
            _trace_rows(spark, t, s, c, None if shared else P, uid, iid, use_b, scalars, arrays).write.mode("append") \
                .partitionBy("sample").parquet(trace_path)
            test_rmse = acc.agg(F.sqrt(F.avg((F.col(target) - F.col("__sum") / kept) ** 2))).first()[0]
        hist.append((t, train_rmse, test_rmse, None))
    gens.close()
    trace = (spark.read.parquet(trace_path).select("sample", "param", "i", "j", "value")
             if kept else None)
    pred = acc.select(*keys, (F.col("__sum") / kept).alias("pred")) if kept else None
    hf = spark.createDataFrame(hist, "iter int, train_rmse double, test_rmse double, objective double")
    return BPMLRResult(trace, pred, hf)


def _solve_p(users, gram, uid, k, alpha_g, LamP, muP, stream: int | None = None):
    """Membership of each user: a draw of its conditional, or without a
    ``stream`` its mean."""
    j = users.join(gram, uid, "left")
    lam = [float(x) for x in LamP.reshape(-1)]
    mu = [float(x) for x in muP]

    def solve(it):
        L0 = np.array(lam).reshape(k, k)
        m0 = np.array(mu)
        for pdf in it:
            n = len(pdf)
            G = np.zeros((n, k, k))
            for a in range(k):
                for b in range(a, k):
                    G[:, a, b] = G[:, b, a] = pdf[f"g_{a}_{b}"].fillna(0.0).to_numpy()
            bv = np.stack([pdf[f"b_{a}"].fillna(0.0).to_numpy() for a in range(k)], axis=1)
            cov = np.linalg.inv(L0[None] + alpha_g * G)
            vec = np.einsum("nab,nb->na", cov, alpha_g * bv + (L0 @ m0)[None])
            if stream is not None:
                vec = vec + np.einsum("nab,nb->na", np.linalg.cholesky(cov), _normals(pdf[uid].to_numpy(), stream, k))
            yield pd.DataFrame({uid: pdf[uid].to_numpy(), "vec": list(vec)})

    return j.mapInPandas(solve, f"`{uid}` {dict(j.dtypes)[uid]}, vec array<double>")


def _normal_gamma(tab: DataFrame, rng, at_prior: bool = False):
    g = tab.agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("m"),
                F.sum(F.col("b") * F.col("b")).alias("ss")).first()
    n, m, ss = g["n"], g["m"] or 0.0, g["ss"] or 0.0
    return normal_gamma(n, m, ss - n * m * m, rng, at_prior=at_prior)


def normal_gamma(n, m, sxx, rng, mu0=0.0, kappa0=1.0, a0=1.0, b0=1.0, at_prior: bool = False):
    """(precision, mean) given n values with mean m and squared deviations
    sxx; ``at_prior`` draws the mean around its prior instead."""
    kn = kappa0 + n
    an = a0 + n / 2.0
    bn = b0 + 0.5 * sxx + kappa0 * n * (m - mu0) ** 2 / (2 * kn)
    prec = rng.gamma(an, 1.0 / bn)
    if at_prior:
        return prec, rng.normal(mu0, 1.0 / np.sqrt(kappa0 * prec))
    return prec, rng.normal((kappa0 * mu0 + n * m) / kn, 1.0 / np.sqrt(kn * prec))


def _score(test, uid, iid, reals, s, c, P, W, use_b, variant, p_shared, k):
    j = test
    if use_b:
        j = (j.join(s.withColumnRenamed("b", "__s"), uid, "left")
              .join(c.withColumnRenamed("b", "__c"), iid, "left"))
    else:
        j = j.withColumns({"__s": F.lit(0.0), "__c": F.lit(0.0)})
    if variant == "np":
        j = j.withColumn("__p", F.array(*[F.lit(float(v)) for v in p_shared]))
    else:
        j = j.join(P.withColumnRenamed("vec", "__p"), uid, "left")
    pred = (F.coalesce("__s", F.lit(0.0)) + F.coalesce("__c", F.lit(0.0)) +
            F.coalesce(dot_k("__p", real_block(reals, W), k), F.lit(0.0)))
    return j.withColumn("__pred", pred)


def _trace_rows(spark, t, s, c, P, uid, iid, use_b, scalars: dict, arrays: dict):
    parts = []
    if P is not None:
        parts.append(P.select(F.lit(t).alias("sample"), F.lit("P").alias("param"), F.col(uid).cast("long").alias("i"),
                              F.posexplode("vec").alias("j", "value")).withColumn("j", F.col("j").cast("long")))
    if use_b:
        parts.append(s.select(F.lit(t).alias("sample"), F.lit("s").alias("param"), F.col(uid).cast("long").alias("i"),
                              F.lit(0).cast("long").alias("j"), F.col("b").alias("value")))
        parts.append(c.select(F.lit(t).alias("sample"), F.lit("c").alias("param"), F.col(iid).cast("long").alias("i"),
                              F.lit(0).cast("long").alias("j"), F.col("b").alias("value")))
    small = [(t, n, 0, 0, float(v)) for n, v in scalars.items()]
    for n, m in arrays.items():
        m = np.atleast_2d(m)
        small += [(t, n, i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    out = spark.createDataFrame(small, "sample int, param string, i long, j long, value double")
    for p in parts:
        out = out.unionByName(p)
    return out
