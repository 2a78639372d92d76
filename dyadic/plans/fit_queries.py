"""Registered fits of the profile models and the FM (TR-3..7, TR-9).

These are iterative optimisations: the driver checks them rows-only; the
unit tests compare them with a brute-force numpy run of the same algorithm
on the small tables and check the invariants (objective non-increasing for
the closed-form fits, RMSE below the global mean baseline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators import prep, stats
from dyadic.operators.encode import encode
from dyadic.operators.iterate import cut
from dyadic.operators.train_fm import fit_fm_als, init_fm_model
from dyadic.operators.train_profile import fit_profile_cd, fit_profile_gd, init_profile_model
from dyadic.plans.common import r6
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import query
from dyadic.sources.tables import DYAD_GUIDE, dyads

K = 2
REALS = list(DYAD_GUIDE.reals)


def _enc(spark, sf):
    return encode(dyads(spark, sf), DYAD_GUIDE)


def _ids(enc):
    return {f: enc.codes(f) for f in DYAD_GUIDE.fields}


def _finish(hist, model, test, target="y"):
    """History rows plus the hold-out RMSE of the final model on the last row."""
    te = model.predict(test).agg(F.sqrt(F.avg((F.col(target) - F.col("pred")) ** 2))).first()[0]
    last = hist.agg(F.max("iter")).first()[0]
    return hist.select("iter", r6("train_rmse").alias("train_rmse"),
                       F.when(F.col("iter") == last, r6(F.lit(te))).alias("test_rmse"),
                       r6("objective").alias("objective"))


def _ipr(spark, sf):
    enc = _enc(spark, sf)
    m0 = init_profile_model(_ids(enc), K, list(DYAD_GUIDE.ents), "uid", list(DYAD_GUIDE.cats), REALS,
                            std=1 / 16, sizes=enc.cards)
    tr = enc.frame.filter(F.col("split") == "train")
    te = enc.frame.filter(F.col("split") == "test")
    return m0, tr, te


@query("fit_ipr_gd")
def q_fit_ipr_gd(spark, sf):
    m0, tr, te = _ipr(spark, sf)
    m, h = fit_profile_gd(tr, m0, lrate=0.05, lambda_w=0.01, lambda_b=0.0, iters=2, eps=1e-4)
    return _finish(h, m, te)


@query("fit_ipr_gd_nonneg")
def q_fit_ipr_gd_nn(spark, sf):
    m0, tr, te = _ipr(spark, sf)
    m, h = fit_profile_gd(tr, m0, lrate=0.05, lambda_w=0.01, iters=2, eps=1e-4, nonneg=True)
    return _finish(h, m, te)


@query("fit_ipr_cd")
def q_fit_ipr_cd(spark, sf):
    m0, tr, te = _ipr(spark, sf)
    m, h = fit_profile_cd(tr, m0, lambda_w=1.0, lambda_b=1.0, sweeps=1, track_objective=True)
    return _finish(h, m, te)


def _mlr(spark, sf):
    d = held_dyads(spark, sf, "uid", "iid", "term", "y", *REALS)
    train, test = hold_out(d)
    st = prep.fit_zscore(train, REALS)
    train, test = prep.apply_zscore(train, st, REALS), prep.apply_zscore(test, st, REALS)
    ids = {e: cut(train.select(e).union(test.select(e)).distinct()) for e in ("uid", "iid")}
    mean = stats.global_mean(train, "y")
    m0 = init_profile_model(ids, K, ["uid", "iid"], "uid", [], REALS, std=0.01, w0=mean, learn_w0=False)
    return m0, train, test


@query("fit_mlr_gd")
def q_fit_mlr_gd(spark, sf):
    m0, tr, te = _mlr(spark, sf)
    m, h = fit_profile_gd(tr, m0, lrate=0.05, lambda_w=0.01, lambda_b=0.01, iters=2, eps=0.0, norm="fro")
    return _finish(h, m, te)


@query("fit_mlr_gd_l1_nonneg")
def q_fit_mlr_gd_l1(spark, sf):
    m0, tr, te = _mlr(spark, sf)
    m, h = fit_profile_gd(tr, m0, lrate=0.05, lambda_w=0.01, lambda_b=0.01, iters=2, eps=0.0,
                          norm="l1", nonneg=True)
    return _finish(h, m, te)


@query("fit_mlr_als")
def q_fit_mlr_als(spark, sf):
    m0, tr, te = _mlr(spark, sf)
    m, h = fit_profile_cd(tr, m0, lambda_w=1.0, lambda_b=1.0, sweeps=1, track_objective=True)
    return _finish(h, m, te)


@query("fit_fm_als")
def q_fit_fm(spark, sf):
    enc = _enc(spark, sf)
    m0 = init_fm_model(_ids(enc), K, list(DYAD_GUIDE.fields), REALS, init_std=0.1, sizes=enc.cards)
    tr = enc.frame.filter(F.col("split") == "train")
    te = enc.frame.filter(F.col("split") == "test")
    m, h = fit_fm_als(tr, m0, iters=1, lambda_w=1.0, lambda_v=1.0)
    return _finish(h, m, te)


@query("fit_report")
def q_fit_report(spark, sf):
    """Early stop: a large eps ends the gradient fit once the gain drops."""
    m0, tr, te = _ipr(spark, sf)
    m, h = fit_profile_gd(tr, m0, lrate=0.05, iters=6, eps=0.3)
    return _finish(h, m, te)


# ---------------------------------------------------------------- SQL-k oracle of the MLR gradient fit
MLR_GD = dict(lrate=0.05, lambda_w=0.01, lambda_b=0.01, iters=2, std=0.01, seed=100)


def _history_select(iters: int, eps: float) -> str:
    """Rows 0..T where T is the first iteration whose RMSE gain falls below
    eps (the early-stop rule), hold-out RMSE at T."""
    from dyadic.plans.common import s6
    hs = " UNION ALL ".join(f"SELECT {t} AS iter, (SELECT rmse FROM h{t}) AS rmse, (SELECT rmse FROM te{t}) AS te"
                            for t in range(iters + 1))
    stop = ("(SELECT %d AS T)" % iters if eps == float("-inf") else
            f"(SELECT COALESCE(min(b.iter), {iters}) AS T FROM hs a JOIN hs b ON b.iter = a.iter + 1 "
            f"WHERE a.rmse - b.rmse < {eps!r})")
    return f""",
hs AS ({hs}),
stop AS {stop}
SELECT CAST(iter AS INTEGER) AS iter, {s6('rmse')} AS train_rmse,
       CASE WHEN iter = (SELECT T FROM stop) THEN {s6('te')} END AS test_rmse,
       CAST(NULL AS DOUBLE) AS objective
FROM hs WHERE iter <= (SELECT T FROM stop)"""


def _mlr_gd_sql(norm: str = "fro", nonneg: bool = False, eps: float = float("-inf")) -> str:
    from dyadic.functions.crng import crng_init_np
    from dyadic.plans.common import s6
    from dyadic.plans.params import init_sql
    from dyadic.plans.registry import SPLIT_SQL
    from dyadic.plans.score_queries import Z_SQL, ZCOLS
    lr, lw, lb, iters, std, seed = (MLR_GD[x] for x in ("lrate", "lambda_w", "lambda_b", "iters", "std", "seed"))
    step = 2.0 * lr
    r = len(REALS)
    pen = (lambda x: f"sign({x})") if norm == "l1" else (lambda x: x)
    nn = (lambda x: f"GREATEST(0.0, {x})") if nonneg else (lambda x: x)
    W0 = [[crng_init_np(j, seed + 40, l, std) for j in range(r)] for l in range(K)]
    wcols = [f"w_{l}_{j}" for l in range(K) for j in range(r)]
    parts = [f"""{SPLIT_SQL}, {Z_SQL},
m AS (SELECT avg(y) AS w0 FROM ds WHERE split = 'train'),
z AS (SELECT split, uid, iid, y, {', '.join(f'{zc} AS z{j}' for j, zc in enumerate(ZCOLS))} FROM ds, st),
s0 AS (SELECT uid, {init_sql('uid', seed, 0, std)} AS b FROM (SELECT DISTINCT uid FROM ds)),
c0 AS (SELECT iid, {init_sql('iid', seed + 1, 0, std)} AS b FROM (SELECT DISTINCT iid FROM ds)),
p0 AS (SELECT uid, {init_sql('uid', seed + 10, 0, std)} AS q0, {init_sql('uid', seed + 10, 1, std)} AS q1
       FROM (SELECT DISTINCT uid FROM ds)),
w0t AS (SELECT {', '.join(f'{float(W0[l][j])!r} AS w_{l}_{j}' for l in range(K) for j in range(r))})"""]

    def scored(t, split, how):
        regs = [" + ".join(f"w_{l}_{j} * z{j}" for j in range(r)) for l in range(K)]
        return f"""(SELECT z.*, COALESCE(p.q0, 0.0) AS q0, COALESCE(p.q1, 0.0) AS q1,
            {', '.join(f'({reg}) AS reg{l}' for l, reg in enumerate(regs))},
            m.w0 + (COALESCE(s.b, 0.0) + COALESCE(c.b, 0.0)) AS base
     FROM z {how} JOIN s{t} s ON z.uid = s.uid {how} JOIN c{t} c ON z.iid = c.iid
     {how} JOIN p{t} p ON z.uid = p.uid, w{t if t else '0t'} w, m WHERE z.split = '{split}')"""

    for t in range(iters + 1):
        parts.append(f"""e{t} AS (SELECT *, base + (q0 * reg0 + q1 * reg1) - y AS e FROM {scored(t, 'train', 'LEFT')}),
h{t} AS (SELECT {t} AS iter, sqrt(avg(e * e)) AS rmse FROM e{t})""")
        if t == iters:
            break
        n = t + 1
        wsrc = f"w{t}" if t else "w0t"
        gw = ", ".join(f"sum(e * q{l} * z{j}) AS g_{l}_{j}" for l in range(K) for j in range(r))
        neww = ", ".join(nn(f"w_{l}_{j} - {step} * (g_{l}_{j} / n + {lw} * {pen(f'w_{l}_{j}')})") + f" AS w_{l}_{j}"
                         for l in range(K) for j in range(r))
        parts.append(f"""gs{n} AS (SELECT uid, count(*) AS n, sum(e) AS se, sum(e * reg0) AS sr0, sum(e * reg1) AS sr1 FROM e{t} GROUP BY uid),
gc{n} AS (SELECT iid, count(*) AS n, sum(e) AS se FROM e{t} GROUP BY iid),
gw{n} AS (SELECT count(*) AS n, {gw} FROM e{t}),
s{n} AS (SELECT s.uid, {nn(f"CASE WHEN g.n IS NULL THEN s.b ELSE s.b - {step} * (g.se / g.n + {lb} * {pen('s.b')}) END")} AS b
       FROM s{t} s LEFT JOIN gs{n} g ON s.uid = g.uid),
c{n} AS (SELECT c.iid, {nn(f"CASE WHEN g.n IS NULL THEN c.b ELSE c.b - {step} * (g.se / g.n + {lb} * {pen('c.b')}) END")} AS b
       FROM c{t} c LEFT JOIN gc{n} g ON c.iid = g.iid),
p{n} AS (SELECT p.uid, {nn(f"CASE WHEN g.n IS NULL THEN p.q0 ELSE p.q0 - {step} * (g.sr0 / g.n + {lw} * {pen('p.q0')}) END")} AS q0,
              {nn(f"CASE WHEN g.n IS NULL THEN p.q1 ELSE p.q1 - {step} * (g.sr1 / g.n + {lw} * {pen('p.q1')}) END")} AS q1
       FROM p{t} p LEFT JOIN gs{n} g ON p.uid = g.uid),
w{n} AS (SELECT {neww} FROM {wsrc}, gw{n})""")
    for t in range(iters + 1):
        parts.append(f"""te{t} AS (SELECT sqrt(avg((base + (q0 * reg0 + q1 * reg1) - y) * (base + (q0 * reg0 + q1 * reg1) - y))) AS rmse
       FROM {scored(t, 'test', 'LEFT')})""")
    return f"WITH {','.join(parts)}" + _history_select(iters, eps)


def _fit_mlr_gd(spark, sf, norm, nonneg):
    m0, tr, te = _mlr(spark, sf)
    # fixed iteration count (no early stop) so the unrolled SQL is the same job
    m, h = fit_profile_gd(tr, m0, lrate=MLR_GD["lrate"], lambda_w=MLR_GD["lambda_w"],
                          lambda_b=MLR_GD["lambda_b"], iters=MLR_GD["iters"], eps=float("-inf"),
                          norm=norm, nonneg=nonneg)
    return _finish(h, m, te)


@query("fit_mlr_gd_unrolled", _mlr_gd_sql())
def q_fit_mlr_gd_unrolled(spark, sf):
    return _fit_mlr_gd(spark, sf, "fro", False)


@query("fit_mlr_gd_l1_nonneg_unrolled", _mlr_gd_sql("l1", True))
def q_fit_mlr_gd_l1_unrolled(spark, sf):
    return _fit_mlr_gd(spark, sf, "l1", True)


# ---------------------------------------------------------------- SQL-k oracle of the IPR gradient fit
IPR_GD = dict(lrate=0.05, lambda_w=0.01, lambda_b=0.0, iters=2, std=1 / 16, seed=100)
_CAT_CODES = [("c_mktsegment", "cm", "m_code"), ("p_brand", "cb", "b_code"),
              ("o_orderpriority", "co", "o_code"), ("l_returnflag", "cr", "r_code")]


def _ipr_gd_sql(iters: int | None = None, eps: float = float("-inf"), nonneg: bool = False,
                lrate: float | None = None, lambda_b: float | None = None) -> str:
    from dyadic.functions.crng import crng_init_np
    from dyadic.plans.common import s6
    from dyadic.plans.params import init_sql
    from dyadic.plans.score_queries import Z_SQL, ZCOLS
    from dyadic.plans.table_queries import _CODES_SQL
    lr, lw, lb, it0, std, seed = (IPR_GD[x] for x in ("lrate", "lambda_w", "lambda_b", "iters", "std", "seed"))
    iters = it0 if iters is None else iters
    lr = lr if lrate is None else lrate
    lb = lb if lambda_b is None else lambda_b
    step = 2.0 * lr
    r = len(REALS)
    nn = (lambda x: f"GREATEST(0.0, {x})") if nonneg else (lambda x: x)
    W0 = [[crng_init_np(j, seed + 40, l, std) for j in range(r)] for l in range(K)]
    parts = [f"""{_CODES_SQL}, {Z_SQL},
z AS (SELECT split, y, u_code AS uc, i_code AS ic, {', '.join(f'{c} AS x{i}' for i, (_, _, c) in enumerate(_CAT_CODES))},
             {', '.join(f'{zc} AS z{j}' for j, zc in enumerate(ZCOLS))} FROM enc, st),
bu0 AS (SELECT c AS code, {init_sql('c', seed, 0, std)} AS b FROM cu),
bi0 AS (SELECT c AS code, {init_sql('c', seed + 1, 0, std)} AS b FROM ci),
p0 AS (SELECT c AS code, {init_sql('c', seed + 10, 0, std)} AS q0, {init_sql('c', seed + 10, 1, std)} AS q1 FROM cu),
{', '.join(f"wc{i}_0 AS (SELECT c AS code, {init_sql('c', seed + 20 + i, 0, std)} AS a0, {init_sql('c', seed + 20 + i, 1, std)} AS a1 FROM {tab})" for i, (_, tab, _) in enumerate(_CAT_CODES))},
w0t AS (SELECT 0.0 AS w0, {', '.join(f'{float(W0[l][j])!r} AS w_{l}_{j}' for l in range(K) for j in range(r))})"""]

    def scored(t, split):
        wt = f"w{t}" if t else "w0t"
        regs = []
        for l in range(K):
            terms = [f"w_{l}_{j} * z{j}" for j in range(r)]
            reg = " + ".join(terms)
            for i in range(len(_CAT_CODES)):
                reg = f"({reg}) + COALESCE(k{i}.a{l}, 0.0)"
            regs.append(reg)
        cat_joins = " ".join(f"LEFT JOIN wc{i}_{t} k{i} ON z.x{i} = k{i}.code" for i in range(len(_CAT_CODES)))
        return f"""(SELECT z.*, COALESCE(p.q0, 0.0) AS q0, COALESCE(p.q1, 0.0) AS q1,
            {', '.join(f'({reg}) AS reg{l}' for l, reg in enumerate(regs))},
            w.w0 + (COALESCE(bu.b, 0.0) + COALESCE(bi.b, 0.0)) AS base
     FROM z LEFT JOIN bu{t} bu ON z.uc = bu.code LEFT JOIN bi{t} bi ON z.ic = bi.code
     LEFT JOIN p{t} p ON z.uc = p.code {cat_joins}, {wt} w WHERE z.split = '{split}')"""

    def upd(old, g, val, se, lam):
        return nn(f"CASE WHEN {g}.n IS NULL THEN {old}.{val} ELSE {old}.{val} - {step} * ({g}.{se} / {g}.n + {lam} * {old}.{val}) END")

    for t in range(iters + 1):
        parts.append(f"""e{t} AS (SELECT *, base + (q0 * reg0 + q1 * reg1) - y AS e FROM {scored(t, 'train')}),
h{t} AS (SELECT {t} AS iter, sqrt(avg(e * e)) AS rmse FROM e{t})""")
        if t == iters:
            break
        n = t + 1
        wsrc = f"w{t}" if t else "w0t"
        gw = ", ".join(f"sum(e * q{l} * z{j}) AS g_{l}_{j}" for l in range(K) for j in range(r))
        neww = ", ".join(nn(f"w_{l}_{j} - {step} * (g_{l}_{j} / n + {lw} * w_{l}_{j})") + f" AS w_{l}_{j}"
                         for l in range(K) for j in range(r))
        cats = []
        for i in range(len(_CAT_CODES)):
            cats.append(f"""gk{i}_{n} AS (SELECT x{i} AS code, count(*) AS n, sum(e * q0) AS s0, sum(e * q1) AS s1 FROM e{t} GROUP BY x{i}),
wc{i}_{n} AS (SELECT o.code, {upd('o', 'g', 'a0', 's0', lw)} AS a0, {upd('o', 'g', 'a1', 's1', lw)} AS a1
       FROM wc{i}_{t} o LEFT JOIN gk{i}_{n} g ON o.code = g.code)""")
        parts.append(f"""gu{n} AS (SELECT uc AS code, count(*) AS n, sum(e) AS se, sum(e * reg0) AS s0, sum(e * reg1) AS s1 FROM e{t} GROUP BY uc),
gi{n} AS (SELECT ic AS code, count(*) AS n, sum(e) AS se FROM e{t} GROUP BY ic),
gw{n} AS (SELECT count(*) AS n, sum(e) AS se, {gw} FROM e{t}),
bu{n} AS (SELECT o.code, {upd('o', 'g', 'b', 'se', lb)} AS b FROM bu{t} o LEFT JOIN gu{n} g ON o.code = g.code),
bi{n} AS (SELECT o.code, {upd('o', 'g', 'b', 'se', lb)} AS b FROM bi{t} o LEFT JOIN gi{n} g ON o.code = g.code),
p{n} AS (SELECT o.code, {upd('o', 'g', 'q0', 's0', lw)} AS q0, {upd('o', 'g', 'q1', 's1', lw)} AS q1
       FROM p{t} o LEFT JOIN gu{n} g ON o.code = g.code),
{', '.join(cats)},
w{n} AS (SELECT {nn(f"w0 - {step} * (se / n)")} AS w0, {neww} FROM {wsrc}, gw{n})""")
    for t in range(iters + 1):
        parts.append(f"""te{t} AS (SELECT sqrt(avg((base + (q0 * reg0 + q1 * reg1) - y) * (base + (q0 * reg0 + q1 * reg1) - y))) AS rmse
       FROM {scored(t, 'test')})""")
    return f"WITH {','.join(parts)}" + _history_select(iters, eps)


@query("fit_ipr_gd_unrolled", _ipr_gd_sql())
def q_fit_ipr_gd_unrolled(spark, sf):
    m0, tr, te = _ipr(spark, sf)
    # fixed iteration count (no early stop) so the unrolled SQL is the same job
    m, h = fit_profile_gd(tr, m0, lrate=IPR_GD["lrate"], lambda_w=IPR_GD["lambda_w"],
                          lambda_b=IPR_GD["lambda_b"], iters=IPR_GD["iters"], eps=float("-inf"))
    return _finish(h, m, te)


# ---------------------------------------------------------------- SQL-k oracles of the block coordinate descent
def _cd_sql(model: str) -> str:
    """One sweep of exact block coordinate descent unrolled as CTEs (k = 2):
    ``model`` 'ipr' (codes, categorical and real W blocks, w0 learned) or
    'mlr' (raw ids, real W columns, w0 = train mean).  2 x 2 solves are
    Cramer's rule."""
    from dyadic.functions.crng import crng_init_np
    from dyadic.plans.common import s6
    from dyadic.plans.params import init_sql
    from dyadic.plans.registry import SPLIT_SQL
    from dyadic.plans.score_queries import Z_SQL, ZCOLS
    from dyadic.plans.table_queries import _CODES_SQL
    ipr = model == "ipr"
    lw, lb = 1.0, 1.0
    std, seed = (1 / 16, 100) if ipr else (0.01, 100)
    r = len(REALS)
    ncat = len(_CAT_CODES) if ipr else 0
    W0 = [[crng_init_np(j, seed + 40, l, std) for j in range(r)] for l in range(K)]
    zsel = ", ".join(f"{zc} AS z{j}" for j, zc in enumerate(ZCOLS))
    if ipr:
        head = f"""{_CODES_SQL}, {Z_SQL},
z AS (SELECT split, y, u_code AS uk, i_code AS ik, {', '.join(f'{c} AS x{i}' for i, (_, _, c) in enumerate(_CAT_CODES))},
             {zsel} FROM enc, st),
ukeys AS (SELECT c AS k FROM cu), ikeys AS (SELECT c AS k FROM ci),
w0v AS (SELECT 0.0 AS w0)"""
    else:
        head = f"""{SPLIT_SQL}, {Z_SQL},
z AS (SELECT split, y, uid AS uk, iid AS ik, {zsel} FROM ds, st),
ukeys AS (SELECT DISTINCT uid AS k FROM ds), ikeys AS (SELECT DISTINCT iid AS k FROM ds),
w0v AS (SELECT avg(y) AS w0 FROM ds WHERE split = 'train')"""
    parts = [head + f""",
bu_0 AS (SELECT k, {init_sql('k', seed, 0, std)} AS b FROM ukeys),
bi_0 AS (SELECT k, {init_sql('k', seed + 1, 0, std)} AS b FROM ikeys),
p_0 AS (SELECT k, {init_sql('k', seed + 10, 0, std)} AS q0, {init_sql('k', seed + 10, 1, std)} AS q1 FROM ukeys),
wr_0 AS (SELECT {', '.join(f'{float(W0[l][j])!r} AS w_{l}_{j}' for l in range(K) for j in range(r))})"""]
    if ipr:
        parts.append(", ".join(
            f"wc{i}_0 AS (SELECT c AS k, {init_sql('c', seed + 20 + i, 0, std)} AS a0, {init_sql('c', seed + 20 + i, 1, std)} AS a1 FROM {tab})"
            for i, (_, tab, _) in enumerate(_CAT_CODES)))
    st = {"w0": "w0v", "bu": "bu_0", "bi": "bi_0", "p": "p_0", "wr": "wr_0",
          **{f"wc{i}": f"wc{i}_0" for i in range(ncat)}}
    counter = [0]

    def scored(split="train"):
        regs = []
        for l in range(K):
            reg = " + ".join(f"wr.w_{l}_{j} * z{j}" for j in range(r))
            for i in range(ncat):
                reg = f"({reg}) + COALESCE(k{i}.a{l}, 0.0)"
            regs.append(reg)
        cj = " ".join(f"LEFT JOIN {st[f'wc{i}']} k{i} ON z.x{i} = k{i}.k" for i in range(ncat))
        kcols = ", ".join(f"k{i}.a0 AS o{i}_0, k{i}.a1 AS o{i}_1" for i in range(ncat))
        return f"""(SELECT z.*, COALESCE(bu.b, 0.0) AS bu, COALESCE(bi.b, 0.0) AS bi,
            COALESCE(p.q0, 0.0) AS q0, COALESCE(p.q1, 0.0) AS q1, {', '.join(f'({g}) AS reg{l}' for l, g in enumerate(regs))}
            {', ' + kcols if kcols else ''}, {', '.join(f'wr.w_{l}_{j}' for l in range(K) for j in range(r))},
            z.y - ((w.w0 + (COALESCE(bu.b, 0.0) + COALESCE(bi.b, 0.0))) + (COALESCE(p.q0, 0.0) * ({regs[0]})
                   + COALESCE(p.q1, 0.0) * ({regs[1]}))) AS res
     FROM z LEFT JOIN {st['bu']} bu ON z.uk = bu.k LEFT JOIN {st['bi']} bi ON z.ik = bi.k
     LEFT JOIN {st['p']} p ON z.uk = p.k {cj}, {st['wr']} wr, {st['w0']} w WHERE z.split = '{split}')"""

    def new(name):
        counter[0] += 1
        return f"{name}_{counter[0]}"

    def solve2(g00, g01, g11, c0, c1, lam):
        d = f"(({g00} + {lam}) * ({g11} + {lam}) - ({g01}) * ({g01}))"
        return (f"((({g11} + {lam}) * ({c0}) - ({g01}) * ({c1})) / {d})",
                f"((({g00} + {lam}) * ({c1}) - ({g01}) * ({c0})) / {d})")

    def bias(key, field):
        nm = new(field)
        parts.append(f"""{nm}g AS (SELECT {key} AS k, sum(res + {field}) / (count(*) + {lb}) AS b FROM {scored()} GROUP BY {key}),
{nm} AS (SELECT o.k, COALESCE(g.b, o.b) AS b FROM {st[field]} o LEFT JOIN {nm}g g ON o.k = g.k)""")
        st[field] = nm

    def vec_block(key, field, zs, own, cols):
        nm = new(field)
        x0, x1 = solve2("g00", "g01", "g11", "c0", "c1", lw)
        parts.append(f"""{nm}g AS (SELECT {key} AS k, sum(({zs[0]}) * ({zs[0]})) AS g00, sum(({zs[0]}) * ({zs[1]})) AS g01,
        sum(({zs[1]}) * ({zs[1]})) AS g11, sum((res + {own}) * ({zs[0]})) AS c0, sum((res + {own}) * ({zs[1]})) AS c1
        FROM {scored()} GROUP BY {key}),
{nm}s AS (SELECT k, {x0} AS v0, {x1} AS v1 FROM {nm}g),
{nm} AS (SELECT o.k, COALESCE(s.v0, o.{cols[0]}) AS {cols[0]}, COALESCE(s.v1, o.{cols[1]}) AS {cols[1]}
        FROM {st[field]} o LEFT JOIN {nm}s s ON o.k = s.k)""")
        st[field] = nm

    def objective(tag):
        reg = [f"(SELECT sum(q0 * q0 + q1 * q1) FROM {st['p']})"]
        reg += [f"(SELECT sum(a0 * a0 + a1 * a1) FROM {st[f'wc{i}']})" for i in range(ncat)]
        reg += [f"(SELECT {' + '.join(f'w_{l}_{j} * w_{l}_{j}' for l in range(K) for j in range(r))} FROM {st['wr']})"]
        bsum = f"(SELECT sum(b * b) FROM {st['bu']}) + (SELECT sum(b * b) FROM {st['bi']})"
        parts.append(f"""{tag} AS (SELECT sqrt(avg(res * res)) AS rmse,
        sum(res * res) + {lw} * ({' + '.join(reg)}) + {lb} * ({bsum}) AS obj FROM {scored()})""")

    objective("h0")  # before any block moves
    if ipr:
        nm = new("w0")
        parts.append(f"{nm} AS (SELECT (SELECT w0 FROM {st['w0']}) + avg(res) AS w0 FROM {scored()})")
        st["w0"] = nm
    bias("uk", "bu")
    bias("ik", "bi")
    vec_block("uk", "p", ["reg0", "reg1"], "(q0 * reg0 + q1 * reg1)", ["q0", "q1"])
    for i in range(ncat):
        vec_block(f"x{i}", f"wc{i}", ["q0", "q1"], f"(q0 * COALESCE(o{i}_0, 0.0) + q1 * COALESCE(o{i}_1, 0.0))",
                  ["a0", "a1"])
    for j in range(r):
        nm = new("wr")
        zs = [f"q0 * z{j}", f"q1 * z{j}"]
        own = f"(w_0_{j} * ({zs[0]}) + w_1_{j} * ({zs[1]}))"
        x0, x1 = solve2("g00", "g01", "g11", "c0", "c1", lw)
        others = ", ".join(f"o.w_{l}_{jj}" for l in range(K) for jj in range(r) if jj != j)
        parts.append(f"""{nm}g AS (SELECT sum(({zs[0]}) * ({zs[0]})) AS g00, sum(({zs[0]}) * ({zs[1]})) AS g01,
        sum(({zs[1]}) * ({zs[1]})) AS g11, sum((res + {own}) * ({zs[0]})) AS c0, sum((res + {own}) * ({zs[1]})) AS c1
        FROM {scored()}),
{nm} AS (SELECT {others}, {x0} AS w_0_{j}, {x1} AS w_1_{j} FROM {st['wr']} o, {nm}g)""")
        st["wr"] = nm

    objective("h1")
    parts.append(f"""te AS (SELECT sqrt(avg(res * res)) AS rmse FROM {scored('test')})""")
    return f"""WITH {','.join(parts)}
SELECT 0 AS iter, {s6('rmse')} AS train_rmse, CAST(NULL AS DOUBLE) AS test_rmse, {s6('obj')} AS objective FROM h0
UNION ALL
SELECT 1, {s6('rmse')}, {s6('(SELECT rmse FROM te)')}, {s6('obj')} FROM h1"""


ORACLES_CD = {"fit_ipr_cd": _cd_sql("ipr"), "fit_mlr_als": _cd_sql("mlr")}
# the closed-form fits registered above get their unrolled one-sweep SQL
from dyadic.plans.registry import ORACLES  # noqa: E402

ORACLES.update(ORACLES_CD)


# ---------------------------------------------------------------- SQL-k oracle of FM ALS (one sweep)
def _det3(m):
    return (f"(({m[0][0]}) * (({m[1][1]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][1]}))"
            f" - ({m[0][1]}) * (({m[1][0]}) * ({m[2][2]}) - ({m[1][2]}) * ({m[2][0]}))"
            f" + ({m[0][2]}) * (({m[1][0]}) * ({m[2][1]}) - ({m[1][1]}) * ({m[2][0]})))")


def _solve3_sql(lam):
    """x = (G + diag(lam))^-1 c by Cramer's rule over columns g_a_b, c_a."""
    A = [[f"g_{min(a, b)}_{max(a, b)}" + (f" + {lam[a]}" if a == b else "") for b in range(3)] for a in range(3)]
    det = _det3(A)
    xs = []
    for i in range(3):
        Ai = [[(f"c_{a}" if b == i else A[a][b]) for b in range(3)] for a in range(3)]
        xs.append(f"({_det3(Ai)}) / ({det})")
    return xs


def _fm_als_sql() -> str:
    from dyadic.functions.crng import crng_init_np
    from dyadic.plans.common import s6
    from dyadic.plans.params import init_sql
    from dyadic.plans.score_queries import Z_SQL, ZCOLS
    from dyadic.plans.table_queries import _CODES_SQL
    std, seed, lw, lv = 0.1, 300, 1.0, 1.0
    lam = [lw, lv, lv]
    r = len(REALS)
    codes = [("u_code", "cu"), ("i_code", "ci")] + [(c, tab) for _, tab, c in _CAT_CODES]
    nf = len(codes)
    V0 = [[crng_init_np(j, seed + 50, l, std) for l in range(K)] for j in range(r)]
    parts = [f"""{_CODES_SQL}, {Z_SQL},
z AS (SELECT split, y, {', '.join(f'{c} AS x{i}' for i, (c, _) in enumerate(codes))},
             {', '.join(f'{zc} AS z{j}' for j, zc in enumerate(ZCOLS))} FROM enc, st),
{', '.join(f"f{i}_0 AS (SELECT c AS k, 0.0 AS w, {init_sql('c', seed + i, 0, std)} AS v0, {init_sql('c', seed + i, 1, std)} AS v1 FROM {tab})" for i, (_, tab) in enumerate(codes))},
g_0 AS (SELECT 0.0 AS w0, {', '.join(f'0.0 AS r{j}' for j in range(r))},
        {', '.join(f'{float(V0[j][l])!r} AS v_{j}_{l}' for j in range(r) for l in range(K))})"""]
    st = {**{f"f{i}": f"f{i}_0" for i in range(nf)}, "g": "g_0"}
    cnt = [0]

    def scored(split="train"):
        cols, joins = [], []
        for i in range(nf):
            joins.append(f"LEFT JOIN {st[f'f{i}']} t{i} ON z.x{i} = t{i}.k")
            cols += [f"COALESCE(t{i}.w, 0.0) AS f{i}_w", f"COALESCE(t{i}.v0, 0.0) AS f{i}_v0",
                     f"COALESCE(t{i}.v1, 0.0) AS f{i}_v1"]
        inner = f"""(SELECT z.*, {', '.join(cols)}, g.* FROM z {' '.join(joins)}, {st['g']} g WHERE z.split = '{split}')"""
        lin = "w0"
        for i in range(nf):
            lin = f"({lin} + f{i}_w)"
        for j in range(r):
            lin = f"({lin} + r{j} * z{j})"
        q, sq = [], []
        for l in range(K):
            qe = " + ".join([f"f{i}_v{l}" for i in range(nf)] + [f"v_{j}_{l} * z{j}" for j in range(r)])
            se = " + ".join([f"f{i}_v{l} * f{i}_v{l}" for i in range(nf)] + [f"(v_{j}_{l} * v_{j}_{l}) * z{j} * z{j}" for j in range(r)])
            q.append(qe)
            sq.append(se)
        two = " + ".join(f"(({q[l]}) * ({q[l]}) - ({sq[l]}))" for l in range(K))
        return f"""(SELECT *, {', '.join(f'({q[l]}) AS q{l}' for l in range(K))},
            y - ({lin} + 0.5 * ({two})) AS res FROM {inner})"""

    def emit(sql):
        parts.append(sql)

    def block_sums(zs, own, key=None):
        sums = [f"sum(({zs[a]}) * ({zs[b]})) AS g_{a}_{b}" for a in range(3) for b in range(a, 3)]
        sums += [f"sum((res + {own}) * ({zs[a]})) AS c_{a}" for a in range(3)]
        grp = f"{key} AS k, " if key else ""
        tail = f" GROUP BY {key}" if key else ""
        return f"SELECT {grp}{', '.join(sums)} FROM {scored()}{tail}"

    def new(n):
        cnt[0] += 1
        return f"{n}_{cnt[0]}"

    emit(f"h0 AS (SELECT sqrt(avg(res * res)) AS rmse FROM {scored()})")
    nm = new("g")
    others = ", ".join([f"r{j}" for j in range(r)] + [f"v_{j}_{l}" for j in range(r) for l in range(K)])
    emit(f"{nm} AS (SELECT (SELECT w0 FROM {st['g']}) + (SELECT avg(res) FROM {scored()}) AS w0, {others} FROM {st['g']})")
    st["g"] = nm
    x = _solve3_sql(lam)
    for i in range(nf):
        nm = new(f"f{i}")
        zs = ["1.0", f"q0 - f{i}_v0", f"q1 - f{i}_v1"]
        own = f"(f{i}_w + (f{i}_v0 * (q0 - f{i}_v0) + f{i}_v1 * (q1 - f{i}_v1)))"
        emit(f"""{nm}g AS ({block_sums(zs, own, f'x{i}')}),
{nm}s AS (SELECT k, {x[0]} AS w, {x[1]} AS v0, {x[2]} AS v1 FROM {nm}g),
{nm} AS (SELECT o.k, COALESCE(s.w, o.w) AS w, COALESCE(s.v0, o.v0) AS v0, COALESCE(s.v1, o.v1) AS v1
         FROM {st[f'f{i}']} o LEFT JOIN {nm}s s ON o.k = s.k)""")
        st[f"f{i}"] = nm
    for j in range(r):
        nm = new("g")
        zs = [f"z{j}", f"z{j} * (q0 - z{j} * v_{j}_0)", f"z{j} * (q1 - z{j} * v_{j}_1)"]
        own = f"(r{j} * z{j} + (v_{j}_0 * ({zs[1]}) + v_{j}_1 * ({zs[2]})))"
        keep = ", ".join(["w0"] + [f"r{jj}" for jj in range(r) if jj != j] +
                         [f"v_{jj}_{l}" for jj in range(r) if jj != j for l in range(K)])
        emit(f"""{nm}g AS ({block_sums(zs, own)}),
{nm} AS (SELECT {keep}, {x[0]} AS r{j}, {x[1]} AS v_{j}_0, {x[2]} AS v_{j}_1 FROM {st['g']}, {nm}g)""")
        st["g"] = nm
    emit(f"h1 AS (SELECT sqrt(avg(res * res)) AS rmse FROM {scored()})")
    emit(f"te AS (SELECT sqrt(avg(res * res)) AS rmse FROM {scored('test')})")
    return f"""WITH {','.join(parts)}
SELECT 0 AS iter, {s6('rmse')} AS train_rmse, CAST(NULL AS DOUBLE) AS test_rmse, CAST(NULL AS DOUBLE) AS objective FROM h0
UNION ALL
SELECT 1, {s6('rmse')}, {s6('(SELECT rmse FROM te)')}, CAST(NULL AS DOUBLE) FROM h1"""


ORACLES["fit_fm_als"] = _fm_als_sql()


# the gradient fits registered above, with their own stop rules, get the
# same unrolled SQL
ORACLES.update({
    "fit_ipr_gd": _ipr_gd_sql(iters=2, eps=1e-4),
    "fit_ipr_gd_nonneg": _ipr_gd_sql(iters=2, eps=1e-4, nonneg=True),
    "fit_mlr_gd": _mlr_gd_sql("fro", False, eps=0.0),
    "fit_mlr_gd_l1_nonneg": _mlr_gd_sql("l1", True, eps=0.0),
    "fit_report": _ipr_gd_sql(iters=6, eps=0.3),
})
