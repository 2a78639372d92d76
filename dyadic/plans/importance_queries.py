"""Registered interpretation queries (IM-1..6, WN-5, SO-1/2) on D's
training rows with the formula parameters of the scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators import importance as imp
from dyadic.operators.encode import encode
from dyadic.operators import prep, windows
from dyadic.plans.common import r6, s6
from dyadic.plans.params import init_sql, scalar_table, vec_table
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import query
from dyadic.plans.score_queries import (
    CATS, FM_VR, FM_WR, K, REALS, W_IPR_R, W_MLR, Z_SQL, ZCOLS, _CAT_CODE, _FM_CODE,
    fm_formula_tables)
from dyadic.plans.registry import SPLIT_SQL
from dyadic.plans.table_queries import _CODES_SQL
from dyadic.sources.tables import DYAD_GUIDE, dyads

_Z_TRAIN = f"""z AS (SELECT enc.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM enc, st WHERE split = 'train')"""


def _encoded(spark, sf):
    return encode(dyads(spark, sf), DYAD_GUIDE)


def _train(enc):
    return enc.frame.filter(F.col("split") == "train")


def _ipr_params(enc):
    ids = {f: enc.codes(f) for f in ("uid", "iid", *CATS)}
    cards = enc.cards
    biases = {"uid": (scalar_table(ids["uid"], "uid", 40), cards["uid"]),
              "iid": (scalar_table(ids["iid"], "iid", 41), cards["iid"])}
    P = (vec_table(ids["uid"], "uid", 42, K), cards["uid"])
    Wcat = {f: (vec_table(ids[f], f, 43 + i, K, name="wvec"), cards[f]) for i, f in enumerate(CATS)}
    return biases, P, Wcat


# ---------------------------------------------------------------- IM-3/4, SO-1/2, WN-5
def _ipr_dev_sql():
    """SQL select list of per-(feature, model) deviation sums."""
    P = [f"abs({init_sql('u_code', 42, l)})" for l in range(K)]
    cols = [f"sum(abs({init_sql('u_code', 40, 0)})) AS e_uid",
            f"sum(abs({init_sql('i_code', 41, 0)})) AS e_iid"]
    for i, (f, code) in enumerate(_CAT_CODE.items()):
        for l in range(K):
            cols.append(f"sum({P[l]} * abs({init_sql(code, 43 + i, l)})) AS f_{f}_{l}")
    for j, r in enumerate(REALS):
        for l in range(K):
            cols.append(f"sum({P[l]} * {abs(float(W_IPR_R[l, j]))!r} * abs(z{j})) AS f_{r}_{l}")
    return ", ".join(cols)


def _ipr_long_sql():
    parts = [f"SELECT 'uid' AS feature, l AS model, e_uid AS dev, 1 AS ent FROM dv, range(0, {K}) r(l)",
             f"SELECT 'iid', l, e_iid, 1 FROM dv, range(0, {K}) r(l)"]
    for f in [*CATS, *REALS]:
        for l in range(K):
            parts.append(f"SELECT '{f}', {l}, f_{f}_{l}, 0 FROM dv")
    return "\nUNION ALL ".join(parts)


_IPR_BASE = f"""WITH {_CODES_SQL}, {Z_SQL}, {_Z_TRAIN},
dv AS (SELECT {_ipr_dev_sql()} FROM z),
lng AS ({_ipr_long_sql()}),
tot AS (SELECT sum(CASE WHEN ent = 1 THEN dev / {K} ELSE dev END) AS T FROM lng),
ov AS (SELECT feature, sum(CASE WHEN ent = 1 THEN dev / {K} ELSE dev END) / (SELECT T FROM tot) AS importance FROM lng GROUP BY feature),
rk AS (SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM ov),
pm AS (SELECT feature, CAST(model AS INTEGER) AS model, dev / (SELECT T FROM tot) AS importance FROM lng)"""


def _ipr_frames(spark, sf):
    enc = _encoded(spark, sf)
    biases, P, Wcat = _ipr_params(enc)
    return imp.ipr_importance(_train(enc), K, biases, "uid", P, Wcat, REALS, W_IPR_R)


@query("ipr_importance", _IPR_BASE + f"""
SELECT feature, {s6('importance')} AS importance, rank FROM rk""")
def q_ipr_imp(spark, sf):
    overall, _, _ = _ipr_frames(spark, sf)
    return imp.importance_rank(overall).select("feature", r6("importance").alias("importance"),
                                               F.col("rank").cast("int").alias("rank"))


@query("ipr_profile_importance", _IPR_BASE + f"""
SELECT pm.feature, pm.model, {s6('pm.importance')} AS importance, rk.rank FROM pm JOIN rk USING (feature)""")
def q_ipr_prof(spark, sf):
    overall, per_model, _ = _ipr_frames(spark, sf)
    ranked = imp.importance_rank(overall)
    out = imp.profile_rank(per_model, ranked)
    return out.select("feature", "model", r6("importance").alias("importance"),
                      F.col("rank").cast("int").alias("rank"))


@query("share_of_model_total", _IPR_BASE + f"""
SELECT feature, model, {s6('importance / sum(importance) OVER (PARTITION BY model)')} AS share FROM pm""")
def q_share(spark, sf):
    _, per_model, _ = _ipr_frames(spark, sf)
    return windows.share_of_model_total(per_model, "importance").select(
        "feature", "model", r6("share").alias("share"))


# ---------------------------------------------------------------- IM-5
def _membership_sql():
    P = [init_sql("u_code", 42, l) for l in range(K)]
    regs = []
    for l in range(K):
        cats = " + ".join(init_sql(code, 43 + i, l) for i, code in enumerate(_CAT_CODE.values()))
        rl = " + ".join(f"({float(W_IPR_R[l, j])!r}) * z{j}" for j in range(len(REALS)))
        regs.append(f"abs(({P[l]}) * ({cats} + {rl}))")
    sums = ", ".join(f"sum({r}) AS m{l}" for l, r in enumerate(regs))
    tot = " + ".join(f"m{l}" for l in range(K))
    sel = "\nUNION ALL ".join(f"SELECT uid, {l} AS model, {s6(f'm{l} / ({tot})')} AS membership FROM per"
                              for l in range(K))
    return f"""WITH {_CODES_SQL}, {Z_SQL}, {_Z_TRAIN},
per AS (SELECT CAST(u_code AS INTEGER) AS uid, {sums} FROM z GROUP BY u_code)
{sel}"""


@query("profile_membership", _membership_sql())
def q_membership(spark, sf):
    enc = _encoded(spark, sf)
    _, P, Wcat = _ipr_params(enc)
    out = imp.profile_membership(_train(enc), K, "uid", P, Wcat, REALS, W_IPR_R)
    return out.select("uid", "model", r6("membership").alias("membership"))


# ---------------------------------------------------------------- IM-6
def _mlr_sql():
    pw = []
    for j in range(len(REALS)):
        pw.append(f"sum(abs(COALESCE(p0, 0.0) * ({float(W_MLR[0, j])!r}) + COALESCE(p1, 0.0) * ({float(W_MLR[1, j])!r})) * abs(z{j})) AS x{j}")
    labels = ["uid", "iid", *REALS]
    names = ["su", "ci", *[f"x{j}" for j in range(len(REALS))]]
    tot = " + ".join(names)
    sel = "\nUNION ALL ".join(f"SELECT '{lab}' AS feature, {s6(f'{n} / ({tot})')} AS importance FROM dv"
                              for lab, n in zip(labels, names))
    return f"""WITH {SPLIT_SQL}, {Z_SQL},
tu AS (SELECT DISTINCT uid FROM ds WHERE split = 'train'),
ti AS (SELECT DISTINCT iid FROM ds WHERE split = 'train'),
s AS (SELECT uid, {init_sql('uid', 13, 0)} AS s, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1 FROM tu),
c AS (SELECT iid, {init_sql('iid', 14, 0)} AS c FROM ti),
z AS (SELECT ds.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM ds, st WHERE split = 'train'),
dv AS (SELECT sum(abs(COALESCE(s.s, 0.0))) AS su, sum(abs(COALESCE(c.c, 0.0))) AS ci, {', '.join(pw)}
       FROM z LEFT JOIN s ON z.uid = s.uid LEFT JOIN c ON z.iid = c.iid)
{sel}"""


@query("mlr_importance", _mlr_sql())
def q_mlr_imp(spark, sf):
    train, _ = hold_out(held_dyads(spark, sf))
    st = prep.fit_zscore(train, REALS)
    z = prep.apply_zscore(train, st, REALS)
    tu, ti = train.select("uid").distinct(), train.select("iid").distinct()
    out = imp.mlr_importance(z, K, "uid", "iid", (scalar_table(tu, "uid", 13), None),
                             (scalar_table(ti, "iid", 14), None), (vec_table(tu, "uid", 15, K), None),
                             REALS, W_MLR)
    return out.select("feature", r6("importance").alias("importance"))


# ---------------------------------------------------------------- IM-1/2
def _fm_entries_sql():
    rows = []
    offs = ["0", "nu", "nu + ni", "nu + ni + nm", "nu + ni + nm + nb", "nu + ni + nm + nb + no"]
    for f, code in enumerate(_FM_CODE):
        rows.append(f"SELECT rid, {offs[f]} + {code} AS idx, 1.0 AS x, {init_sql(code, 50 + f, 0)} AS w, "
                    f"{init_sql(code, 60 + f, 0)} AS v0, {init_sql(code, 60 + f, 1)} AS v1 FROM r, card")
    base = "nu + ni + nm + nb + no + nr"
    for j in range(len(REALS)):
        rows.append(f"SELECT rid, {base} + {j}, z{j}, {float(FM_WR[j])!r}, {float(FM_VR[j, 0])!r}, "
                    f"{float(FM_VR[j, 1])!r} FROM r, card WHERE z{j} <> 0")
    return "\nUNION ALL ".join(rows)


_FM_IMP_SQL = f"""WITH {_CODES_SQL}, {Z_SQL},
r AS (SELECT row_number() OVER () AS rid, enc.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))}
      FROM enc, st WHERE split = 'train'),
a AS ({_fm_entries_sql()}),
s1 AS (SELECT idx, sum(abs(w * x)) AS s1 FROM a GROUP BY idx),
s2 AS (SELECT a.idx, sum(a.x * a.x * abs(b.x * (a.v0 * b.v0 + a.v1 * b.v1)) / (abs(a.x) + abs(b.x))) AS s2
       FROM a JOIN a AS b ON a.rid = b.rid AND a.idx <> b.idx GROUP BY a.idx),
j AS (SELECT idx, s1, COALESCE(s2, 0.0) AS s2 FROM s1 LEFT JOIN s2 USING (idx)),
t AS (SELECT sum(s1 + s2) AS T FROM j),
fi AS (SELECT CAST(idx AS BIGINT) AS idx, (s1 + s2) / T AS f, s1 / T AS f1, s2 / T AS f2 FROM j, t)"""


def _fm_imp(spark, sf):
    enc = _encoded(spark, sf)
    starts = {f: s for f, _, s, _ in enc.ranges}
    return enc, imp.fm_importance(_train(enc), K, fm_formula_tables(enc), starts, REALS, FM_WR, FM_VR)


@query("fm_importance", _FM_IMP_SQL + f"""
SELECT idx, {s6('f')} AS f, {s6('f1')} AS f1, {s6('f2')} AS f2 FROM fi""")
def q_fm_imp(spark, sf):
    _, out = _fm_imp(spark, sf)
    return out.select("idx", *[r6(c).alias(c) for c in ("f", "f1", "f2")])


def _ranges_sql():
    from dyadic.plans.table_queries import _RANGES_SQL
    return _RANGES_SQL.split(f"WITH {_CODES_SQL}\n", 1)[1]


@query("collapse_importance", _FM_IMP_SQL + f""",
rg AS ({_ranges_sql()})
SELECT feature, {s6('sum(f)')} AS f, {s6('sum(f1)')} AS f1, {s6('sum(f2)')} AS f2
FROM fi JOIN rg ON fi.idx >= rg.start AND fi.idx < rg."end" GROUP BY feature""")
def q_collapse(spark, sf):
    enc, out = _fm_imp(spark, sf)
    c = imp.collapse_importance(out, enc.feature_ranges(spark), ["f", "f1", "f2"])
    return c.select("feature", *[r6(x).alias(x) for x in ("f", "f1", "f2")])
