"""Registered scoring and lookup queries (SC-1..5, JN-2/3) with
formula parameters on D's hold-out rows, k = 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators import prep, score, stats
from dyadic.operators.encode import encode
from dyadic.operators.joins import gather, gather_cold_start
from dyadic.plans.common import ROW_DRAW_SQL, cnt, r6, row_draw, s6
from dyadic.plans.params import init_sql, mat, scalar_table, vec_table
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.functions.crng import crng_uniform_sql
from dyadic.plans.registry import ORACLES, SPLIT_SQL, query
from dyadic.plans.table_queries import _CODES_SQL
from dyadic.sources.tables import DYAD_GUIDE, dyads

K = 2
REALS = list(DYAD_GUIDE.reals)
CATS = list(DYAD_GUIDE.cats)

# z-scored reals of ds / enc (train statistics), as SQL.
Z_SQL = """st AS (SELECT avg(l_discount) AS m1, stddev_pop(l_discount) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2,
              avg(p_retailprice) AS m3, stddev_pop(p_retailprice) AS s3, avg(c_acctbal) AS m4, stddev_pop(c_acctbal) AS s4
       FROM ds WHERE split = 'train')"""
ZCOLS = ["(l_discount - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END",
         "(l_tax - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END",
         "(p_retailprice - m3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END",
         "(c_acctbal - m4) / CASE WHEN s4 = 0 THEN 1.0 ELSE s4 END"]


def _split(spark, sf):
    d = held_dyads(spark, sf)
    train, test = hold_out(d)
    return d, train, test


def _wx_sql(W, zcols):
    """SQL for the k components of W x (W literal k x r)."""
    return [" + ".join(f"({float(W[l, j])!r}) * z{j}" for j in range(W.shape[1])) for l in range(W.shape[0])]


# ---------------------------------------------------------------- SC-1
@query("score_factors", f"""WITH {SPLIT_SQL},
m AS (SELECT avg(y) AS mean FROM ds WHERE split = 'train'),
u AS (SELECT uid, {init_sql('uid', 11, 0)} AS u0, {init_sql('uid', 11, 1)} AS u1 FROM (SELECT DISTINCT uid FROM ds WHERE split = 'train')),
i AS (SELECT iid, {init_sql('iid', 12, 0)} AS i0, {init_sql('iid', 12, 1)} AS i1 FROM (SELECT DISTINCT iid FROM ds WHERE split = 'train'))
SELECT l_orderkey, l_linenumber, uid, iid,
       {s6('LEAST(5.0, GREATEST(0.0, COALESCE(u0 * i0 + u1 * i1, 0.0) + mean))')} AS pred,
       u0 IS NULL OR i0 IS NULL AS is_cold
FROM ds LEFT JOIN u USING (uid) LEFT JOIN i USING (iid), m WHERE split = 'test'""")
def q_score_factors(spark, sf):
    d, train, test = _split(spark, sf)
    U = vec_table(train.select("uid").distinct(), "uid", 11, K)
    I = vec_table(train.select("iid").distinct(), "iid", 12, K)
    mean = stats.global_mean(train, "y")
    out = score.score_factors(test, U, I, mean, bounds=(0.0, 5.0), k=K)
    return out.select("l_orderkey", "l_linenumber", "uid", "iid", r6("pred").alias("pred"), "is_cold")


# ---------------------------------------------------------------- JN-2 / JN-3
@query("gather_params", f"""WITH {SPLIT_SQL},
p AS (SELECT uid, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1 FROM (SELECT DISTINCT uid FROM ds WHERE split = 'train'))
SELECT uid, CAST(count(*) AS BIGINT) AS n, {s6('sum(p0)')} AS sum_p0, {s6('sum(p1)')} AS sum_p1
FROM ds JOIN p USING (uid) WHERE split = 'test' GROUP BY uid""")
def q_gather(spark, sf):
    d, train, test = _split(spark, sf)
    P = vec_table(train.select("uid").distinct(), "uid", 15, K)
    g = gather(test, P, "uid")
    return g.groupBy("uid").agg(cnt().alias("n"), r6(F.sum(F.col("vec")[0])).alias("sum_p0"),
                                r6(F.sum(F.col("vec")[1])).alias("sum_p1"))


@query("gather_cold_start", f"""WITH {SPLIT_SQL},
s AS (SELECT uid, {init_sql('uid', 13, 0)} AS b FROM (SELECT DISTINCT uid FROM ds WHERE split = 'train'))
SELECT l_orderkey, l_linenumber, ds.uid, {s6('COALESCE(s.b, 0.0)')} AS b, s.b IS NULL AS is_cold
FROM ds LEFT JOIN s ON ds.uid = s.uid WHERE split = 'test'""")
def q_cold(spark, sf):
    d, train, test = _split(spark, sf)
    s = scalar_table(train.select("uid").distinct(), "uid", 13)
    out = gather_cold_start(test, s, "uid", ["b"])
    return out.select("l_orderkey", "l_linenumber", "uid", r6("b").alias("b"), "is_cold")


# ---------------------------------------------------------------- SC-2
W_MLR = mat(K, 16, len(REALS))
_wx = _wx_sql(W_MLR, ZCOLS)


@query("score_mlr", f"""WITH {SPLIT_SQL}, {Z_SQL},
m AS (SELECT avg(y) AS w0 FROM ds WHERE split = 'train'),
tu AS (SELECT DISTINCT uid FROM ds WHERE split = 'train'),
ti AS (SELECT DISTINCT iid FROM ds WHERE split = 'train'),
s AS (SELECT uid, {init_sql('uid', 13, 0)} AS s, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1 FROM tu),
c AS (SELECT iid, {init_sql('iid', 14, 0)} AS c FROM ti),
z AS (SELECT ds.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM ds, st WHERE split = 'test')
SELECT l_orderkey, l_linenumber, z.uid,
  {s6(f"w0 + COALESCE(s.s, 0.0) + COALESCE(c.c, 0.0) + COALESCE(p0, 0.0) * ({_wx[0]}) + COALESCE(p1, 0.0) * ({_wx[1]})")} AS pred
FROM z LEFT JOIN s ON z.uid = s.uid LEFT JOIN c ON z.iid = c.iid, m""")
def q_score_mlr(spark, sf):
    d, train, test = _split(spark, sf)
    w0 = stats.global_mean(train, "y")
    st = prep.fit_zscore(train, REALS)
    z = prep.apply_zscore(test, st, REALS)
    tu, ti = train.select("uid").distinct(), train.select("iid").distinct()
    out = score.profile_score(
        z, K, w0, biases={"uid": (scalar_table(tu, "uid", 13), None),
                          "iid": (scalar_table(ti, "iid", 14), None)},
        profiled="uid", P=(vec_table(tu, "uid", 15, K), None), reals=REALS, Wr=W_MLR)
    return out.select("l_orderkey", "l_linenumber", "uid", r6("pred").alias("pred"))


# ---------------------------------------------------------------- SC-3
W_IPR_R = mat(K, 47, len(REALS))
_wxi = _wx_sql(W_IPR_R, ZCOLS)
_CAT_CODE = {"c_mktsegment": "m_code", "p_brand": "b_code", "o_orderpriority": "o_code",
             "l_returnflag": "r_code"}


def _encoded(spark, sf):
    return encode(dyads(spark, sf), DYAD_GUIDE, keep=["l_orderkey", "l_linenumber", "term"])


def _code_ids(enc, field):
    return enc.codes(field)


def _ipr_sql_reg(l):
    cats = " + ".join(init_sql(code, 43 + f, l) for f, code in enumerate(_CAT_CODE.values()))
    return f"({cats} + {_wxi[l]})"


IPR_W0 = 0.25


@query("score_ipr", f"""WITH {_CODES_SQL}, {Z_SQL},
z AS (SELECT enc.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM enc, st WHERE split = 'test')
SELECT l_orderkey, l_linenumber, CAST(u_code AS INTEGER) AS uid,
  {s6(f"{IPR_W0} + {init_sql('u_code', 40, 0)} + {init_sql('i_code', 41, 0)} + {init_sql('u_code', 42, 0)} * {_ipr_sql_reg(0)} + {init_sql('u_code', 42, 1)} * {_ipr_sql_reg(1)}")} AS pred
FROM z""")
def q_score_ipr(spark, sf):
    enc = _encoded(spark, sf)
    out = _ipr_formula_scores(enc, enc.frame.filter(F.col("split") == "test"))
    return out.select("l_orderkey", "l_linenumber", "uid", r6("pred").alias("pred"))


def _ipr_formula_scores(enc, rows, keep_parts=False):
    cards = enc.cards
    ids = {f: _code_ids(enc, f) for f in DYAD_GUIDE.fields}
    return score.profile_score(
        rows, K, IPR_W0,
        biases={"uid": (scalar_table(ids["uid"], "uid", 40), cards["uid"]),
                "iid": (scalar_table(ids["iid"], "iid", 41), cards["iid"])},
        profiled="uid", P=(vec_table(ids["uid"], "uid", 42, K), cards["uid"]),
        Wcat={f: (vec_table(ids[f], f, 43 + i, K, name="wvec"), cards[f]) for i, f in enumerate(CATS)},
        reals=REALS, Wr=W_IPR_R, keep_parts=keep_parts)


# ---------------------------------------------------------------- SC-4
FM_W0 = 0.1
FM_FIELDS = ["uid", "iid", *CATS]
_FM_CODE = ["u_code", "i_code", *_CAT_CODE.values()]
FM_WR = mat(1, 56, len(REALS))[0]
FM_VR = mat(K, 66, len(REALS)).T  # r x k


def _fm_sql_pred():
    lin = " + ".join([str(FM_W0)] + [init_sql(c, 50 + f, 0) for f, c in enumerate(_FM_CODE)]
                     + [f"({float(FM_WR[j])!r}) * z{j}" for j in range(len(REALS))])
    two = []
    for l in range(K):
        vs = [init_sql(c, 60 + f, l) for f, c in enumerate(_FM_CODE)] + \
             [f"({float(FM_VR[j, l])!r}) * z{j}" for j in range(len(REALS))]
        q = " + ".join(vs)
        sq = " + ".join(f"({v}) * ({v})" for v in vs)
        two.append(f"(({q}) * ({q}) - ({sq}))")
    return f"{lin} + 0.5 * ({' + '.join(two)})"


@query("score_fm", f"""WITH {_CODES_SQL}, {Z_SQL},
z AS (SELECT enc.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM enc, st WHERE split = 'test')
SELECT l_orderkey, l_linenumber, CAST(u_code AS INTEGER) AS uid, {s6(_fm_sql_pred())} AS pred FROM z""")
def q_score_fm(spark, sf):
    enc = _encoded(spark, sf)
    rows = enc.frame.filter(F.col("split") == "test")
    out = _fm_formula_scores(enc, rows)
    return out.select("l_orderkey", "l_linenumber", "uid", r6("pred").alias("pred"))


def fm_formula_tables(enc):
    tabs = {}
    for f, name in enumerate(FM_FIELDS):
        ids = _code_ids(enc, name)
        t = vec_table(ids, name, 60 + f, K).join(scalar_table(ids, name, 50 + f, name="w"), name)
        tabs[name] = (t, enc.cards[name])
    return tabs


def _fm_formula_scores(enc, rows, keep_parts=False):
    return score.fm_score(rows, K, FM_W0, fm_formula_tables(enc), REALS, FM_WR, FM_VR, keep_parts)


# ---------------------------------------------------------------- SC-5
ALPHA_G = 4.0
SHARED_P = mat(1, 17, K)[0]


@query("score_bpmlr", f"""WITH {SPLIT_SQL}, {Z_SQL},
tu AS (SELECT DISTINCT uid FROM ds WHERE split = 'train'),
ti AS (SELECT DISTINCT iid FROM ds WHERE split = 'train'),
s AS (SELECT uid, {init_sql('uid', 13, 0)} AS s, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1 FROM tu),
c AS (SELECT iid, {init_sql('iid', 14, 0)} AS c FROM ti),
z AS (SELECT ds.*, {', '.join(f'{z} AS z{j}' for j, z in enumerate(ZCOLS))} FROM ds, st WHERE split = 'test'),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, z.uid,
        COALESCE(s.s, 0.0) + COALESCE(c.c, 0.0) + COALESCE(p0, 0.0) * ({_wx[0]}) + COALESCE(p1, 0.0) * ({_wx[1]}) AS full_mean,
        COALESCE(p0, 0.0) * ({_wx[0]}) + COALESCE(p1, 0.0) * ({_wx[1]}) AS nb_mean,
        COALESCE(s.s, 0.0) + COALESCE(c.c, 0.0) + ({float(SHARED_P[0])!r}) * ({_wx[0]}) + ({float(SHARED_P[1])!r}) * ({_wx[1]}) AS np_mean
      FROM z LEFT JOIN s ON z.uid = s.uid LEFT JOIN c ON z.iid = c.iid)
SELECT l_orderkey, l_linenumber, uid, {s6('full_mean')} AS pred_full, {s6('nb_mean')} AS pred_nb,
       {s6('np_mean')} AS pred_np FROM r""")
def q_score_bpmlr(spark, sf):
    return _bpmlr_means(spark, sf).drop("l_partkey")


def _bpmlr_means(spark, sf):
    d, train, test = _split(spark, sf)
    st = prep.fit_zscore(train, REALS)
    z = prep.apply_zscore(test, st, REALS)
    tu, ti = train.select("uid").distinct(), train.select("iid").distinct()
    b = {"uid": (scalar_table(tu, "uid", 13), None), "iid": (scalar_table(ti, "iid", 14), None)}
    P = (vec_table(tu, "uid", 15, K), None)
    full = score.profile_score(z, K, 0.0, b, "uid", P, reals=REALS, Wr=W_MLR).withColumnRenamed("pred", "pred_full")
    nb = score.profile_score(full, K, 0.0, None, "uid", P, reals=REALS, Wr=W_MLR).withColumnRenamed("pred", "pred_nb")
    npm = score.profile_score(nb, K, 0.0, b, shared_p=SHARED_P, reals=REALS, Wr=W_MLR).withColumnRenamed("pred", "pred_np")
    return npm.select("l_orderkey", "l_linenumber", "l_partkey", "uid", *[r6(c).alias(c) for c in ("pred_full", "pred_nb", "pred_np")])


def _draw_sql():
    import math
    base = ORACLES["score_bpmlr"]
    head, sel = base.rsplit("SELECT l_orderkey, l_linenumber, uid,", 1)
    u1 = crng_uniform_sql("l_orderkey", 91, ROW_DRAW_SQL)
    u2 = crng_uniform_sql("l_orderkey", 92, ROW_DRAW_SQL)
    z = f"sqrt(-2.0 * ln(GREATEST({u1}, 1e-300))) * cos({2 * math.pi!r} * {u2})"
    return (head + f"""SELECT l_orderkey, l_linenumber, uid, {s6('full_mean')} AS pred_full, {s6('nb_mean')} AS pred_nb,
       {s6('np_mean')} AS pred_np, {s6(f"{s6('full_mean')} + {ALPHA_G ** -0.5!r} * {z}")} AS pred_draw FROM r""")


@query("score_bpmlr_draw", _draw_sql())
def q_score_bpmlr_draw(spark, sf):
    """Posterior-predictive draw N(mean, alpha_G^-1/2) per row (stat check:
    rows only; the mean is checked by score_bpmlr)."""
    base = _bpmlr_means(spark, sf)
    return base.withColumn("pred_draw", r6(score.gaussian_draw(
        F.col("pred_full"), ALPHA_G ** -0.5, "l_orderkey", 91, row_draw()))).drop("l_partkey")
