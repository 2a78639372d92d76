"""Registered source / sink round trips (SRC-1..4, SNK-1/2): each writes
Spark-derived data from the shared tables into the scratch area of the
checkpoint folder and reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators import prep, stats
from dyadic.plans.common import cnt, r2, r6, s2, s6
from dyadic.plans.params import init_sql, vec_table, scalar_table
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import D_SQL, SPLIT_SQL, query
from dyadic.session import scratch_path
from dyadic.sources.scans import guided_scan, keyed_scan, triplet_scan
from dyadic.sources.sinks import dyad_sink, param_load, param_save, warm_start
from dyadic.sources.tables import DYAD_GUIDE, dyads


@query("triplet_scan", f"""WITH {D_SQL}
SELECT uid, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_target FROM d GROUP BY uid""")
def q_triplets(spark, sf):
    path = scratch_path(spark, "triplets")
    d = dyads(spark, sf)
    d.select((F.col("uid") + 1).alias("u"), (F.col("iid") + 1).alias("i"), "y").write.csv(path)
    t = triplet_scan(spark, path, "uid", "iid", "target")
    return t.groupBy("uid").agg(cnt().alias("n"), r6(F.sum("target")).alias("sum_target"))


@query("guided_scan", f"""WITH {D_SQL}
SELECT term, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_y, {s6('sum(l_discount)')} AS sum_discount,
       CAST(count(DISTINCT uid) AS BIGINT) AS users FROM d GROUP BY term""")
def q_guided(spark, sf):
    path = scratch_path(spark, "dyads")
    dyad_sink(dyads(spark, sf).select("term", *DYAD_GUIDE.columns), path, partition_by="term")
    g = guided_scan(spark, path, DYAD_GUIDE, extra=("term",))
    return g.groupBy("term").agg(cnt().alias("n"), r6(F.sum("y")).alias("sum_y"),
                                 r6(F.sum("l_discount")).alias("sum_discount"),
                                 F.countDistinct("uid").cast("long").alias("users"))


@query("dyad_sink", f"""WITH {D_SQL},
x AS (SELECT term, CASE WHEN l_tax = 0 THEN 0.0 WHEN l_discount = 0 THEN 0.0
                        WHEN l_returnflag = 'R' THEN 0.0 ELSE l_tax / l_discount END AS v FROM d)
SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero,
       {s6('sum(v)')} AS sum_v FROM x GROUP BY term""")
def q_sink(spark, sf):
    path = scratch_path(spark, "sink")
    d = dyads(spark, sf)
    raw = d.select("term", F.when(F.col("l_tax") == 0, F.lit(float("inf")))
                           .when(F.col("l_discount") == 0, F.lit(float("-inf")))
                           .when(F.col("l_returnflag") == "R", F.lit(float("nan")))
                           .otherwise(F.col("l_tax") / F.col("l_discount")).alias("v"))
    dyad_sink(raw, path, partition_by="term", fmt="csv")
    back = spark.read.option("header", "true").schema("v double, term long").csv(path)
    return back.groupBy("term").agg(cnt().alias("n"),
                                    F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).cast("long").alias("n_zero"),
                                    r6(F.sum("v")).alias("sum_v"))


@query("keyed_scan", f"""WITH {D_SQL}
SELECT uid, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_target, {s6('sum(l_discount)')} AS f0,
       {s6('sum(l_tax)')} AS f1, {s2('sum(p_retailprice)')} AS f2 FROM d GROUP BY uid""")
def q_keyed(spark, sf):
    path = scratch_path(spark, "keyed")
    d = dyads(spark, sf)
    d.select("uid", "iid", F.col("y").alias("target"), "l_discount", "l_tax", "p_retailprice").write.parquet(path)
    k = keyed_scan(spark, path)
    feats = prep.feature_columns(k, ["uid", "iid"], "target")
    x = prep.design_projection(k, "uid", "iid", "target", feats)
    return x.groupBy("uid").agg(cnt().alias("n"), r6(F.sum("target")).alias("sum_target"),
                                r6(F.sum(F.col("x")[0])).alias("f0"), r6(F.sum(F.col("x")[1])).alias("f1"),
                                r2(F.sum(F.col("x")[2])).alias("f2"))


_W0_SQL = "(SELECT avg(y) FROM ds WHERE split = 'train')"
# 2 x 2 inverse of the sample covariance of (p0, p1)
_INV = "({num}) / (covar_samp(p0, p0) * covar_samp(p1, p1) - covar_samp(p0, p1) * covar_samp(p1, p0))"

_PARAM_SQL = f"""{SPLIT_SQL},
tu AS (SELECT DISTINCT uid FROM ds WHERE split = 'train'),
p AS (SELECT uid, {init_sql('uid', 15, 0)} AS p0, {init_sql('uid', 15, 1)} AS p1, {init_sql('uid', 13, 0)} AS s FROM tu)"""


def _save_params(spark, sf):
    train, _ = hold_out(held_dyads(spark, sf))
    tu = train.select("uid").distinct()
    path = scratch_path(spark, "params")
    mean = stats.global_mean(train, "y")
    param_save(spark, {"P": vec_table(tu, "uid", 15, 2), "s": scalar_table(tu, "uid", 13),
                       "w0": float(mean), "k": 2}, path)
    return path


@query("param_save_load", f"""WITH {_PARAM_SQL}
SELECT 'P' AS param, CAST(count(*) AS BIGINT) AS n, {s6('sum(p0 + p1)')} AS total FROM p
UNION ALL SELECT 's', count(*), {s6('sum(s)')} FROM p
UNION ALL SELECT 'w0', 1, {s6(_W0_SQL)}
UNION ALL SELECT 'k', 1, 2.0""")
def q_params(spark, sf):
    path = _save_params(spark, sf)
    loaded = param_load(spark, path)
    try:  # an existing folder is refused unless overwrite is asked for
        param_save(spark, {"w0": 0.0}, path)
        raise AssertionError("existing model folder was overwritten")
    except FileExistsError:
        pass
    P, s = loaded["P"], loaded["s"]
    rows = [("w0", 1, round(float(loaded["w0"]), 6) + 0.0), ("k", 1, float(loaded["k"]))]
    tail = spark.createDataFrame(rows, "param string, n long, total double")
    return (P.agg(F.lit("P").alias("param"), cnt().alias("n"),
                  r6(F.sum(F.col("vec")[0] + F.col("vec")[1])).alias("total"))
             .unionByName(s.agg(F.lit("s").alias("param"), cnt().alias("n"), r6(F.sum("b")).alias("total")))
             .unionByName(tail))


@query("warm_start", f"""WITH {_PARAM_SQL}
SELECT 'cov' AS stat, 0 AS i, 0 AS j, {s6('covar_samp(p0, p0)')} AS value FROM p
UNION ALL SELECT 'cov', 0, 1, {s6('covar_samp(p0, p1)')} FROM p
UNION ALL SELECT 'cov', 1, 0, {s6('covar_samp(p1, p0)')} FROM p
UNION ALL SELECT 'cov', 1, 1, {s6('covar_samp(p1, p1)')} FROM p
UNION ALL SELECT 'mean', 0, 0, {s6('avg(p0)')} FROM p
UNION ALL SELECT 'mean', 1, 0, {s6('avg(p1)')} FROM p
UNION ALL SELECT 'prec', 0, 0, {s6(_INV.format(num='covar_samp(p1, p1)'))} FROM p
UNION ALL SELECT 'prec', 0, 1, {s6(_INV.format(num='-covar_samp(p0, p1)'))} FROM p
UNION ALL SELECT 'prec', 1, 0, {s6(_INV.format(num='-covar_samp(p1, p0)'))} FROM p
UNION ALL SELECT 'prec', 1, 1, {s6(_INV.format(num='covar_samp(p0, p0)'))} FROM p""")
def q_warm(spark, sf):
    path = _save_params(spark, sf)
    nu = hold_out(dyads(spark, sf))[0].select("uid").distinct().count()
    params = warm_start(spark, path, {"P": (nu, 2), "s": (nu, None)})
    P = params["P"]
    cov = stats.covariance_matrix(P, "vec", 2).select(
        F.lit("cov").alias("stat"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
        r6("cov").alias("value"))
    mean = stats.vector_mean(P, "vec").select(F.lit("mean").alias("stat"), F.col("pos").cast("int").alias("i"),
                                              F.lit(0).alias("j"), r6("mean").alias("value"))
    # precision = inverse covariance: a k x k matrix, inverted on the driver
    import numpy as np
    C = np.zeros((2, 2))
    for r in stats.covariance_matrix(P, "vec", 2).collect():
        C[r["i"], r["j"]] = r["cov"]
    L = np.linalg.inv(C)
    prec = spark.createDataFrame([("prec", i, j, round(float(L[i, j]), 6) + 0.0) for i in range(2) for j in range(2)],
                                 "stat string, i int, j int, value double")
    return cov.unionByName(mean).unionByName(prec)


@query("read_train_test", f"""WITH {SPLIT_SQL}
SELECT split, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_y, {s6('sum(l_tax)')} AS sum_tax,
       CAST(count(DISTINCT iid) AS BIGINT) AS items FROM ds GROUP BY split""")
def q_read_train_test(spark, sf):
    """Train and test written as separate guided files, read back as one
    frame with a split label (SRC-2 read_train_test)."""
    from dyadic.sources.scans import read_train_test
    d = held_dyads(spark, sf)
    train, test = hold_out(d)
    base = scratch_path(spark, "train-test")
    cols = ["term", *DYAD_GUIDE.columns]
    dyad_sink(train.select(*cols), f"{base}/train", partition_by="term")
    dyad_sink(test.select(*cols), f"{base}/test", partition_by="term")
    both = read_train_test(spark, f"{base}/train", f"{base}/test", DYAD_GUIDE)
    return both.groupBy("split").agg(cnt().alias("n"), r6(F.sum("y")).alias("sum_y"),
                                     r6(F.sum("l_tax")).alias("sum_tax"),
                                     F.countDistinct("iid").cast("long").alias("items"))
