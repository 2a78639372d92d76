"""Registered queries: scans, projections, filters, joins, aggregates,
windows, sorts and reshaping over the shared tables (views D and E)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from dyadic.functions.crng import MOD, crng_uniform_sql
from dyadic.functions.scalar import bin_levels, clip, nonfinite_to_zero, squared_features
from dyadic.operators import prep, stats, term_state, windows
from dyadic.operators.encode import contiguous_ids, encode, encode_ids, long_design
from dyadic.operators.reshape import rating_blocks, sparse_entries, unpivot_stats
from dyadic.plans.common import ROW_DRAW_SQL, cnt, r2, r6, row_draw, s2, s6
from dyadic.plans.common import held_dyads
from dyadic.plans.common import hold_out
from dyadic.plans.registry import D_SQL, E_SQL, ORACLES, SPLIT_SQL, query
from dyadic.session import scratch_path
from dyadic.sources.tables import DYAD_GUIDE, ROW_KEY, dyads, events_dyads, table

UR_SEED = 1234
LO, HI = 0.0, 4.0


# ---------------------------------------------------------------- flagship
def _gm_ur(spark: SparkSession, sf: str):
    d = dyads(spark, sf)
    train, test = hold_out(d)
    gm = stats.global_mean(train, "y")
    t = stats.baseline_predictions(test, gm, "l_orderkey", row_draw(), LO, HI, UR_SEED)
    agg = t.agg(stats.rmse_expr("y", "pred_gm").alias("gm"),
                stats.rmse_expr("y", "pred_ur").alias("ur"), cnt().alias("n"))
    return agg.select(F.explode(F.array(
        F.struct(F.lit("GM").alias("model"), r6("gm").alias("rmse"), F.col("n")),
        F.struct(F.lit("UR").alias("model"), r6("ur").alias("rmse"), F.col("n")))).alias("r")
    ).select("r.*")


GM_UR_SQL = f"""WITH {SPLIT_SQL},
gm AS (SELECT avg(y) AS m FROM ds WHERE split = 'train'),
t AS (SELECT y, (SELECT m FROM gm) AS pred_gm,
             {LO} + {crng_uniform_sql('l_orderkey', UR_SEED, ROW_DRAW_SQL)} * {HI - LO} AS pred_ur
      FROM ds WHERE split = 'test')
SELECT 'GM' AS model, {s6('sqrt(avg((y - pred_gm) * (y - pred_gm)))')} AS rmse, CAST(count(*) AS BIGINT) AS n FROM t
UNION ALL
SELECT 'UR' AS model, {s6('sqrt(avg((y - pred_ur) * (y - pred_ur)))')} AS rmse, CAST(count(*) AS BIGINT) AS n FROM t"""

query("baseline_rmse", GM_UR_SQL)(_gm_ur)


# ---------------------------------------------------------------- joins
@query("enrich_dyads", """SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS uid, l.l_partkey AS iid,
  c.c_mktsegment, p.p_brand, c.c_acctbal, p.p_retailprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def q_enrich(spark, sf):
    d = dyads(spark, sf, how="left")
    return d.select("l_orderkey", "l_linenumber", "uid", "iid", "c_mktsegment", "p_brand",
                    "c_acctbal", "p_retailprice")


# ---------------------------------------------------------------- filters
@query("temporal_holdout", f"""WITH {SPLIT_SQL}
SELECT split, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_y,
       min(term) AS min_term, max(term) AS max_term
FROM ds GROUP BY split""")
def q_holdout(spark, sf):
    d = dyads(spark, sf)
    train, test = hold_out(d)
    def summ(df, name):
        return df.agg(F.lit(name).alias("split"), cnt().alias("n"), r6(F.sum("y")).alias("sum_y"),
                      F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return summ(train, "train").unionByName(summ(test, "test"))


@query("observed_mask", f"""WITH {D_SQL}
SELECT term, CAST(count(*) AS BIGINT) AS n, {s6('sum(l_discount * 10.0)')} AS sum_rating
FROM d WHERE l_discount * 10.0 > 0 GROUP BY term""")
def q_observed(spark, sf):
    t = dyads(spark, sf).select("term", (F.col("l_discount") * 10.0).alias("rating"))
    return (prep.observed_mask(t, "rating", positive_only=True)
            .groupBy("term").agg(cnt().alias("n"), r6(F.sum("rating")).alias("sum_rating")))


# ---------------------------------------------------------------- projections
@query("design_projection", f"""WITH {D_SQL}
SELECT term, CAST(count(*) AS BIGINT) AS n, {s6('sum(y)')} AS sum_y,
  {s6('sum(l_discount)')} AS x0, {s6('sum(l_tax)')} AS x1,
  {s2('sum(p_retailprice)')} AS x2, {s2('sum(c_acctbal)')} AS x3
FROM d GROUP BY term""")
def q_design(spark, sf):
    d = dyads(spark, sf).select("uid", "iid", "y", "term", *DYAD_GUIDE.reals)
    feats = prep.feature_columns(d, ["uid", "iid", "term"], "y")
    x = prep.design_projection(d, "uid", "iid", "y", feats, keep=["term"])
    return x.groupBy("term").agg(cnt().alias("n"), r6(F.sum("y")).alias("sum_y"),
                                 *[(r6 if i < 2 else r2)(F.sum(F.col("x")[i])).alias(f"x{i}")
                                   for i in range(len(feats))])


@query("add_squared_features", f"""WITH {D_SQL}
SELECT term, {s6('sum(l_discount * l_discount)')} AS sq_discount,
  {s6('sum(l_tax * l_tax)')} AS sq_tax, {s2('avg(p_retailprice * p_retailprice)')} AS sq_price
FROM d GROUP BY term""")
def q_squares(spark, sf):
    d, names = squared_features(dyads(spark, sf), ["l_discount", "l_tax", "p_retailprice"])
    return d.groupBy("term").agg(r6(F.sum(F.col(f"`{names[0]}`"))).alias("sq_discount"),
                                 r6(F.sum(F.col(f"`{names[1]}`"))).alias("sq_tax"),
                                 r2(F.avg(F.col(f"`{names[2]}`"))).alias("sq_price"))


@query("clip_target", f"""WITH {D_SQL}
SELECT term, {s6('sum(LEAST(4.0, GREATEST(0.5, y)))')} AS sum_clipped,
  CAST(sum(CASE WHEN y > 4.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_hi,
  CAST(sum(CASE WHEN y < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_lo
FROM d GROUP BY term""")
def q_clip(spark, sf):
    d = dyads(spark, sf)
    return d.groupBy("term").agg(
        r6(F.sum(clip("y", 0.5, 4.0))).alias("sum_clipped"),
        F.sum(F.when(F.col("y") > 4.0, 1).otherwise(0)).cast("long").alias("n_hi"),
        F.sum(F.when(F.col("y") < 0.5, 1).otherwise(0)).cast("long").alias("n_lo"))


@query("bin_levels", f"""WITH {D_SQL}
SELECT CASE WHEN l_quantity * 4.5 >= 0 AND l_quantity * 4.5 <= 30 THEN 0
            WHEN l_quantity * 4.5 > 30 AND l_quantity * 4.5 <= 60 THEN 1
            WHEN l_quantity * 4.5 > 60 AND l_quantity * 4.5 <= 90 THEN 2
            WHEN l_quantity * 4.5 > 90 AND l_quantity * 4.5 <= 120 THEN 3
            WHEN l_quantity * 4.5 > 120 AND l_quantity * 4.5 <= 200 THEN 4 END AS level,
       CAST(count(*) AS BIGINT) AS n
FROM d GROUP BY 1""")
def q_bins(spark, sf):
    d = dyads(spark, sf)
    return d.groupBy(bin_levels(F.col("l_quantity") * 4.5).alias("level")).agg(cnt().alias("n"))


@query("nonfinite_to_zero", f"""WITH {D_SQL},
x AS (SELECT term, CASE WHEN l_tax = 0 THEN 0.0 WHEN l_discount = 0 THEN 0.0
                        WHEN l_returnflag = 'R' THEN 0.0 ELSE l_tax / l_discount END AS v FROM d)
SELECT term, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero,
       {s6('sum(v)')} AS sum_v FROM x GROUP BY term""")
def q_nonfinite(spark, sf):
    d = dyads(spark, sf)
    raw = d.select("term", F.when(F.col("l_tax") == 0, F.lit(float("inf")))
                           .when(F.col("l_discount") == 0, F.lit(float("-inf")))
                           .when(F.col("l_returnflag") == "R", F.lit(float("nan")))
                           .otherwise(F.col("l_tax") / F.col("l_discount")).alias("v"))
    clean = nonfinite_to_zero(raw)
    return clean.groupBy("term").agg(
        F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).cast("long").alias("n_zero"),
        r6(F.sum("v")).alias("sum_v"))


_Z_SQL = f"""WITH {SPLIT_SQL},
st AS (SELECT avg(l_discount) AS m1, stddev_pop(l_discount) AS s1, avg(p_retailprice) AS m2,
              stddev_pop(p_retailprice) AS s2, avg(c_acctbal) AS m3, stddev_pop(c_acctbal) AS s3
       FROM ds WHERE split = 'train'),
z AS (SELECT split, (l_discount - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS z1,
             (p_retailprice - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END AS z2,
             (c_acctbal - m3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END AS z3
      FROM ds, st)
SELECT split, CAST(count(*) AS BIGINT) AS n, {s6('sum(z1)')} AS sum_z1, {s6('sum(z1 * z1)')} AS ss_z1,
       {s6('sum(z2)')} AS sum_z2, {s6('sum(z2 * z2)')} AS ss_z2,
       {s6('sum(z3)')} AS sum_z3, {s6('sum(z3 * z3)')} AS ss_z3
FROM z GROUP BY split"""


@query("zscore", _Z_SQL)
def q_zscore(spark, sf):
    d = prep.with_split(dyads(spark, sf))
    reals = ["l_discount", "p_retailprice", "c_acctbal"]
    st = prep.fit_zscore(d.filter(F.col("split") == "train"), reals)
    z = prep.apply_zscore(d, st, reals)
    aggs = [cnt().alias("n")]
    for i, r in enumerate(reals, 1):
        aggs += [r6(F.sum(r)).alias(f"sum_z{i}"), r6(F.sum(F.col(r) * F.col(r))).alias(f"ss_z{i}")]
    return z.groupBy("split").agg(*aggs)


# ---------------------------------------------------------------- set ops
@query("union_ids", f"""WITH {SPLIT_SQL}
SELECT DISTINCT 'uid' AS field, uid AS id FROM ds UNION ALL SELECT DISTINCT 'iid', iid FROM ds""")
def q_union_ids(spark, sf):
    train, test = hold_out(dyads(spark, sf))
    u, i = (prep.union_ids(train, test, c).select(F.lit(c).alias("field"), F.col(c).alias("id")) for c in ("uid", "iid"))
    return u.unionByName(i)


@query("union_train_test", f"""WITH {SPLIT_SQL}
SELECT split, term, CAST(count(*) AS BIGINT) AS n FROM ds GROUP BY split, term""")
def q_union_tt(spark, sf):
    train, test = hold_out(dyads(spark, sf))
    return prep.union_train_test(train, test).groupBy("split", "term").agg(cnt().alias("n"))


def _staged_terms(spark, sf):
    """View E, written once with a folder per term."""
    path = scratch_path(spark, "terms")
    events_dyads(spark, sf).write.partitionBy("term").parquet(path)
    return path


def _terms_of(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).select("term").distinct().collect())


@query("append_terms", f"""WITH {E_SQL}
SELECT term, CAST(count(*) AS BIGINT) AS n, {s6('sum(grade)')} AS sum_grade FROM e GROUP BY term""")
def q_append(spark, sf):
    # each term is a folder of its own; all that have been appended are one scan
    acc = spark.read.parquet(_staged_terms(spark, sf)).withColumn("term", F.col("term").cast("long"))
    return acc.groupBy("term").agg(cnt().alias("n"), r6(F.sum("grade")).alias("sum_grade"))


# ---------------------------------------------------------------- encoding
_IDS_SQL = """SELECT 'uid' AS field, uid AS id, CAST(dense_rank() OVER (ORDER BY uid) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT uid FROM d)
UNION ALL
SELECT 'iid', iid, CAST(dense_rank() OVER (ORDER BY iid) - 1 AS BIGINT) FROM (SELECT DISTINCT iid FROM d)"""


@query("contiguous_ids", f"WITH {D_SQL} {_IDS_SQL}")
def q_contig(spark, sf):
    d = dyads(spark, sf)
    u, i = (contiguous_ids(d, c).select(F.lit(c).alias("field"), F.col(c).alias("id"), "idx") for c in ("uid", "iid"))
    return u.unionByName(i)


_CODES_SQL = f"""{SPLIT_SQL},
cu AS (SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS c FROM (SELECT DISTINCT uid FROM ds)),
ci AS (SELECT iid, dense_rank() OVER (ORDER BY iid) - 1 AS c FROM (SELECT DISTINCT iid FROM ds)),
cm AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c FROM (SELECT DISTINCT c_mktsegment FROM ds)),
cb AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS c FROM (SELECT DISTINCT p_brand FROM ds)),
co AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS c FROM (SELECT DISTINCT o_orderpriority FROM ds)),
cr AS (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS c FROM (SELECT DISTINCT l_returnflag FROM ds)),
card AS (SELECT (SELECT count(*) FROM cu) AS nu, (SELECT count(*) FROM ci) AS ni,
                (SELECT count(*) FROM cm) AS nm, (SELECT count(*) FROM cb) AS nb,
                (SELECT count(*) FROM co) AS no, (SELECT count(*) FROM cr) AS nr),
enc AS (SELECT ds.*, cu.c AS u_code, ci.c AS i_code, cm.c AS m_code, cb.c AS b_code, co.c AS o_code, cr.c AS r_code
        FROM ds JOIN cu USING (uid) JOIN ci USING (iid) JOIN cm USING (c_mktsegment)
        JOIN cb USING (p_brand) JOIN co USING (o_orderpriority) JOIN cr USING (l_returnflag))"""


@query("one_hot_encode", f"""WITH {_CODES_SQL},
idx AS (SELECT u_code AS idx FROM enc
        UNION ALL SELECT nu + i_code FROM enc, card
        UNION ALL SELECT nu + ni + m_code FROM enc, card
        UNION ALL SELECT nu + ni + nm + b_code FROM enc, card
        UNION ALL SELECT nu + ni + nm + nb + o_code FROM enc, card
        UNION ALL SELECT nu + ni + nm + nb + no + r_code FROM enc, card)
SELECT CAST(idx AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS n FROM idx GROUP BY idx""")
def q_onehot(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    ld = long_design(enc)
    nb_cat = enc.ranges[len(DYAD_GUIDE.fields) - 1][3]
    return ld.filter(F.col("idx") < nb_cat).groupBy("idx").agg(cnt().alias("n"))


@query("assemble_design", f"""WITH {_CODES_SQL},
st AS (SELECT avg(l_discount) AS m1, stddev_pop(l_discount) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2,
              avg(p_retailprice) AS m3, stddev_pop(p_retailprice) AS s3, avg(c_acctbal) AS m4, stddev_pop(c_acctbal) AS s4
       FROM ds WHERE split = 'train'),
base AS (SELECT nu + ni + nm + nb + no + nr AS b FROM card),
vals AS (SELECT split, b AS idx, (l_discount - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END AS v FROM enc, st, base
  UNION ALL SELECT split, b + 1, (l_tax - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END FROM enc, st, base
  UNION ALL SELECT split, b + 2, (p_retailprice - m3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END FROM enc, st, base
  UNION ALL SELECT split, b + 3, (c_acctbal - m4) / CASE WHEN s4 = 0 THEN 1.0 ELSE s4 END FROM enc, st, base
  UNION ALL SELECT split, u_code, 1.0 FROM enc
  UNION ALL SELECT split, nu + i_code, 1.0 FROM enc, card
  UNION ALL SELECT split, nu + ni + m_code, 1.0 FROM enc, card
  UNION ALL SELECT split, nu + ni + nm + b_code, 1.0 FROM enc, card
  UNION ALL SELECT split, nu + ni + nm + nb + o_code, 1.0 FROM enc, card
  UNION ALL SELECT split, nu + ni + nm + nb + no + r_code, 1.0 FROM enc, card)
SELECT split, CAST(idx AS BIGINT) AS idx, CAST(count(*) AS BIGINT) AS n, {s6('sum(v)')} AS sum_value,
       {s6('sum(v * v)')} AS sum_sq
FROM vals GROUP BY split, idx""")
def q_assemble(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    ld = long_design(enc)
    return ld.groupBy("split", "idx").agg(
        cnt().alias("n"), r6(F.sum("value")).alias("sum_value"),
        r6(F.sum(F.col("value") * F.col("value"))).alias("sum_sq"))


_RANGES_SQL = f"""WITH {_CODES_SQL}
SELECT 'uid' AS feature, 'entity' AS kind, CAST(0 AS BIGINT) AS start, CAST(nu AS BIGINT) AS "end" FROM card
UNION ALL SELECT 'iid', 'entity', nu, nu + ni FROM card
UNION ALL SELECT 'c_mktsegment', 'categorical', nu + ni, nu + ni + nm FROM card
UNION ALL SELECT 'p_brand', 'categorical', nu + ni + nm, nu + ni + nm + nb FROM card
UNION ALL SELECT 'o_orderpriority', 'categorical', nu + ni + nm + nb, nu + ni + nm + nb + no FROM card
UNION ALL SELECT 'l_returnflag', 'categorical', nu + ni + nm + nb + no, nu + ni + nm + nb + no + nr FROM card
UNION ALL SELECT 'l_discount', 'real', nu + ni + nm + nb + no + nr, nu + ni + nm + nb + no + nr + 1 FROM card
UNION ALL SELECT 'l_tax', 'real', nu + ni + nm + nb + no + nr + 1, nu + ni + nm + nb + no + nr + 2 FROM card
UNION ALL SELECT 'p_retailprice', 'real', nu + ni + nm + nb + no + nr + 2, nu + ni + nm + nb + no + nr + 3 FROM card
UNION ALL SELECT 'c_acctbal', 'real', nu + ni + nm + nb + no + nr + 3, nu + ni + nm + nb + no + nr + 4 FROM card"""


@query("feature_ranges", _RANGES_SQL)
def q_ranges(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    return enc.feature_ranges(spark)


@query("field_cardinality", f"""WITH {D_SQL},
c AS (SELECT count(DISTINCT uid) AS nu, count(DISTINCT iid) AS ni, count(DISTINCT c_mktsegment) AS nm,
             count(DISTINCT p_brand) AS nb, count(DISTINCT o_orderpriority) AS no, count(DISTINCT l_returnflag) AS nr FROM d)
SELECT 'uid' AS field, CAST(nu AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS start, CAST(nu AS BIGINT) AS "end" FROM c
UNION ALL SELECT 'iid', ni, nu, nu + ni FROM c
UNION ALL SELECT 'c_mktsegment', nm, nu + ni, nu + ni + nm FROM c
UNION ALL SELECT 'p_brand', nb, nu + ni + nm, nu + ni + nm + nb FROM c
UNION ALL SELECT 'o_orderpriority', no, nu + ni + nm + nb, nu + ni + nm + nb + no FROM c
UNION ALL SELECT 'l_returnflag', nr, nu + ni + nm + nb + no, nu + ni + nm + nb + no + nr FROM c""")
def q_cards(spark, sf):
    rows = stats.field_cardinality(dyads(spark, sf), DYAD_GUIDE.fields)
    return spark.createDataFrame(rows, "field string, n_values long, start long, `end` long")


@query("encode_ids", f"""WITH {D_SQL},
cu AS (SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS c FROM (SELECT DISTINCT uid FROM d)),
ci AS (SELECT iid, dense_rank() OVER (ORDER BY iid) - 1 AS c FROM (SELECT DISTINCT iid FROM d))
SELECT d.l_orderkey, d.l_linenumber, CAST(cu.c AS BIGINT) AS uid, CAST(ci.c AS BIGINT) AS iid
FROM d JOIN cu USING (uid) JOIN ci USING (iid)""")
def q_encode_ids(spark, sf):
    d = out = dyads(spark, sf)
    for c in ("uid", "iid"):
        out = encode_ids(out, contiguous_ids(d, c).withColumnRenamed("idx", f"{c}__code"), c)
    return out.select("l_orderkey", "l_linenumber", "uid", "iid")


# ---------------------------------------------------------------- aggregates
@query("entity_counts", f"""WITH {SPLIT_SQL}
SELECT 'uid' AS field, uid AS id, CAST(count(*) AS BIGINT) AS n FROM ds WHERE split = 'train' GROUP BY uid
UNION ALL SELECT 'iid', iid, CAST(count(*) AS BIGINT) FROM ds WHERE split = 'train' GROUP BY iid""")
def q_entity_counts(spark, sf):
    train, _ = hold_out(held_dyads(spark, sf))
    u, i = (stats.entity_counts(train, c).select(F.lit(c).alias("field"), F.col(c).alias("id"), "n") for c in ("uid", "iid"))
    return u.unionByName(i)


_PART_LEVEL_SQL = """CASE WHEN p_size * 4 >= 0 AND p_size * 4 <= 30 THEN 0
            WHEN p_size * 4 > 30 AND p_size * 4 <= 60 THEN 1
            WHEN p_size * 4 > 60 AND p_size * 4 <= 90 THEN 2
            WHEN p_size * 4 > 90 AND p_size * 4 <= 120 THEN 3
            WHEN p_size * 4 > 120 AND p_size * 4 <= 200 THEN 4 END"""


def _part_levels(spark, sf):
    return table(spark, sf, "part").select("p_partkey", bin_levels(F.col("p_size") * 4).alias("level"))


def _wants(spark, sf):
    d = dyads(spark, sf).select("uid", "iid")
    picks = d.join(_part_levels(spark, sf), d.iid == F.col("p_partkey"), "inner")
    return stats.level_counts(picks, "uid", "level")


@query("level_counts", f"""WITH {D_SQL},
pl AS (SELECT p_partkey, {_PART_LEVEL_SQL} AS level FROM part)
SELECT uid, level, CAST(count(*) AS BIGINT) AS count FROM d JOIN pl ON d.iid = pl.p_partkey GROUP BY uid, level""")
def q_level_counts(spark, sf):
    return _wants(spark, sf)


@query("per_group_sample", f"""WITH {D_SQL},
pl AS (SELECT p_partkey, {_PART_LEVEL_SQL} AS level FROM part),
w AS (SELECT uid, level, count(*) AS cnt FROM d JOIN pl ON d.iid = pl.p_partkey GROUP BY uid, level),
r AS (SELECT level, p_partkey, row_number() OVER (PARTITION BY level ORDER BY p_partkey) - 1 AS rk FROM pl),
sz AS (SELECT level, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM pl GROUP BY level),
p AS (SELECT w.uid, w.level, n, a, (n + a - 1) // a AS b, LEAST(w.cnt, n) AS take,
             {', '.join(f"CAST(floor({crng_uniform_sql('w.uid', 8 + k, 'w.level')} * {MOD}) AS BIGINT) AS k{k}" for k in range(windows.FEISTEL_ROUNDS))}
      FROM w JOIN sz USING (level)),
x AS (SELECT uid, level, n, a, b, k0, k1, k2, k3, i FROM p, range(0, take) AS t(i)),
y AS (SELECT uid, level, list_reduce(list_prepend({windows.feistel_sql('i')}, range(0, a * b - n)),
             lambda y, s: CASE WHEN y < n THEN y ELSE {windows.feistel_sql('y')} END) AS rk FROM x)
SELECT y.uid, y.level, r.p_partkey FROM y JOIN r USING (level, rk)""")
def q_sample(spark, sf):
    return windows.per_group_sample(_wants(spark, sf), _part_levels(spark, sf),
                                    who="uid", level="level", count="count", item="p_partkey", seed=7)


@query("seeded_minibatches", f"""WITH {SPLIT_SQL},
b AS (SELECT e.epoch, CAST(floor({crng_uniform_sql('l_orderkey', 'e.epoch', ROW_DRAW_SQL)} * 9) AS INTEGER) AS batch
      FROM ds, (SELECT * FROM range(0, 2) t(epoch)) e WHERE split = 'train')
SELECT CAST(epoch AS BIGINT) AS epoch, batch, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY epoch, batch""")
def q_minibatch(spark, sf):
    train, _ = hold_out(held_dyads(spark, sf))
    parts = [train.select(F.lit(e).cast("long").alias("epoch"),
                          prep.minibatch_column("l_orderkey", row_draw(), e, 9).alias("batch"))
             for e in range(2)]
    return parts[0].unionByName(parts[1]).groupBy("epoch", "batch").agg(cnt().alias("n"))


# ---------------------------------------------------------------- E rollups
def _students(spark, sf):
    """Student seeds from customer: entry GPA from the account balance,
    entry level from the nation, hours = level * 30."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("sid"),
                    clip(F.col("c_acctbal") / 2500.0, 0.0, 4.0).alias("hsgpa"),
                    (F.pmod("c_nationkey", F.lit(5)) * 30).cast("double").alias("schrs0"))


STUDENTS_SQL = """st AS (SELECT c_custkey AS sid, LEAST(4.0, GREATEST(0.0, c_acctbal / 2500.0)) AS hsgpa,
                CAST((c_nationkey % 5) * 30 AS DOUBLE) AS schrs0 FROM customer)"""


@query("term_totals", f"""WITH {E_SQL}
SELECT event_id, sid, cid, term,
       sum(hours) OVER (PARTITION BY sid, term) AS term_chrs,
       CAST(count(*) OVER (PARTITION BY cid, term) AS BIGINT) AS term_enrolled
FROM e""")
def q_term_totals(spark, sf):
    return windows.term_totals(events_dyads(spark, sf)).select(
        "event_id", "sid", "cid", "term", "term_chrs", "term_enrolled")


def _qpts(spark, sf):
    e = events_dyads(spark, sf)
    lo, hi = e.agg(F.min("term"), F.max("term")).first()
    spine = windows.term_spine(_students(spark, sf), "sid", lo, hi)
    return stats.term_quality_points(e, spine)


_QPTS_SQL = f"""{E_SQL}, {STUDENTS_SQL},
tr AS (SELECT min(term) AS lo, max(term) AS hi FROM e),
sp AS (SELECT sid, CAST(t AS BIGINT) AS term FROM st, tr, range(tr.lo, tr.hi + 1) r(t)),
a AS (SELECT sid, term, sum(grade * hours) AS qpts, sum(hours) AS term_hours FROM e GROUP BY sid, term),
q AS (SELECT sp.sid, sp.term, COALESCE(a.qpts, 0.0) AS qpts, COALESCE(a.term_hours, 0.0) AS term_hours
      FROM sp LEFT JOIN a USING (sid, term))"""


@query("term_quality_points", f"""WITH {_QPTS_SQL}
SELECT sid, term, {s6('qpts')} AS qpts, term_hours FROM q""")
def q_qpts(spark, sf):
    return _qpts(spark, sf).select("sid", "term", r6("qpts").alias("qpts"), "term_hours")


@query("cumulative_gpa", f"""WITH {_QPTS_SQL},
c AS (SELECT q.sid, q.term, st.hsgpa,
             st.schrs0 + sum(term_hours) OVER w AS schrs,
             CAST(CAST(st.schrs0 * st.hsgpa AS DECIMAL(24,6)) + sum(CAST(qpts AS DECIMAL(24,6))) OVER w AS DOUBLE) AS num
      FROM q JOIN st USING (sid)
      WINDOW w AS (PARTITION BY q.sid ORDER BY q.term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT sid, term, schrs, CASE WHEN schrs > 0 THEN num / schrs ELSE hsgpa END AS cum_gpa,
       CASE WHEN schrs >= 0 AND schrs <= 30 THEN 0 WHEN schrs > 30 AND schrs <= 60 THEN 1
            WHEN schrs > 60 AND schrs <= 90 THEN 2 WHEN schrs > 90 AND schrs <= 120 THEN 3
            WHEN schrs > 120 AND schrs <= 200 THEN 4 END AS alevel
FROM c""")
def q_cumgpa(spark, sf):
    return windows.cumulative_gpa(_qpts(spark, sf), _students(spark, sf))


@query("carried_gpa", ORACLES["cumulative_gpa"])
def q_carried_gpa(spark, sf):
    """The running GPA term by term: each term reads its own folder and the
    state that the term before it has written."""
    path = _staged_terms(spark, sf)
    staged = spark.read.parquet(path)
    lo, hi = staged.agg(F.min("term"), F.max("term")).first()
    out = scratch_path(spark, "gpa-terms")
    term_state.run_terms(term_state.student_state(_students(spark, sf)), range(int(lo), int(hi) + 1),
                         lambda t: staged.filter(F.col("term") == t), term_state.add_student_term, term_state.student_rows, out)
    return spark.read.parquet(out)


CGPA0, ENROLLED0 = 3.0, 10.0


@query("cumulative_course_mean", f"""WITH {E_SQL},
tr AS (SELECT min(term) AS lo, max(term) AS hi FROM e),
sp AS (SELECT cid, CAST(t AS BIGINT) AS term FROM (SELECT DISTINCT cid FROM e), tr, range(tr.lo, tr.hi + 1) r(t)),
a AS (SELECT cid, term, sum(grade) AS grade_sum, CAST(count(*) AS DOUBLE) AS enrolled FROM e GROUP BY cid, term),
j AS (SELECT sp.cid, sp.term, COALESCE(grade_sum, 0.0) AS grade_sum, COALESCE(enrolled, 0.0) AS enrolled
      FROM sp LEFT JOIN a USING (cid, term)),
c AS (SELECT cid, term, grade_sum, enrolled, {ENROLLED0} + sum(enrolled) OVER w AS total,
             {CGPA0 * ENROLLED0} + sum(grade_sum) OVER w AS num
      FROM j WINDOW w AS (PARTITION BY cid ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT cid, term, total AS total_enrolled, {s6(f'CASE WHEN total > 0 THEN num / total ELSE {CGPA0} END')} AS cum_cgpa,
       {s6('CASE WHEN enrolled > 0 THEN grade_sum / enrolled END')} AS term_cgpa FROM c""")
def q_cum_course(spark, sf):
    e = events_dyads(spark, sf)
    lo, hi = e.agg(F.min("term"), F.max("term")).first()
    spine = windows.term_spine(e.select("cid").distinct(), "cid", lo, hi)
    out = windows.cumulative_course_mean(e, spine, CGPA0, ENROLLED0)
    return out.withColumns({"cum_cgpa": r6("cum_cgpa"), "term_cgpa": r6("term_cgpa")})


# ---------------------------------------------------------------- reshape
_KEY_SQL = "(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate)"


@query("sparse_entries", f"""WITH {D_SQL}
SELECT uid, iid, arg_max(y, {_KEY_SQL}) AS value FROM d GROUP BY uid, iid""")
def q_sparse(spark, sf):
    return sparse_entries(dyads(spark, sf), "uid", "iid", "y", ROW_KEY)


WIDTH = 16


@query("pivot_ratings", f"""WITH {D_SQL},
it AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_partkey) - 1 AS code FROM part),
en AS (SELECT uid, iid, arg_max(y, {_KEY_SQL}) AS value FROM d GROUP BY uid, iid),
b AS (SELECT uid, code // {WIDTH} AS block, {', '.join(f"max(CASE WHEN code % {WIDTH} = {j} THEN value END) AS c{j}" for j in range(WIDTH))}
      FROM en JOIN it ON en.iid = it.p_partkey GROUP BY uid, code // {WIDTH})
SELECT c_custkey AS uid, CAST(COALESCE(block, 0) AS BIGINT) AS block, {', '.join(f"COALESCE(c{j}, 0.0) AS c{j}" for j in range(WIDTH))}
FROM customer LEFT JOIN b ON b.uid = c_custkey""")
def q_pivot(spark, sf):
    """All customers x all parts, in blocks of 16 parts."""
    codes = contiguous_ids(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("iid"), F.col("idx").alias("code"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    m = rating_blocks(dyads(spark, sf), "uid", "iid", "y", ROW_KEY, users, codes, WIDTH)
    return m.select("uid", "block", *[F.col("cells")[j].alias(f"c{j}") for j in range(WIDTH)])


@query("unpivot_stats", f"""WITH {D_SQL},
w AS (SELECT term, sum(l_discount) AS discount, sum(l_tax) AS tax, sum(y) AS y FROM d GROUP BY term)
SELECT term, feature, {s6('value')} AS value FROM (
  SELECT term, 'discount' AS feature, discount AS value FROM w
  UNION ALL SELECT term, 'tax', tax FROM w UNION ALL SELECT term, 'y', y FROM w)""")
def q_unpivot(spark, sf):
    w = dyads(spark, sf).groupBy("term").agg(F.sum("l_discount").alias("discount"),
                                             F.sum("l_tax").alias("tax"), F.sum("y").alias("y"))
    return unpivot_stats(w, ["term"], ["discount", "tax", "y"]).withColumn("value", r6("value"))


@query("append_terms_stream", f"""WITH {E_SQL}
SELECT term, CAST(count(*) AS BIGINT) AS n, {s6('sum(grade)')} AS sum_grade FROM e GROUP BY term""")
def q_append_stream(spark, sf):
    """Terms land in two waves; two availableNow runs of one stream (same
    checkpoint) append each term exactly once."""
    import os
    from dyadic.session import scratch_path
    from dyadic.streaming import append_terms_stream
    e = events_dyads(spark, sf)
    base = scratch_path(spark, "term-stream")
    landing, table_, ckpt = (os.path.join(base, x) for x in ("landing", "table", "_checkpoint"))
    staged, schema = _staged_terms(spark, sf), e.schema
    terms = _terms_of(spark, staged)
    for wave in (terms[:len(terms) // 2], terms[len(terms) // 2:]):
        for t in wave:  # a read of the term's own folder
            one = spark.read.parquet(staged).filter(F.col("term") == t).withColumn("term", F.col("term").cast("long"))
            one.select(e.columns).write.parquet(os.path.join(landing, f"term-{t}"))
        append_terms_stream(spark, os.path.join(landing, "*"), table_, ckpt, schema)
    back = spark.read.parquet(table_)
    return back.groupBy(F.col("term").cast("long").alias("term")).agg(
        cnt().alias("n"), r6(F.sum("grade")).alias("sum_grade"))


# ---------------------------------------------------------------- ad-hoc grade score (PRJ-6)
def _course_attrs(e):
    """Course level and credit hours derived from the course name."""
    return e.select("cid").distinct().select(
        "cid", (F.lit(1) + F.pmod(F.length("cid"), F.lit(6))).alias("clevel"),
        (F.lit(1) + F.pmod(F.length("cid"), F.lit(4))).cast("double").alias("chrs"))


@query("adhoc_grade_score", f"""WITH {_QPTS_SQL},
cg AS (SELECT q.sid, q.term, st.schrs0 + sum(term_hours) OVER w AS schrs,
              st.schrs0 * st.hsgpa + sum(qpts) OVER w AS num, st.hsgpa
       FROM q JOIN st USING (sid)
       WINDOW w AS (PARTITION BY q.sid ORDER BY q.term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT sid, term, schrs, CASE WHEN schrs > 0 THEN num / schrs ELSE hsgpa END AS cum_gpa,
             CASE WHEN schrs >= 0 AND schrs <= 30 THEN 0 WHEN schrs > 30 AND schrs <= 60 THEN 1
                  WHEN schrs > 60 AND schrs <= 90 THEN 2 WHEN schrs > 90 AND schrs <= 120 THEN 3
                  WHEN schrs > 120 AND schrs <= 200 THEN 4 END AS alevel FROM cg),
csp AS (SELECT cid, CAST(t AS BIGINT) AS term FROM (SELECT DISTINCT cid FROM e), tr, range(tr.lo, tr.hi + 1) r(t)),
ca AS (SELECT cid, term, sum(grade) AS grade_sum, CAST(count(*) AS DOUBLE) AS enrolled FROM e GROUP BY cid, term),
cj AS (SELECT csp.cid, csp.term, COALESCE(grade_sum, 0.0) AS grade_sum, COALESCE(enrolled, 0.0) AS enrolled
       FROM csp LEFT JOIN ca USING (cid, term)),
cc AS (SELECT cid, term, {ENROLLED0} + sum(enrolled) OVER w AS total, {CGPA0 * ENROLLED0} + sum(grade_sum) OVER w AS num
       FROM cj WINDOW w AS (PARTITION BY cid ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cm AS (SELECT cid, term, CASE WHEN total > 0 THEN num / total ELSE {CGPA0} END AS cum_cgpa FROM cc),
tt AS (SELECT event_id, sid, cid, term, sum(hours) OVER (PARTITION BY sid, term) AS term_chrs,
              count(*) OVER (PARTITION BY cid, term) AS term_enrolled FROM e),
co AS (SELECT DISTINCT cid, 1 + length(cid) % 6 AS clevel, CAST(1 + length(cid) % 4 AS DOUBLE) AS chrs FROM e),
sa AS (SELECT c_custkey AS sid, 18 + c_nationkey % 10 AS age, c_nationkey % 2 AS gender, c_nationkey % 5 AS alevel0 FROM customer),
x AS (SELECT tt.event_id, tt.sid, tt.cid, tt.term, tt.term_chrs, tt.term_enrolled,
             COALESCE(g.cum_gpa, st.hsgpa) AS gpa, COALESCE(g.alevel, sa.alevel0) AS alevel,
             COALESCE(cm.cum_cgpa, {CGPA0}) AS cgpa, sa.age, sa.gender, co.clevel, co.chrs
      FROM tt JOIN st ON tt.sid = st.sid JOIN sa ON tt.sid = sa.sid JOIN co ON tt.cid = co.cid
      LEFT JOIN g ON g.sid = tt.sid AND g.term = tt.term - 1
      LEFT JOIN cm ON cm.cid = tt.cid AND cm.term = tt.term - 1)
SELECT event_id, sid, cid, term,
  {s6('4.0 / (1.0 + exp(-((gpa * cgpa * 1.0 + gpa * 1.0 + cgpa * 0.5 + age / 30.0 + gender * 0.2 - abs(alevel - clevel) * 2.0 - (chrs / 3.0 - 1.0) - (term_chrs - 12.0) * 0.5 - term_enrolled * 0.01) - 7.0)))')} AS score
FROM x""")
def q_adhoc_score(spark, sf):
    from dyadic.functions.scalar import grade_logit, logistic_bounded
    e = events_dyads(spark, sf)
    cust = table(spark, sf, "customer")
    studs = cust.select(F.col("c_custkey").alias("sid"), (F.lit(18) + F.pmod("c_nationkey", F.lit(10))).alias("age"),
                        F.pmod("c_nationkey", F.lit(2)).alias("gender"), F.pmod("c_nationkey", F.lit(5)).alias("alevel0"))
    seeds = _students(spark, sf)
    lo, hi = e.agg(F.min("term"), F.max("term")).first()
    gpa = windows.cumulative_gpa(_qpts(spark, sf), seeds)
    cspine = windows.term_spine(e.select("cid").distinct(), "cid", lo, hi)
    cm = windows.cumulative_course_mean(e, cspine, CGPA0, ENROLLED0)
    tt = windows.term_totals(e)
    prev_g = gpa.select("sid", (F.col("term") + 1).alias("term"), F.col("cum_gpa").alias("gpa"),
                        F.col("alevel").alias("alevel_prev"))
    prev_c = cm.select("cid", (F.col("term") + 1).alias("term"), F.col("cum_cgpa").alias("cgpa"))
    x = (tt.join(seeds, "sid").join(studs, "sid").join(_course_attrs(e), "cid")
           .join(prev_g, ["sid", "term"], "left").join(prev_c, ["cid", "term"], "left"))
    x = x.withColumns({"gpa": F.coalesce("gpa", "hsgpa"), "alevel": F.coalesce("alevel_prev", "alevel0"),
                       "cgpa": F.coalesce("cgpa", F.lit(CGPA0))})
    g = grade_logit("gpa", "cgpa", "age", "gender", "alevel", "clevel", "chrs", "term_chrs", "term_enrolled")
    return x.select("event_id", "sid", "cid", "term", r6(logistic_bounded(g)).alias("score"))


@query("residuals", f"""WITH {SPLIT_SQL},
gm AS (SELECT avg(y) AS m FROM ds WHERE split = 'train')
SELECT l_orderkey, l_linenumber, uid, {s6('y - m')} AS resid FROM ds, gm WHERE split = 'test'""")
def q_residuals(spark, sf):
    """Per-row residuals y - y_hat of the train-mean predictor on the
    hold-out rows (AG-2 residuals)."""
    train, test = hold_out(held_dyads(spark, sf))
    gm = stats.global_mean(train, "y")
    r = stats.residuals(test.withColumn("pred", F.lit(float(gm))), "y", "pred")
    return r.select("l_orderkey", "l_linenumber", "uid", r6("resid").alias("resid"))
