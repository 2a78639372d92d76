"""Registered aggregate-kernel queries (AG-7..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadic.operators import stats
from dyadic.operators.encode import encode
from dyadic.plans.common import r6, rn, s6, sn
from dyadic.plans.registry import D_SQL, query
from dyadic.plans.table_queries import _CODES_SQL
from dyadic.sources.tables import DYAD_GUIDE, dyads, table

EMB_DIM = 64
GRAM = ["l_discount", "l_tax", "y"]


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


@query("covariance_matrix", f"""WITH ij AS (SELECT a.i, b.j FROM range(0, {EMB_DIM}) a(i), range(0, {EMB_DIM}) b(j))
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
       {s6('covar_samp(CAST(embedding[i + 1] AS DOUBLE), CAST(embedding[j + 1] AS DOUBLE))')} AS cov
FROM embeddings, ij GROUP BY i, j""")
def q_cov(spark, sf):
    return stats.covariance_matrix(_emb(spark, sf), "embedding", EMB_DIM).withColumn("cov", r6("cov"))


@query("vector_mean", """SELECT CAST(pos - 1 AS BIGINT) AS pos, (ROUND(avg(CAST(x AS DOUBLE)), 6) + 0.0) AS mean
FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY pos""")
def q_vmean(spark, sf):
    return stats.vector_mean(_emb(spark, sf), "embedding").withColumn("mean", r6("mean"))


# Per-entity sums of decimal data are exact at 7 decimals: rounding at 8
# cannot land on a tie.  Global sums are shown as means (X^T X / n).
def _gram_sql(group: str | None):
    agg, d = ("sum", 8) if group else ("avg", 6)
    cols = []
    for a in range(len(GRAM)):
        for b in range(a, len(GRAM)):
            cols.append(f"{sn(f'{agg}({GRAM[a]} * {GRAM[b]})', d)} AS g_{a}_{b}")
    for a in range(len(GRAM)):
        cols.append(f"{sn(f'{agg}({GRAM[a]} * (p_retailprice / 1000.0))', d)} AS b_{a}")
    sel = ", ".join(cols)
    if group:
        return f"WITH {D_SQL} SELECT {group}, CAST(count(*) AS BIGINT) AS n, {sel} FROM d GROUP BY {group}"
    return f"WITH {D_SQL} SELECT CAST(count(*) AS BIGINT) AS n, {sel} FROM d"


def _gram_frame(spark, sf):
    d = dyads(spark, sf)
    return d.select("uid", F.array(*GRAM).alias("z"), (F.col("p_retailprice") / 1000.0).alias("r"))


def _round_gram(df, d=8, per_row=False):
    n = F.col("n") if per_row else F.lit(1.0)
    return df.select(*[rn(F.col(c) / n, d).alias(c) if c.startswith(("g_", "b_")) else F.col(c)
                       for c in df.columns])


@query("entity_gram", _gram_sql("uid"))
def q_entity_gram(spark, sf):
    return _round_gram(stats.entity_gram(_gram_frame(spark, sf), "uid", "z", "r", len(GRAM)))


@query("global_gram", _gram_sql(None))
def q_global_gram(spark, sf):
    return _round_gram(stats.global_gram(_gram_frame(spark, sf), "z", "r", len(GRAM)), 6, per_row=True)


_FIELD_CODES = dict(zip(DYAD_GUIDE.fields, ("u_code", "i_code", "m_code", "b_code", "o_code", "r_code"), strict=True))


@query("feature_sufficient_stats", f"""WITH {_CODES_SQL},
m AS (SELECT avg(y) AS m FROM ds WHERE split = 'train')
""" + "\nUNION ALL\n".join(f"""SELECT '{f}' AS field, CAST({c} AS BIGINT) AS code, {s6('CAST(count(*) AS DOUBLE)')} AS sum_vv,
       {s6('sum(y - m)')} AS sum_ev, CAST(count(*) AS BIGINT) AS n
FROM enc, m WHERE split = 'train' GROUP BY {c}""" for f, c in _FIELD_CODES.items()))
def q_suff(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    tr = enc.frame.filter(F.col("split") == "train")
    m = stats.global_mean(tr, "y")
    g = stats.all_feature_stats(tr, {f: F.lit(1.0) for f in DYAD_GUIDE.fields}, F.col("y") - F.lit(m))
    return g.select("field", "code", r6("sum_vv").alias("sum_vv"), r6("sum_ev").alias("sum_ev"), "n")
