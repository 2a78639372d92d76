"""Operators: ranks across partitions, sampling, guide checks, sinks,
partition-count independence of seeded draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.guide import FeatureGuide, GuideError
from dyadic.operators.encode import contiguous_ids
from dyadic.operators.ranking import rank_within
from dyadic.operators.train_bpmf import _draw_side
from dyadic.operators.windows import per_group_sample
from dyadic.session import scratch_path
from dyadic.sources.scans import guided_scan
from dyadic.sources.sinks import ParamExistsError, param_save
from dyadic.sources.tables import table


def test_rank_within_spans_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10007).alias("v"))
    got = rank_within(df, "g", ["v"], num_partitions=7).toPandas()
    pdf = df.toPandas()
    pdf["rank"] = pdf.groupby("g")["v"].rank(method="first").astype(int) - 1
    m = got.merge(pdf, on=["g", "v"], suffixes=("", "_w"))
    assert len(m) == 5000 and (m["rank"] == m["rank_w"]).all()


def test_contiguous_ids_strings_sorted(spark, sf):
    ids = contiguous_ids(table(spark, sf, "part"), "p_brand").orderBy("idx").toPandas()
    assert list(ids.p_brand) == sorted(ids.p_brand)
    assert list(ids.idx) == list(range(len(ids)))


def test_per_group_sample_caps_and_distinct(spark):
    wants = spark.createDataFrame([(1, 0, 2), (2, 0, 50), (3, 1, 1)], "who long, level int, count long")
    cands = spark.createDataFrame([(0, 10), (0, 11), (0, 12), (1, 20)], "level int, item long")
    out = per_group_sample(wants, cands, "who", "level", "count", "item").toPandas()
    sizes = out.groupby("who").size().to_dict()
    assert sizes == {1: 2, 2: 3, 3: 1}
    assert not out.duplicated().any()


def test_guided_scan_names_missing_role(spark, sf):
    g = FeatureGuide("c_acctbal", ("c_custkey",), ("c_mktsegment",), ("nope",))
    with pytest.raises(GuideError, match="real column 'nope'"):
        guided_scan(spark, f"{sf}/customer.parquet", g)


def test_param_save_refuses_existing(spark):
    p = scratch_path(spark, "test-params")
    param_save(spark, {"w0": 1.5}, p)
    with pytest.raises(ParamExistsError):
        param_save(spark, {"w0": 2.5}, p)
    param_save(spark, {"w0": 2.5}, p, ow=True)


def test_gibbs_draws_independent_of_partitioning(spark):
    ids = spark.range(0, 300).select(F.col("id").alias("u"))
    g = ids.select("u", F.lit(3).cast("long").alias("n"), *[F.lit(v).alias(c) for c, v in
                   (("g_0_0", 2.0), ("g_0_1", 0.5), ("g_1_1", 1.0), ("b_0", 1.0), ("b_1", -1.0))])
    a = _draw_side(ids.repartition(3), "u", g, 2, np.eye(2), np.zeros(2), 2.0, 17).toPandas()
    b = _draw_side(ids.repartition(11), "u", g.repartition(5), 2, np.eye(2), np.zeros(2), 2.0, 17).toPandas()
    a, b = a.sort_values("u"), b.sort_values("u")
    assert np.allclose(np.stack(a.vec.to_numpy()), np.stack(b.vec.to_numpy()))


def test_term_totals_with_a_hot_student(spark):
    """A student holding a third of a term's rows: salted join-back keeps
    the totals exact."""
    from dyadic.operators.windows import term_totals
    d = spark.range(0, 30000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("sid"),
        (F.col("id") % 5).cast("string").alias("cid"), F.lit(1).cast("long").alias("term"),
        (F.col("id") % 4 + 1).cast("double").alias("hours"))
    got = term_totals(d).toPandas()
    want = d.toPandas()
    want["term_chrs"] = want.groupby(["sid", "term"])["hours"].transform("sum")
    want["term_enrolled"] = want.groupby(["cid", "term"])["hours"].transform("count")
    m = got.merge(want, on="event_id", suffixes=("", "_w"))
    assert len(got) == 30000
    assert (m.term_chrs == m.term_chrs_w).all() and (m.term_enrolled == m.term_enrolled_w).all()


def test_counter_draws_of_large_ids(spark):
    import duckdb
    import numpy as np
    from pyspark.sql import functions as F

    from dyadic.functions.crng import crng_uniform, crng_uniform_np, crng_uniform_sql
    ids = [5, 5 + 2**31 - 1, 5 + 2**31, 2**40 + 5, 2**62, 2**31 - 1, 0]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(
        crng_uniform("id", F.lit(3), F.lit(1))).collect()]
    assert got == crng_uniform_np(ids, 3, 1).tolist()
    assert got == [duckdb.sql(f"SELECT {crng_uniform_sql(str(i), 3, 1)}").fetchall()[0][0] for i in ids]
    assert len(set(got)) == len(got)
    big = np.arange(2000) + 7 * 2**33
    assert abs(crng_uniform_np(big, 1, 0).mean() - 0.5) < 0.03
