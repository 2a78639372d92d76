"""Skew-safe lookups and sums, replayable draws, fits that resume, keyed
permutations, rating blocks and carried term state."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.functions.draws import CounterRNG, SqlDraws, inverse_sql, select_sql, stream_of, wishart_sql
from dyadic.operators import stats, term_state, windows
from dyadic.operators.epochs import Epochs
from dyadic.operators.iterate import group_sums
from dyadic.operators.keyed import Generations, prepare, within_budget
from dyadic.operators.reshape import rating_blocks
from dyadic.operators.train_bpmf import fit_bpmf
from dyadic.operators.train_bpmlr import fit_bpmlr
from dyadic.operators.train_fm import fit_fm_als, init_fm_model
from dyadic.operators.train_pmf import fit_pmf
from dyadic.operators.train_profile import fit_profile_cd, fit_profile_gd, init_profile_model
from dyadic.plans.params import vec_table
from dyadic.session import scratch_path


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of which a third belong to one user and a third to one item."""
    rng = np.random.default_rng(1)
    n = 1500
    u, i = rng.integers(0, 40, n), rng.integers(0, 30, n)
    u[: n // 3], i[n // 3: 2 * n // 3] = 7, 3
    x = rng.normal(0, 1, (n, 2))
    y = 0.3 * (u % 5) - 0.2 * (i % 3) + x @ np.array([0.5, -0.4]) + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({"row": np.arange(n), "uid": u.astype("int64"), "iid": i.astype("int64"), "cat": (u * i) % 4, "x0": x[:, 0], "x1": x[:, 1], "y": y})
    return spark.createDataFrame(pdf).repartition(6).persist()


def _hist(h):
    return np.array([[np.nan if v is None else v for v in (r["train_rmse"], r["test_rmse"])] for r in h.orderBy("iter").collect()], dtype=float)


def test_budget_is_shared_by_real_widths():
    assert within_budget({"a": (1000, 10), "b": (10**6, 500), "c": (None, 1)}, 1 << 20) == {"a"}
    assert within_budget({"a": (1000, 100), "b": (1000, 100)}, 1_000_000) == {"a"}


def test_sums_of_salted_keys_have_two_levels(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, looks = prepare(skewed, {"uid": (40, 4)}, budget=0)
        t = vec_table(skewed.select("uid").distinct(), "uid", 1, 2)
        got = looks.gram(looks.attach(rows, "uid", t, {"vec": "v"}), "uid", [F.col("v")[0], F.col("x0")], F.col("y"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert looks.plans["uid"].salts[7] > 1
        # join on (key, salt) -> sums by (key, salt) -> exchange by key -> sums by key
        tail = plan[:plan.index("SortMergeJoin")]
        assert tail.count("Exchange hashpartitioning(uid") == 1 and tail.count("HashAggregate") >= 3
        want = skewed.join(t, "uid").groupBy("uid").agg(F.sum(F.col("vec")[0] * F.col("x0")).alias("g"), F.sum(F.col("x0") * F.col("y")).alias("b"))
        a = {r["uid"]: (r["g_0_1"], r["b_1"]) for r in got.collect()}
        assert all(np.allclose(a[r["uid"]], (r["g"], r["b"])) for r in want.collect()) and len(a) == skewed.select("uid").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_group_sums_equals_group_by(spark, skewed, monkeypatch):
    from dyadic.operators import iterate
    monkeypatch.setattr(iterate, "KEYS_HELD", 8)
    df = skewed.withColumn("uid", F.when(F.col("row") % 11 > 0, F.col("uid"))).withColumn("x0", F.when(F.col("row") % 7 > 0, F.col("x0")))
    got = group_sums(df, [("u", "uid", [F.col("x0"), F.col("y")]), ("all", None, [F.col("y")])]).collect()
    want = {r["uid"]: r for r in df.groupBy("uid").agg(F.count("*").alias("n"), F.sum("x0").alias("a"), F.sum("y").alias("b")).collect()}
    for r in got:
        if r["set"] == "u":
            w = want.pop(r["key"])
            assert r["n"] == w["n"] and np.allclose([r["v0"], r["v1"]], [w["a"], w["b"]])
    assert set(want) == {None}
    assert next(r["n"] for r in got if r["set"] == "all") == 1500


def test_salted_fits_equal_unsalted_ones(skewed):
    ids = {f: skewed.select(F.col(f).cast("long").alias(f)).distinct() for f in ("uid", "iid", "cat")}
    rows = skewed.withColumn("cat", F.col("cat").cast("long"))
    m0 = init_fm_model(ids, 2, ["uid", "iid", "cat"], ["x0", "x1"], init_std=0.1)
    a, b = (_hist(fit_fm_als(rows, m0, iters=2, lambda_w=1.0, lambda_v=1.0, salted=s)[1]) for s in ((), ("uid", "iid")))
    assert np.allclose(a, b, equal_nan=True) and a[2, 0] < a[0, 0]
    a, b = (_hist(fit_pmf(skewed, skewed, row_id="row", max_epoch=2, nbatches=2, nf=2, salted=s).history) for s in ((), ("uid", "iid")))
    assert np.allclose(a, b)
    U, I = vec_table(ids["uid"], "uid", 11, 2), vec_table(ids["iid"], "iid", 12, 2)
    a, b = (_hist(fit_bpmf(skewed, skewed, U, I, max_epoch=2, stopping_threshold=-1.0, probe_key=("row",), salted=s).history) for s in ((), ("uid", "iid")))
    assert np.allclose(a, b, equal_nan=True)
    a, b = (_hist(fit_bpmlr(skewed, skewed, ["x0", "x1"], k=2, nsamples=2, burnin=0, thin=1, salted=s).history) for s in ((), ("uid", "iid")))
    assert np.allclose(a, b)


def test_stopped_fits_go_on(spark, skewed):
    ids = {f: skewed.select(F.col(f).cast("long").alias(f)).distinct() for f in ("uid", "iid", "cat")}
    rows = skewed.withColumn("cat", F.col("cat").cast("long"))
    U, I = vec_table(ids["uid"], "uid", 11, 2), vec_table(ids["iid"], "iid", 12, 2)
    fm = init_fm_model(ids, 2, ["uid", "iid", "cat"], ["x0", "x1"], init_std=0.1)
    ipr = init_profile_model(ids, 2, ["uid", "iid"], "uid", ["cat"], ["x0", "x1"], std=0.1)
    fits = {
        "pmf": lambda n, path: fit_pmf(skewed, skewed, row_id="row", max_epoch=n, nbatches=2, nf=2, resume_path=path).history,
        "bpmf": lambda n, path: fit_bpmf(skewed, skewed, U, I, max_epoch=n, stopping_threshold=-1.0, probe_key=("row",), resume_path=path).history,
        "fm": lambda n, path: fit_fm_als(rows, fm, iters=n, threshold=-1.0, lambda_w=1.0, lambda_v=1.0, resume_path=path)[1],
        "ipr": lambda n, path: fit_profile_gd(rows, ipr, lrate=0.05, iters=n, eps=-1.0, resume_path=path)[1],
        "cd": lambda n, path: fit_profile_cd(rows, ipr, lambda_w=1.0, lambda_b=1.0, sweeps=n, eps=-1.0, resume_path=path)[1],
    }
    for name, fit in fits.items():
        path = scratch_path(spark, f"resume-{name}")
        fit(2, path)
        assert Epochs(spark, path).complete()[-1] == 2
        assert np.allclose(_hist(fit(4, path)), _hist(fit(4, None)), equal_nan=True), name


def test_an_epoch_without_its_record_does_not_count(spark):
    path = scratch_path(spark, "epochs")
    e, t = Epochs(spark, path), spark.range(3)
    for n in (1, 2, 3):
        e.commit(n, {"t": t}, {"a": np.arange(4.0).reshape(2, 2), "h": [(1, None, 0.5)]})
    assert e.complete() == [2, 3]
    t.write.parquet(f"{path}/epoch=4/t")
    n, values, tables = e.last()
    assert n == 3 and values["a"].tolist() == [[0, 1], [2, 3]] and values["h"] == [[1, None, 0.5]] and tables["t"].count() == 3


def test_generations_keep_two(spark):
    import os
    g = Generations(spark, "gen")
    for n in range(4):
        df = g.write(spark.range(n + 1))
    assert df.count() == 4 and len(g.paths) == 2
    paths = list(g.paths)
    g.close()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_draws_are_the_same_in_sql():
    for shape in (0.75, 1.0, 3.5, 40.0, 9000.5):
        r, s = CounterRNG(stream_of(5, 2, 1)), SqlDraws(stream_of(5, 2, 1))
        want = [r.gamma(shape), r.standard_normal(), r.chisquare(7.0)]
        exprs = [s.gamma(repr(shape)), s.normal(), s.chisquare("7.0")]
        got = duckdb.sql("SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, e in enumerate(exprs))).fetchall()[0]
        assert np.allclose(got, want, rtol=1e-12)
    many = [CounterRNG(k).gamma(3.0) for k in range(3000)]
    assert abs(np.mean(many) - 3.0) < 0.15 and abs(np.var(many) - 3.0) < 0.4
    out = []
    A = [["4.0", "1.0", "0.5"], ["1.0", "3.0", "0.2"], ["0.5", "0.2", "2.0"]]
    inv = inverse_sql(A, "i", out)
    W = wishart_sql(inv, "8.0", SqlDraws(77), "w", out)
    row = duckdb.sql(f"SELECT {', '.join(x for m in (inv, W) for r in m for x in r)} FROM {select_sql(out, '(SELECT 1 AS one)')}").fetchall()[0]
    inv_np = np.linalg.inv(np.array(A, dtype=float))
    from dyadic.operators.train_bpmf import wishart_draw
    assert np.allclose(np.array(row[:9]).reshape(3, 3), inv_np) and np.allclose(np.array(row[9:]).reshape(3, 3), wishart_draw(inv_np, 8.0, CounterRNG(77)))


def test_moment_matrix_and_covariance_around_large_means(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1e-3, (500, 3)) + 1e6
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([1.0, None, 2.0],), ([1.0],)], "v array<double>")
    got = {(r["i"], r["j"]): r["cov"] for r in stats.covariance_matrix(df, "v", 3).collect()}
    want = np.cov(x.T)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(3) for j in range(3))


def test_samples_of_two_students_are_independent(spark):
    """Of 40 items 10 are taken by each of 400 students: pairs share 2.5 on
    average, as independent samples do, and no two neighbours go together."""
    wants = spark.createDataFrame([(s, 0, 10) for s in range(400)], "who long, level int, count long")
    cands = spark.createDataFrame([(0, 100 + i) for i in range(40)], "level int, item long")
    got = windows.per_group_sample(wants, cands, "who", "level", "count", "item").collect()
    taken = np.zeros((400, 40))
    for r in got:
        taken[r["who"], r["item"] - 100] += 1
    assert (taken.sum(axis=1) == 10).all() and taken.max() == 1
    share = taken @ taken.T
    off = share[~np.eye(400, dtype=bool)]
    assert abs(off.mean() - 2.5) < 0.1 and abs(off.var() - 10 * 0.25 * 0.75 * 30 / 39) < 0.25
    assert abs(taken.mean(axis=0) - 0.25).max() < 0.09
    together = np.array([(taken[:, i] * taken[:, (i + 1) % 40]).mean() for i in range(40)])
    assert abs(together.mean() - 10 / 40 * 9 / 39) < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 50, 97])
def test_permutation_reaches_every_item(spark, n):
    wants = spark.createDataFrame([(s, 0, n + 3) for s in range(5)], "who long, level int, count long")
    cands = spark.createDataFrame([(0, i) for i in range(n)], "level int, item long")
    got = windows.per_group_sample(wants, cands, "who", "level", "count", "item")
    assert sorted((r["who"], r["item"]) for r in got.collect()) == [(s, i) for s in range(5) for i in range(n)]


def test_rating_blocks_hold_the_matrix(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 9)), int(rng.integers(0, 23)), float(k), k) for k in range(60)]
    df = spark.createDataFrame(rows, "uid long, iid long, y double, k long")
    codes = spark.createDataFrame([(i, i) for i in range(23)], "iid long, code long")
    users = spark.createDataFrame([(u,) for u in range(12)], "uid long")
    got = np.zeros((12, 24))
    blocks = rating_blocks(df, "uid", "iid", "y", ["k"], users, codes, width=4).collect()
    for r in blocks:
        got[r["uid"], 4 * r["block"]:4 * r["block"] + 4] = r["cells"]
    want = np.zeros((12, 24))
    for u, i, y, _ in rows:
        want[u, i] = y
    assert (got == want).all() and {r["uid"] for r in blocks} == set(range(12))


def test_carried_terms_equal_the_full_windows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 4)), int(t), float(rng.integers(0, 17)) / 4, float(rng.integers(1, 5)))
            for t in range(1, 7) if t != 4 for _ in range(12)]
    e = spark.createDataFrame(rows, "sid long, cid long, term long, grade double, hours double")
    seeds = spark.createDataFrame([(s, 2.5, 30.0 * (s % 2)) for s in range(7)], "sid long, hsgpa double, schrs0 double")
    spine = windows.term_spine(seeds, "sid", 1, 6)
    want = windows.cumulative_gpa(stats.term_quality_points(e, spine), seeds)
    out = scratch_path(spark, "carried")
    term_state.run_terms(term_state.student_state(seeds), range(1, 7), lambda t: e.filter(F.col("term") == t),
                         term_state.add_student_term, term_state.student_rows, out)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))
    courses = e.select("cid").distinct()
    want = windows.cumulative_course_mean(e, windows.term_spine(courses, "cid", 1, 6), 3.0, 10.0)
    out = scratch_path(spark, "carried")
    term_state.run_terms(term_state.course_state(courses, 3.0, 10.0), range(1, 7), lambda t: e.filter(F.col("term") == t),
                         term_state.add_course_term, lambda s, t: term_state.course_rows(s, t, 3.0), out)
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (spark.read.parquet(out), want))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert all(np.allclose([x or -1 for x in r[3:]], [x or -1 for x in w[3:]]) for r, w in zip(a, b, strict=True))


def test_start_values_of_another_size_are_refused(spark, skewed):
    bad = {"W": np.zeros((3, 2))}
    with pytest.raises(ValueError, match="W is"):
        fit_bpmlr(skewed, skewed, ["x0", "x1"], k=2, nsamples=1, start=bad)
    with pytest.raises(ValueError, match="lacks"):
        fit_bpmlr(skewed, skewed, ["x0", "x1"], k=2, nsamples=1, start={"s": spark.createDataFrame([(7, 0.0)], "uid long, b double")})
