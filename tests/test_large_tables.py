"""Rows and tables too large to broadcast: what moves, and that results stay."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.guide import FeatureGuide
from dyadic.operators import encode, importance, joins, train_profile
from dyadic.operators.iterate import cut
from dyadic.operators.keyed import Lookups, prepare, settle
from dyadic.operators.train_profile import fit_profile_cd, fit_profile_gd, init_profile_model
from dyadic.plans.params import scalar_table, vec_table


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of which a third belong to one user and a third to one item."""
    rng = np.random.default_rng(3)
    n = 1200
    u, i = rng.integers(0, 40, n), rng.integers(0, 30, n)
    u[: n // 3], i[n // 3: 2 * n // 3] = 7, 3
    x = rng.normal(0, 1, (n, 2))
    y = 0.3 * (u % 5) - 0.2 * (i % 3) + x @ np.array([0.5, -0.4]) + rng.normal(0, 0.1, n)
    return spark.createDataFrame(pd.DataFrame({
        "row": np.arange(n), "uid": u.astype("int64"), "iid": i.astype("int64"), "cat": (u * i) % 4,
        "x0": x[:, 0], "x1": x[:, 1], "y": y})).repartition(6).persist()


def test_rows_of_a_shuffled_join_are_not_sent_again(spark, skewed, monkeypatch):
    hints = []
    hint = type(skewed).hint
    monkeypatch.setattr(type(skewed), "hint", lambda df, name, *a: (hints.append(name), hint(df, name, *a))[1])
    other = skewed.select(F.col("row"), F.col("y").alias("z"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert cut(skewed.join(other, "row"), spread=True).count() == 1200 and hints == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert cut(skewed, spread=True).count() == 1200 and hints == ["rebalance"]


def test_importance_sums_rows_before_it_looks_large_tables_up(skewed, monkeypatch):
    ids = {c: skewed.select(c).distinct() for c in ("uid", "iid", "cat")}
    args = (2, {"uid": (scalar_table(ids["uid"], "uid", 1), 40), "iid": (scalar_table(ids["iid"].filter("iid > 4"), "iid", 2), 30)},
            "uid", (vec_table(ids["uid"].filter("uid <> 9"), "uid", 3, 2), 40), {"cat": (vec_table(ids["cat"], "cat", 4, 2, name="wvec"), 4)},
            ["x0", "x1"], np.array([[0.5, -0.2], [0.1, 0.3]]))
    want = [x.toPandas() for x in importance.ipr_importance(skewed, *args)[:2]]
    met = []
    attach = importance.attach
    monkeypatch.setattr(importance, "attach", lambda rows, key, *a, **k: (met.append((key, "row" in rows.columns)), attach(rows, key, *a, **k))[1])
    monkeypatch.setattr(importance, "fits_broadcast", lambda schema, n, *a, **k: n < 10)
    got = [x.toPandas() for x in importance.ipr_importance(skewed, *args)[:2]]
    assert {key for key, rows in met if rows} == {"cat"}
    for a, b in zip(got, want, strict=True):
        assert list(a["feature"]) == list(b["feature"]) and np.allclose(a["importance"], b["importance"])
    assert not joins.fits_broadcast(ids["uid"].schema, None)


def test_rows_at_home_do_not_move(spark, skewed):
    """Tables of the home key and values of other keys come to the rows; sums of
    the home key end there.  Results are those of plain joins and sums."""
    tabs = {"uid": (40, 3), "iid": (30, 1)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, looks = settle(*prepare(skewed, tabs, budget=0), tabs)
        assert looks.home == "uid" and looks.plans["uid"].salts[7] > 1
        U = cut(vec_table(skewed.select("uid").distinct(), "uid", 1, 2))
        I = cut(scalar_table(skewed.select("iid").distinct().filter("iid > 4"), "iid", 2))
        j = looks.attach(looks.attach(rows, "uid", U, {"vec": "v"}), "iid", I, {"b": "c"})
        c = F.coalesce("c", F.lit(0.0))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Bucketed: true") == 2
        looks.pin("iid", I)
        assert "dyadic_edges" not in looks.attach(rows, "iid", I, {"b": "c"})._jdf.queryExecution().executedPlan().toString()
        want = skewed.join(U.withColumnRenamed("vec", "v"), "uid").join(I.withColumnRenamed("b", "c"), "iid", "left")
        for key in ("uid", "iid"):
            z = [F.col("v")[0], F.col("x0")]
            a, b = (g.orderBy(key).toPandas() for g in (looks.gram(j, key, z, F.col("y") + c), Lookups({"uid", "iid"}).gram(want, key, z, F.col("y") + c)))
            assert np.allclose(a[b.columns], b)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_target_take_no_part_wherever_rows_lie(skewed):
    rows = skewed.withColumn("y", F.when(F.col("row") % 7 != 0, F.col("y")))
    ids = {c: cut(skewed.select(c).distinct()) for c in ("uid", "iid")}
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", [], ["x0", "x1"], std=0.1, learn_w0=False)
    a, b = (fit_profile_cd(rows, m0, lambda_w=1.0, lambda_b=1.0, sweeps=2, salt_entities=s) for s in (None, True))
    assert np.allclose(*[x[1].orderBy("iter").toPandas()["train_rmse"] for x in (a, b)])


def test_small_codes_move_as_one_column(spark, skewed, monkeypatch):
    """Rows that move home carry the codes of broadcast tables in one long, nulls included."""
    rows = skewed.withColumn("cat", F.when(F.col("row") % 5 != 0, F.col("cat"))).withColumn("kind", (F.col("row") % 3).cast("int"))
    tabs = {"uid": (40, 3), "iid": (30, 1), "cat": (4, 1), "kind": (3, 1)}
    prepared, looks = prepare(rows, tabs, salted=("uid", "iid"))
    moved = []
    repartition = type(skewed).repartition
    monkeypatch.setattr(type(skewed), "repartition", lambda df, n, *by: (moved.append((by, df.columns)), repartition(df, n, *by))[1])
    home, looks = settle(prepared, looks, tabs)
    (cols,) = [c for by, c in moved if by == ("__home",)]
    assert "cat" not in cols and "kind" not in cols and "uid" in cols
    assert dict(home.dtypes)["kind"] == "int"
    a, b = (x.select(rows.columns).orderBy("row").toPandas() for x in (home, rows))
    pd.testing.assert_frame_equal(a, b)


def test_encoding_moves_small_codes_as_one_column(spark, skewed, monkeypatch):
    rows = skewed.select("uid", "iid", "x0", "x1", "y", F.when(F.col("row") % 5 != 0, F.col("cat")).alias("cat"),
                         F.when(F.col("row") % 4 != 0, F.concat(F.lit("k"), F.col("row") % 3)).alias("kind"),
                         F.when(F.col("row") % 9 == 0, "test").otherwise("train").alias("split"), "row")
    guide = FeatureGuide(target="y", ents=("uid", "iid"), cats=("cat", "kind"), reals=("x0", "x1"))
    want = encode.encode(rows, guide, keep=("row",)).frame.orderBy("row").toPandas()
    packed = []
    pack = encode.packed_codes
    monkeypatch.setattr(encode, "packed_codes", lambda fields, cards: (packed.append(sorted(fields)), pack(fields, cards))[1])
    monkeypatch.setattr(encode, "fits_broadcast", lambda schema, n, *a, **k: n < 10)
    got = encode.encode(rows, guide, keep=("row",)).frame.orderBy("row").toPandas()
    assert packed == [["cat", "kind"]]
    pd.testing.assert_frame_equal(got, want)


def test_the_last_pass_sums_by_no_key(skewed, monkeypatch):
    ids = {c: cut(skewed.select(c).distinct()) for c in ("uid", "iid")}
    m0 = init_profile_model(ids, 2, ["uid", "iid"], "uid", [], ["x0", "x1"], std=0.1, learn_w0=False)
    asked = []
    sums = train_profile.group_sums
    monkeypatch.setattr(train_profile, "group_sums", lambda df, sets: (asked.append([k for _, k, _ in sets]), sums(df, sets))[1])
    _, h = fit_profile_gd(skewed, m0, iters=1, eps=float("-inf"))
    assert h.count() == 2 and asked == [[None, "uid", "iid", "uid"], [None]]
