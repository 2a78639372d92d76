"""Worked FM example: active features 1, 11, 32 with w0 = 0.5, w1 = 0.5,
w11 = 2, w32 = 0, Z(1,32) = -0.2, Z(11,32) = 0.2, Z(1,11) = 0:
prediction 3.0, T = 2.9, shares 0.2069 / 0.7241 / 0.0690."""

import pytest

from dyadic.operators.importance import fm_importance
from dyadic.operators.score import fm_score


def _setup(spark):
    rows = spark.createDataFrame([(0, 0, 0)], "a int, b int, c int")
    fields = {
        "a": (spark.createDataFrame([(0, 0.5, [1.0, 0.0])], "a int, w double, vec array<double>"), 1),
        "b": (spark.createDataFrame([(0, 2.0, [0.0, 1.0])], "b int, w double, vec array<double>"), 1),
        "c": (spark.createDataFrame([(0, 0.0, [-0.2, 0.2])], "c int, w double, vec array<double>"), 1),
    }
    return rows, fields


def test_golden_prediction(spark):
    rows, fields = _setup(spark)
    assert fm_score(rows, 2, 0.5, fields).first()["pred"] == pytest.approx(3.0)


def test_golden_importance(spark):
    rows, fields = _setup(spark)
    imp = {r["idx"]: r for r in fm_importance(rows, 2, fields, {"a": 0, "b": 1, "c": 2}).collect()}
    assert imp[0]["f"] == pytest.approx(0.6 / 2.9)
    assert imp[1]["f"] == pytest.approx(2.1 / 2.9)
    assert imp[2]["f"] == pytest.approx(0.2 / 2.9)
    assert round(imp[0]["f"], 4) == 0.2069 and round(imp[1]["f"], 4) == 0.7241
    assert round(imp[2]["f"], 4) == 0.0690
    assert sum(r["f"] for r in imp.values()) == pytest.approx(1.0)
    assert sum(r["f1"] + r["f2"] for r in imp.values()) == pytest.approx(1.0)
