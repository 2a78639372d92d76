import pytest
from pyspark.sql import functions as F

from dyadic.operators.encode import encode
from dyadic.operators.models import IPR, MLR
from dyadic.operators.train_profile import NotFittedError
from dyadic.session import scratch_path
from dyadic.sources.tables import DYAD_GUIDE, dyads


def test_predict_before_fit_names_parameters(spark, sf):
    with pytest.raises(NotFittedError, match="w0, w \\(biases\\), P, W"):
        IPR().predict(spark.range(1))


def test_ipr_fit_save_load_roundtrip(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    est = IPR(nmodels=2, iters=1, lrate=0.05, init_std=0.1).fit(enc)
    test = enc.frame.filter(F.col("split") == "test")
    before = est.rmse(test)
    path = scratch_path(spark, "ipr-model")
    est.save(path)
    back = IPR.load(spark, path)
    assert back.rmse(test) == pytest.approx(before, rel=1e-12)
    overall, per_profile, member = est.feature_importance(enc.frame.filter(F.col("split") == "train"))
    assert sum(r["importance"] for r in overall.collect()) == pytest.approx(1.0)
    assert per_profile.count() == 2 * overall.count()


def test_mlr_cd_fit(spark, sf):
    enc = encode(dyads(spark, sf), DYAD_GUIDE)
    est = MLR(nmodels=2, iters=1, method="cd", lambda_w=1.0, lambda_b=1.0, init_std=0.1).fit(enc)
    h = [r["train_rmse"] for r in est.history_.orderBy("iter").collect()]
    assert h[-1] < h[0]
