"""Estimator-style front ends for the profile models (IPR, MLR).

``fit`` trains on the train split of an :class:`Encoding` (or any field-coded
frame), ``predict`` scores rows, ``feature_importance`` returns the overall,
per-profile and membership frames, ``save`` / ``load`` use one Parquet table
per parameter.  Predicting before fitting raises an error naming the unset
parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.operators import importance as imp
from dyadic.operators.encode import Encoding
from dyadic.operators.train_profile import (
    NotFittedError, ProfileModel, fit_profile_cd, fit_profile_gd, init_profile_model)
from dyadic.sources.sinks import param_load, param_save


class _ProfileEstimator:
    _bias_fields: tuple = ()

    def __init__(self, nmodels: int = 3, lambda_w: float = 0.01, lambda_b: float = 0.0, iters: int = 10,
                 lrate: float = 0.001, epsilon: float = 1e-5, init_std: float = 0.01, nonneg: bool = False,
                 method: str = "gd", norm: str = "fro", seed: int = 100, nbatches: int = 1,
                 resume_path: str | None = None):
        self.nmodels, self.lambda_w, self.lambda_b, self.iters = nmodels, lambda_w, lambda_b, iters
        self.lrate, self.epsilon, self.init_std, self.nonneg = lrate, epsilon, init_std, nonneg
        self.method, self.norm, self.seed = method, norm, seed
        self.nbatches, self.resume_path = nbatches, resume_path
        self.model_: ProfileModel | None = None
        self.history_: DataFrame | None = None

    # -- subclasses say which fields play which role
    def _roles(self, enc: Encoding):
        raise NotImplementedError

    def _init(self, enc: Encoding, train: DataFrame) -> ProfileModel:
        bias, profiled, cats, reals, w0, learn = self._roles(enc, train)
        ids = {f: enc.codes(f) for f in {*bias, profiled, *cats}}
        return init_profile_model(ids, self.nmodels, bias, profiled, cats, reals, std=self.init_std,
                                  seed=self.seed, w0=w0, learn_w0=learn, sizes=enc.cards)

    def fit(self, enc: Encoding, split: str = "split"):
        train = enc.frame.filter(F.col(split) == "train")
        m0 = self._init(enc, train)
        target = enc.guide.target
        if self.method == "cd":
            self.model_, self.history_ = fit_profile_cd(train, m0, target, self.lambda_w, self.lambda_b,
                                                        self.iters, self.epsilon, self.nonneg, resume_path=self.resume_path)
        else:
            self.model_, self.history_ = fit_profile_gd(train, m0, target, self.lrate, self.lambda_w,
                                                        self.lambda_b, self.iters, self.epsilon,
                                                        self.nonneg, self.norm, nbatches=self.nbatches,
                                                        resume_path=self.resume_path)
        return self

    def check_if_learned(self) -> None:
        if self.model_ is None:
            raise NotFittedError("model parameters are not set: w0, w (biases), P, W; call fit or load first")

    def predict(self, rows: DataFrame) -> DataFrame:
        self.check_if_learned()
        return self.model_.predict(rows)

    def rmse(self, rows: DataFrame, target: str = "y") -> float:
        p = self.predict(rows)
        return p.agg(F.sqrt(F.avg((F.col(target) - F.col("pred")) ** 2))).first()[0]

    def feature_importance(self, rows: DataFrame):
        """(overall, per-profile, membership) importance frames (IM-3/4/5)."""
        self.check_if_learned()
        m = self.model_
        biases = {f: (t, m.sizes.get(f)) for f, t in m.biases.items()}
        P = (m.P, m.sizes.get(m.profiled))
        Wcat = {f: (t, m.sizes.get(f)) for f, t in m.Wcat.items()}
        overall, per_model, _ = imp.ipr_importance(rows, m.k, biases, m.profiled, P, Wcat, m.reals, m.Wr)
        ranked = imp.importance_rank(overall)
        member = imp.profile_membership(rows, m.k, m.profiled, P, Wcat, m.reals, m.Wr)
        return ranked, imp.profile_rank(per_model, ranked), member

    def save(self, path: str, ow: bool = False) -> None:
        self.check_if_learned()
        m = self.model_
        spark = m.P.sparkSession
        wr = spark.createDataFrame([(int(l), int(j), float(m.Wr[l, j])) for l in range(m.Wr.shape[0])
                                    for j in range(m.Wr.shape[1])], "l int, j long, value double")
        params = {"w0": float(m.w0), "k": int(m.k), "Wr": wr, "P": m.P}
        params.update({f"b__{f}": t for f, t in m.biases.items()})
        params.update({f"W__{f}": t for f, t in m.Wcat.items()})
        param_save(spark, params, path, ow)
        sizes = {f: int(n) for f, n in m.sizes.items() if n is not None}
        meta = spark.createDataFrame([(m.profiled, ",".join(m.reals), bool(m.learn_w0), sizes)],
                                     "profiled string, reals string, learn_w0 boolean, sizes map<string,long>")
        meta.write.mode("overwrite" if ow else "errorifexists").parquet(f"{path}/_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw):
        p = param_load(spark, path)
        meta = spark.read.parquet(f"{path}/_meta").first()
        k = int(p["k"])
        reals = [x for x in meta["reals"].split(",") if x]
        Wr = np.zeros((k, len(reals)))
        for r in p["Wr"].collect():  # k x r entries
            Wr[r["l"], r["j"]] = r["value"]
        est = cls(nmodels=k, **kw)
        est.model_ = ProfileModel(
            k, float(p["w0"]), {n[3:]: t for n, t in p.items() if n.startswith("b__")}, meta["profiled"],
            p["P"], {n[3:]: t for n, t in p.items() if n.startswith("W__")}, reals, Wr,
            sizes=dict(meta["sizes"] or {}) if "sizes" in meta else {}, learn_w0=bool(meta["learn_w0"]))
        return est


class IPR(_ProfileEstimator):
    """Biases for every entity field, W over categoricals and reals, w0 learned."""

    def _roles(self, enc, train):
        g = enc.guide
        return list(g.ents), g.profiled, list(g.cats), list(g.reals), 0.0, True


class MLR(_ProfileEstimator):
    """User and item biases, W over the real features, w0 = train mean."""

    def _roles(self, enc, train):
        g = enc.guide
        mean = train.agg(F.avg(g.target)).first()[0]
        return list(g.ents[:2]), g.profiled, [], list(g.reals), float(mean), False
