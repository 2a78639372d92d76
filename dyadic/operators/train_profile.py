"""Profile (mixed-membership) regression models: IPR and MLR.

    y_hat = w0 + sum_e b_e[id_e] + P[i]^T (W x)

IPR: biases for every entity field, W over one-hot categoricals and reals,
w0 learned.  MLR: biases for user and item, W over real features, w0 fixed
at the train mean.  Parameters are tables keyed by id / field code; W's real
block (k x r) and scalars are the only driver-side values.

Two estimators:
* gradient (TR-4, TR-6): every parameter moves by the average of the
  per-example steps it would receive at the current point,
  theta -= 2 lr (mean_{rows touching theta}(e dy/dtheta) + lambda pen'(theta)),
  all from one scan: one expanded grouped sum per iteration;
* coordinate descent / alternating least squares (TR-5, TR-7): exact block
  minimisation in the order w0, each bias field, P, each categorical block
  of W, each real column of W; a field's codes touch disjoint rows so the
  whole field is one exact block.  The rows carry the residual e, their
  membership p and W x; a block joins only its own table, and what its change
  makes of e, p and W x is written with the rows (:class:`Generations`).  All
  real columns are solved, one after the other, from the one Gram of p (x) x.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_init, crng_init_np
from dyadic.operators.prep import minibatch_column
from dyadic.operators.epochs import Epochs
from dyadic.operators.iterate import History, cut, group_sums
from dyadic.operators.keyed import Generations, Homes, Lookups, prepare, settle
from dyadic.operators.score import profile_score
from dyadic.operators.stats import moment_matrix


@dataclass
class ProfileModel:
    k: int
    w0: float
    biases: dict            # field -> DataFrame(field, b)
    profiled: str
    P: DataFrame            # (profiled, vec)
    Wcat: dict              # field -> DataFrame(field, wvec)
    reals: list
    Wr: np.ndarray          # k x r
    sizes: dict = field(default_factory=dict)   # table rows (broadcast decisions)
    learn_w0: bool = True
    salt: object = None     # SaltPlan of the training rows for a P too large to broadcast

    def widths(self) -> dict:
        """Per key the rows and the numbers to a row of the tables it reaches."""
        out = {}
        for fields, n in ((self.biases, 1), ([self.profiled], self.k), (self.Wcat, self.k)):
            for f in fields:
                out[f] = (self.sizes.get(f), out.get(f, (0, 0))[1] + n)
        return out

    def predict(self, rows: DataFrame, keep_parts: bool = False, looks: Lookups | None = None) -> DataFrame:
        return profile_score(
            rows, self.k, self.w0,
            {f: (t, self.sizes.get(f)) for f, t in self.biases.items()},
            self.profiled, (self.P, self.sizes.get(self.profiled)), None,
            {f: (t, self.sizes.get(f)) for f, t in self.Wcat.items()},
            self.reals, self.Wr if len(self.reals) else None, keep_parts, looks)

    def tables(self) -> dict:
        out = {"P": self.P}
        out.update({f"b_{f}": t for f, t in self.biases.items()})
        out.update({f"W_{f}": t for f, t in self.Wcat.items()})
        return out


class NotFittedError(RuntimeError):
    pass


def init_profile_model(ids: dict, k: int, bias_fields: Sequence[str], profiled: str,
                       cat_fields: Sequence[str], reals: Sequence[str], std: float = 0.01,
                       seed: int = 100, w0: float = 0.0, learn_w0: bool = True,
                       sizes: dict | None = None) -> ProfileModel:
    """Counter-draw initial values (zero-mean, ``std``); ``ids[field]`` is a
    one-column frame of the field's ids / codes."""
    biases = {f: ids[f].select(f, crng_init(f, seed + i, 0, std).alias("b"))
              for i, f in enumerate(bias_fields)}
    P = ids[profiled].select(profiled, F.array(*[crng_init(profiled, seed + 10, l, std)
                                                 for l in range(k)]).alias("vec"))
    Wcat = {f: ids[f].select(f, F.array(*[crng_init(f, seed + 20 + i, l, std) for l in range(k)]).alias("wvec"))
            for i, f in enumerate(cat_fields)}
    Wr = np.array([[crng_init_np(j, seed + 40, l, std) for j in range(len(reals))] for l in range(k)])
    sizes = dict(sizes or {})
    for f in {*bias_fields, profiled, *cat_fields}:
        if f not in sizes:  # exact table sizes decide broadcast vs shuffle joins
            sizes[f] = ids[f].count()
    return ProfileModel(k, w0, biases, profiled, P, Wcat, list(reals), Wr.reshape(k, len(reals)),
                        sizes, learn_w0)


def _pen(col, norm: str):
    return F.signum(col) if norm == "l1" else col


def _pen_np(x, norm: str):
    return np.sign(x) if norm == "l1" else x


def _nn(col, nonneg):
    return F.greatest(F.lit(0.0), col) if nonneg else col


def _prepare_rows(rows: DataFrame, m: ProfileModel, target: str, salt_entities, twice: bool = False):
    """(rows with their target and the salts of keys whose tables are not
    broadcast, the model, the lookups).  ``salt_entities``: salt the profiled
    key in any case (True) or never.  ``twice``: a block looks up old and new values."""
    rows = rows.withColumn("__y", F.col(target).cast("double"))
    tables = {f: (n, w * (2 if twice else 1)) for f, (n, w) in m.widths().items()}
    rows, looks = prepare(rows, tables, salted=[m.profiled] if salt_entities else ())
    if salt_entities is False:
        looks.plans.pop(m.profiled, None)
    return rows, replace(m, salt=looks.plans.get(m.profiled)), looks


def _commit(epochs: Epochs, n: int, m: ProfileModel, hist: History) -> None:
    epochs.commit(n, m.tables(), {"w0": m.w0, "Wr": m.Wr, "history": hist.rows})


def _resumed(epochs: Epochs, m: ProfileModel, hist: History) -> tuple[int, ProfileModel]:
    """(last complete epoch, its model); the history is filled in."""
    done = epochs.last()
    if not done:
        return 0, m
    n, values, tables = done
    hist.rows = [tuple(x) for x in values["history"]]
    return n, replace(m, w0=values["w0"], Wr=values["Wr"].reshape(m.k, len(m.reals)), P=tables["P"],
                      biases={f: tables[f"b_{f}"] for f in m.biases}, Wcat={f: tables[f"W_{f}"] for f in m.Wcat})


def _gd_sets(m: ProfileModel):
    k, r = m.k, len(m.reals)
    e = F.col("pred") - F.col("__y")
    g = [e, e * e] + [e * F.col("__pv")[l] * F.col(m.reals[j]) for l in range(k) for j in range(r)]
    sets = [("g", None, g)]
    for f in m.biases:
        sets.append((f"b:{f}", f, [e]))
    sets.append(("P", m.profiled, [e * F.col("__reg")[l] for l in range(k)]))
    for f in m.Wcat:
        sets.append((f"W:{f}", f, [e * F.col("__pv")[l] for l in range(k)]))
    return sets


def _vec_update(old: DataFrame, key: str, col: str, agg: DataFrame, setname: str, k: int,
                step: float, lam: float, norm: str, nonneg: bool) -> DataFrame:
    a = agg.filter(F.col("set") == setname).select(F.col("key").alias("__k"), "n",
                                                    *[F.col(f"v{l}") for l in range(k)])
    j = old.join(a, old[key].cast("long") == a["__k"], "left")
    comps = []
    for l in range(k):
        th = F.col(col)[l]
        g = F.when(F.col("n") > 0, F.col(f"v{l}") / F.col("n")).otherwise(F.lit(0.0))
        touched = F.col("n").isNotNull()
        new = th - F.lit(step) * (g + F.lit(lam) * _pen(th, norm))
        comps.append(_nn(F.when(touched, new).otherwise(th), nonneg))
    return j.select(key, F.array(*comps).alias(col))


def _scalar_update(old: DataFrame, key: str, agg: DataFrame, setname: str, step: float,
                   lam: float, norm: str, nonneg: bool) -> DataFrame:
    a = agg.filter(F.col("set") == setname).select(F.col("key").alias("__k"), "n", "v0")
    j = old.join(a, old[key].cast("long") == a["__k"], "left")
    new = F.col("b") - F.lit(step) * (F.col("v0") / F.col("n") + F.lit(lam) * _pen(F.col("b"), norm))
    return j.select(key, _nn(F.when(F.col("n").isNotNull(), new).otherwise(F.col("b")), nonneg).alias("b"))


def _gd_step(m: ProfileModel, agg: DataFrame, g, step: float, lambda_w: float, lambda_b: float,
             nonneg: bool, norm: str) -> ProfileModel:
    """One averaged step of every parameter from the grouped sums ``agg``."""
    n, k, r = g["n"], m.k, len(m.reals)
    w0 = m.w0
    if m.learn_w0:
        w0 = w0 - step * g["v0"] / n
        w0 = max(0.0, w0) if nonneg else w0
    Wr = m.Wr
    if r:
        grad = np.array([[g[f"v{2 + l * r + j}"] / n for j in range(r)] for l in range(k)])
        Wr = Wr - step * (grad + lambda_w * _pen_np(Wr, norm))
        Wr = np.maximum(0.0, Wr) if nonneg else Wr
    biases = {f: cut(_scalar_update(t, f, agg, f"b:{f}", step, lambda_b, norm, nonneg))
              for f, t in m.biases.items()}
    P = cut(_vec_update(m.P, m.profiled, "vec", agg, "P", k, step, lambda_w, norm, nonneg))
    Wcat = {f: cut(_vec_update(t, f, "wvec", agg, f"W:{f}", k, step, lambda_w, norm, nonneg))
            for f, t in m.Wcat.items()}
    return replace(m, w0=w0, Wr=Wr, biases=biases, P=P, Wcat=Wcat)


def fit_profile_gd(rows: DataFrame, model: ProfileModel, target: str = "y", lrate: float = 0.001,
                   lambda_w: float = 0.01, lambda_b: float = 0.0, iters: int = 10,
                   eps: float = 1e-5, nonneg: bool = False, norm: str = "fro", salt_entities=None,
                   nbatches: int = 1, resume_path: str | None = None):
    """Gradient fit (TR-4 IPR, TR-6 MLR).  Returns (model, history).  Each pass
    is committed to ``resume_path``, where a later call goes on.  With
    ``nbatches`` one pass makes that many steps, each on the rows of one batch
    (SO-3: counter draws on stored row numbers, new batches each pass)."""
    spark = rows.sparkSession
    if nbatches > 1:  # numbers are stored with the rows: no later scan can change them
        rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    rows, m, looks = _prepare_rows(rows, model, target, salt_entities)
    keep = dict.fromkeys([*m.widths(), *m.reals, "__y", *looks.salts(), *(["__row"] if nbatches > 1 else [])])
    rows, looks = settle(rows.select(*keep), looks, m.widths())
    hist, gens, epochs = History(eps), Generations(spark, "batches"), Epochs(spark, resume_path)
    step = 2.0 * lrate
    first, m = _resumed(epochs, m, hist)
    for it in range(first, iters + 1):
        # no step follows the last pass, which sums by no key
        sets = _gd_sets(m) if it < iters and nbatches == 1 else _gd_sets(m)[:1]
        agg = cut(group_sums(m.predict(rows, keep_parts=True, looks=looks), sets))
        g = agg.filter(F.col("set") == "g").first()
        stop = hist.add(it, float(np.sqrt(g["v1"] / g["n"])))
        if stop or it == iters:
            break
        if nbatches == 1:
            m = _gd_step(m, agg, g, step, lambda_w, lambda_b, nonneg, norm)
            _commit(epochs, it + 1, m, hist)
            continue
        # the pass's rows are written by batch, so that a step reads its own only
        dealt = gens.write(rows.withColumn("__batch", minibatch_column(F.col("__row"), F.lit(0), it, nbatches)), by="__batch")
        for b in range(nbatches):
            mine = dealt.filter(F.col("__batch") == b).drop("__batch")
            agg = cut(group_sums(m.predict(mine, keep_parts=True, looks=looks), _gd_sets(m)))
            g = agg.filter(F.col("set") == "g").first()
            if g is not None:
                m = _gd_step(m, agg, g, step, lambda_w, lambda_b, nonneg, norm)
        _commit(epochs, it + 1, m, hist)
    gens.close()
    return m, hist.frame(spark)


# ---------------------------------------------------------------- closed form
def _solve_batched(pdf: pd.DataFrame, k: int, lam: float, key: str, out: str, nonneg: bool) -> pd.DataFrame:
    G = np.zeros((len(pdf), k, k))
    for a in range(k):
        for b in range(a, k):
            G[:, a, b] = G[:, b, a] = pdf[f"g_{a}_{b}"].to_numpy()
    c = np.stack([pdf[f"b_{a}"].to_numpy() for a in range(k)], axis=1)
    G = G + np.diag(np.broadcast_to(np.asarray(lam, dtype=float), (k,)))[None, :, :]
    x = np.linalg.solve(G, c[:, :, None])[:, :, 0]
    if nonneg:
        x = np.maximum(0.0, x)
    return pd.DataFrame({key: pdf[key].to_numpy(), out: list(x)})


def solve_grams(grams: DataFrame, key: str, k: int, lam, out: str, nonneg: bool = False) -> DataFrame:
    """Per key (g_a_b, b_a): the solution of (G + lam I) v = b.  The Grams are
    JVM sums; only the k x k solve per key runs in numpy on executors."""
    schema = f"`{key}` {dict(grams.dtypes)[key]}, `{out}` array<double>"
    return grams.mapInPandas(lambda it: (_solve_batched(p, k, lam, key, out, nonneg) for p in it), schema)


def objective(m: ProfileModel, sse: float, lambda_w: float, lambda_b: float) -> float:
    reg = 0.0
    from dyadic.functions.arrays import norm2_k
    reg += lambda_w * (m.P.agg(F.sum(norm2_k("vec", m.k))).first()[0] or 0.0)
    for t in m.Wcat.values():
        reg += lambda_w * (t.agg(F.sum(norm2_k("wvec", m.k))).first()[0] or 0.0)
    reg += lambda_w * float(np.sum(m.Wr ** 2))
    for t in m.biases.values():
        reg += lambda_b * (t.agg(F.sum(F.col("b") * F.col("b"))).first()[0] or 0.0)
    return sse + reg


def fit_profile_cd(rows: DataFrame, model: ProfileModel, target: str = "y", lambda_w: float = 0.01,
                   lambda_b: float = 0.0, sweeps: int = 10, eps: float = 1e-5, nonneg: bool = False,
                   track_objective: bool = False, salt_entities=None, resume_path: str | None = None):
    """Exact block coordinate descent / ALS (TR-5 IPR, TR-7 MLR):
    theta <- sum((r + theta beta) beta) / (lambda + sum beta^2) in block form,
    r = y - y_hat.  Returns (model, history)."""
    spark = rows.sparkSession
    rows, m, looks = _prepare_rows(rows, model, target, salt_entities, twice=True)
    hist, gens, epochs = History(eps), Generations(spark, "profile-rows"), Epochs(spark, resume_path)
    first, m = _resumed(epochs, m, hist)
    k, r = m.k, len(m.reals)
    p, g = [f"__p{l}" for l in range(k)], [f"__g{l}" for l in range(k)]
    keep = list(dict.fromkeys([*m.widths(), *m.reals, *looks.salts()]))
    homes = bool(looks.plans)
    if homes:
        rows, looks = settle(rows.select(*keep, "__y"), looks, m.widths())
        keep = list(dict.fromkeys([*keep, *looks.salts()]))

    def scored(mm):
        """The rows under the model's present tables: residual, membership, W x."""
        if homes:
            for f, t in mm.biases.items():
                looks.pin(f, t)
            for f, t in mm.Wcat.items():
                looks.pin(f, t)
        s = mm.predict(rows, keep_parts=True, looks=looks)
        return s.select(*keep, (F.col("__y") - F.col("pred")).alias("__e"), *[F.col("__pv")[l].alias(p[l]) for l in range(k)],
                        *[F.col("__reg")[l].alias(g[l]) for l in range(k)])

    def moved(mm, new):
        """Rows at home are scored anew in the next pass, which moves nothing;
        others are written as ``new`` makes them."""
        return scored(mm) if homes else gens.write(new())

    state = scored(m) if homes else gens.write(scored(m).hint("rebalance"))

    def record(it, mm, s):
        a = s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("sse"), F.avg("__e").alias("mean")).first()
        obj = objective(mm, a["sse"], lambda_w, lambda_b) if track_objective else None
        return it > first and hist.add(it, float(np.sqrt(a["sse"] / a["n"])), None, obj), a["mean"]

    def block(f, table, col, z, held=None):
        """The exact block of one vector table: (new table, how rows get the
        change ``__d`` of their code)."""
        own = table.select(f, *[F.col(col)[l].alias(f"v{l}") for l in range(k)])
        s = state if held is not None else looks.attach(state, f, own, {f"v{l}": f"__o{l}" for l in range(k)})
        old = held if held is not None else [F.coalesce(f"__o{l}", F.lit(0.0)) for l in range(k)]
        mine = sum((old[l] * z[l] for l in range(k)), F.lit(0.0))
        new = solve_grams(looks.gram(s, f, z, e + mine), f, k, lambda_w, "__new", nonneg)
        j = own.join(new, f, "left")
        to = [F.coalesce(F.col("__new")[l], F.col(f"v{l}")) for l in range(k)]
        change = cut(j.select(f, F.array(*to).alias(col), *[(to[l] - F.col(f"v{l}")).alias(f"d{l}") for l in range(k)]))
        def far():
            return looks.attach(state, f, change, {f"d{l}": f"__d{l}" for l in range(k)})
        d = [F.coalesce(f"__d{l}", F.lit(0.0)) for l in range(k)]
        return change.select(f, col), far, d

    P_, G_ = [F.col(c) for c in p], [F.col(c) for c in g]
    if not first:
        first = -1  # the starting point belongs to the history
    stop, mean = record(max(first, 0), m, state)
    for sweep in range(max(first, 0) + 1, sweeps + 1):
        e = F.col("__e")
        if m.learn_w0:
            w0 = m.w0 + mean
            w0 = max(0.0, w0) if nonneg else w0
            e = e - F.lit(float(w0 - m.w0))
            m = replace(m, w0=w0)
        for f in list(m.biases):
            # a row without a residual (null target or feature) has no part in sr
            a = looks.sums(state, f, {"se": e, "ne": F.when(e.isNotNull(), 1).otherwise(0), "n": F.lit(1)})
            a = m.biases[f].join(a, f, "left").withColumn("sr", F.col("se") + F.col("ne") * F.col("b"))
            nb = F.col("sr") / (F.col("n") + F.lit(lambda_b))
            j = a.withColumn("__new", F.coalesce(F.greatest(F.lit(0.0), nb) if nonneg else nb, "b"))
            change = cut(j.select(f, F.col("__new").alias("b"), (F.col("__new") - F.col("b")).alias("d")))
            m = replace(m, biases={**m.biases, f: change.select(f, "b")})
            state = moved(m, lambda: looks.attach(state, f, change, {"d": "__d"}).select(  # noqa: B023
                *keep, (e - F.coalesce("__d", F.lit(0.0))).alias("__e"), *p, *g))  # noqa: B023
            e = F.col("__e")
        newP, s, d = block(m.profiled, m.P, "vec", G_, held=P_)
        m = replace(m, P=newP)
        state = moved(m, lambda: s().select(*keep, (e - sum((d[l] * G_[l] for l in range(k)), F.lit(0.0))).alias("__e"),  # noqa: B023
                                            *[(P_[l] + d[l]).alias(p[l]) for l in range(k)], *g))  # noqa: B023
        e = F.col("__e")
        for f in list(m.Wcat):
            newW, s, d = block(f, m.Wcat[f], "wvec", P_)
            m = replace(m, Wcat={**m.Wcat, f: newW})
            state = moved(m, lambda: s().select(*keep, (e - sum((d[l] * P_[l] for l in range(k)), F.lit(0.0))).alias("__e"), *p,  # noqa: B023
                                                *[(G_[l] + d[l]).alias(g[l]) for l in range(k)]))  # noqa: B023
        last = state
        if r:  # each real feature is a field of its own: W[:, j] from the k x k part of the Gram of p (x) x
            px = [P_[l] * F.col(x) for l in range(k) for x in m.reals]
            M = moment_matrix(state, [*px, e])
            A, c, Wr = M[:-1, :-1], M[:-1, -1].copy(), m.Wr.copy()
            for j in range(r):
                at = [l * r + j for l in range(k)]
                w = np.linalg.solve(A[np.ix_(at, at)] + lambda_w * np.eye(k), c[at] + A[np.ix_(at, at)] @ Wr[:, j])
                w = np.maximum(0.0, w) if nonneg else w
                c -= A[:, at] @ (w - Wr[:, j])
                Wr[:, j] = w
            D = Wr - m.Wr
            dreg = [sum((F.lit(float(D[l, j])) * F.col(m.reals[j]) for j in range(r)), F.lit(0.0)) for l in range(k)]
            last = state.select(*keep, (e - sum((P_[l] * dreg[l] for l in range(k)), F.lit(0.0))).alias("__e"), *p,
                                *[(G_[l] + dreg[l]).alias(g[l]) for l in range(k)])
            m = replace(m, Wr=Wr)
            last = scored(m) if homes else last
        stop, mean = record(sweep, m, last)
        _commit(epochs, sweep, m, hist)
        if stop or sweep == sweeps:
            break
        state = last if homes or not r else gens.write(last)
    gens.close()
    return m, hist.frame(spark)
