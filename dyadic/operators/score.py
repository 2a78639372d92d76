"""Scoring jobs (SC-1..5).

Rows reach their parameters by equi joins on ids / field codes; every
parameter table is keyed, so a row never builds a p-wide vector.  Small
tables (field dictionaries, categorical blocks) are broadcast by their exact
size, entity tables join by shuffle (AQE splits a skewed key).  Real-valued
weights are k x r literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadic.functions.arrays import arr_dot, arr_scale, dot_k
from dyadic.functions.scalar import clip
from dyadic.operators.joins import sized_broadcast


def _zeros(k: int) -> Column:
    return F.array(*[F.lit(0.0)] * k)


def attach(rows: DataFrame, key: str, table: DataFrame, cols: Mapping[str, str],
           nrows: int | None = None, k: int | None = None, looks=None) -> DataFrame:
    """Left-join ``table`` (``key`` + value columns) and rename its value
    columns by ``cols`` (source -> new).  Missing ids give 0 / zero vectors.
    ``looks``: the lookups of prepared rows, which know the strategy."""
    t = table.select(F.col(key), *[F.col(s).alias(d) for s, d in cols.items()])
    if looks is not None:
        out = looks.attach(rows, key, table, cols)
    else:
        out = rows.join(sized_broadcast(t, nrows, width=k), key, "left")
    fills = {}
    for d in cols.values():
        is_vec = dict(t.dtypes)[d].startswith("array")
        fills[d] = F.coalesce(F.col(d), _zeros(k) if is_vec else F.lit(0.0))
    return out.withColumns(fills)


def real_comps(reals: Sequence[str], Wr: np.ndarray | None) -> list | None:
    """The k components of W_r x_r for real features; Wr is k x r."""
    if Wr is None or not len(reals):
        return None
    Wr = np.asarray(Wr, dtype=float)
    comps = []
    for l in range(Wr.shape[0]):
        e = None
        for j, r in enumerate(reals):
            t = F.lit(float(Wr[l, j])) * F.col(r)
            e = t if e is None else e + t
        comps.append(e)
    return comps


def real_block(reals: Sequence[str], Wr: np.ndarray | None) -> Column | None:
    """k-vector W_r x_r as an array column."""
    c = real_comps(reals, Wr)
    return None if c is None else F.array(*c)


def score_factors(rows: DataFrame, U: DataFrame, I: DataFrame, mean: float,
                  uid: str = "uid", iid: str = "iid", bounds=(0.0, 5.0),
                  nusers: int | None = None, nitems: int | None = None,
                  how: str = "left", k: int | None = None) -> DataFrame:
    """clip(w_u[u] . w_i[i] + mean) (SC-1); U / I are (id, vec).  Rows whose
    user or item has no factors stay, with the mean and ``is_cold``."""
    out = (rows.join(sized_broadcast(U.select(uid, F.col("vec").alias("__u")), nusers, width=k), uid, how)
               .join(sized_broadcast(I.select(iid, F.col("vec").alias("__i")), nitems, width=k), iid, how))
    cold = F.col("__u").isNull() | F.col("__i").isNull()
    pred = (F.when(cold, F.lit(0.0)).otherwise(dot_k("__u", "__i", k) if k else arr_dot("__u", "__i"))
            + F.lit(float(mean)))
    if bounds is not None:
        pred = clip(pred, bounds[0], bounds[1])
    return out.withColumns({"pred": pred, "is_cold": cold}).drop("__u", "__i")


def profile_score(rows: DataFrame, k: int, w0: float = 0.0,
                  biases: Mapping[str, tuple[DataFrame, int | None]] | None = None,
                  profiled: str | None = None, P: tuple[DataFrame, int | None] | None = None,
                  shared_p: np.ndarray | None = None,
                  Wcat: Mapping[str, tuple[DataFrame, int | None]] | None = None,
                  reals: Sequence[str] = (), Wr: np.ndarray | None = None,
                  keep_parts: bool = False, looks=None) -> DataFrame:
    """w0 + sum_e b_e[id_e] + P[i]^T (W x) (SC-2, SC-3, SC-5 means).

    ``biases``: field -> ((field, b) table, rows); ``P``: ((profiled, vec), rows)
    or ``shared_p`` (one membership for all, the non-personalised variant);
    ``Wcat``: categorical field -> ((field, wvec) table, rows); ``Wr``: k x r."""
    out = rows
    bias_cols = []
    for i, (f, (tab, n)) in enumerate((biases or {}).items()):
        out = attach(out, f, tab, {"b": f"__b{i}"}, n, looks=looks)
        bias_cols.append(F.col(f"__b{i}"))
    wcols = []
    for i, (f, (tab, n)) in enumerate((Wcat or {}).items()):
        out = attach(out, f, tab, {"wvec": f"__w{i}"}, n, k, looks)
        wcols.append(F.col(f"__w{i}"))
    rc = real_comps(reals, Wr)
    regc = []
    for l in range(k):
        e = None if rc is None else rc[l]
        for c in wcols:
            e = c[l] if e is None else e + c[l]
        regc.append(F.lit(0.0) if e is None else e)
    reg = F.array(*regc)
    if shared_p is not None:
        pvec = F.array(*[F.lit(float(v)) for v in shared_p])
    else:
        tab, n = P
        out = attach(out, profiled, tab, {"vec": "__p"}, n, k, looks)
        pvec = F.col("__p")
    out = out.withColumn("__reg", reg).withColumn("__pv", pvec)
    bias = F.lit(0.0)
    for b in bias_cols:
        bias = bias + b
    pred = F.lit(float(w0)) + bias + dot_k("__pv", "__reg", k)
    out = out.withColumn("pred", pred)
    drop = [c for c in out.columns if c.startswith("__b") or c.startswith("__w") or c == "__p"]
    if keep_parts:
        return out.drop(*drop)
    return out.drop(*drop, "__reg", "__pv")


def fm_score(rows: DataFrame, k: int, w0: float,
             fields: Mapping[str, tuple[DataFrame, int | None]],
             reals: Sequence[str] = (), wr: np.ndarray | None = None,
             Vr: np.ndarray | None = None, keep_parts: bool = False, looks=None, own: str | None = None) -> DataFrame:
    """Factorization machine (SC-4), all k factors:
    w0 + sum_j w_j x_j + 1/2 sum_f [(sum_j V_jf x_j)^2 - sum_j V_jf^2 x_j^2].

    ``fields``: one-hot field -> ((field, w, vec) table, rows); a row has x=1 on
    its code.  ``wr`` (r,) and ``Vr`` (r x k) weight the real columns.  ``own``: the
    field whose w and vec stay with the rows, as ``__ow`` and ``__ov``."""
    out = rows
    lin = F.lit(float(w0))
    q = [None] * k
    sq = [None] * k

    def acc(lst, l, term):
        lst[l] = term if lst[l] is None else lst[l] + term

    for i, (f, (tab, n)) in enumerate(fields.items()):
        out = attach(out, f, tab, {"w": f"__w{i}", "vec": f"__v{i}"}, n, k, looks)
        if f == own:
            out = out.withColumns({"__ow": F.col(f"__w{i}"), "__ov": F.col(f"__v{i}")})
        lin = lin + F.col(f"__w{i}")
        v = F.col(f"__v{i}")
        for l in range(k):
            acc(q, l, v[l])
            acc(sq, l, v[l] * v[l])
    if len(reals):
        wr = np.asarray(wr, dtype=float)
        Vr = np.asarray(Vr, dtype=float)
        for j, r in enumerate(reals):
            x = F.col(r)
            lin = lin + F.lit(float(wr[j])) * x
            for l in range(k):
                acc(q, l, F.lit(float(Vr[j, l])) * x)
                acc(sq, l, F.lit(float(Vr[j, l] ** 2)) * x * x)
    out = out.withColumn("__q", F.array(*q))
    two = None
    for l in range(k):
        t = F.col("__q")[l] * F.col("__q")[l] - sq[l]
        two = t if two is None else two + t
    out = out.withColumn("pred", lin + F.lit(0.5) * two)
    drop = [c for c in out.columns if c.startswith("__w") or c.startswith("__v")]
    return out.drop(*drop) if keep_parts else out.drop(*drop, "__q")


def gaussian_draw(mean_col, std: float, id_col, stream: int, draw_col) -> Column:
    """N(mean, std^2) per row from two counter draws (Box-Muller)."""
    from dyadic.functions.crng import crng_uniform
    u1 = F.greatest(crng_uniform(id_col, F.lit(stream), draw_col), F.lit(1e-300))
    u2 = crng_uniform(id_col, F.lit(stream + 1), draw_col)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)
    return mean_col + F.lit(float(std)) * z


__all__ = ["attach", "score_factors", "profile_score", "fm_score", "gaussian_draw",
           "arr_scale"]
