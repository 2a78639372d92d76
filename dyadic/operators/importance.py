"""Interpretation jobs (IM-1..6, WN-5, SO-1/2).

Every importance is a sum over rows of per-row deviations, so the row frame
is scanned once, per-row terms are computed with column arithmetic inside the
row, and a grouped sum (partial aggregation) collapses them per feature.
Only the final per-feature table (bounded by the number of features x
profiles) is ever small enough to rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadic.operators.iterate import TaskSums, cut
from dyadic.operators.joins import fits_broadcast
from dyadic.operators.score import attach


def fm_importance(rows: DataFrame, k: int, fields: Mapping[str, tuple[DataFrame, int | None]],
                  starts: Mapping[str, int], reals: Sequence[str] = (), wr=None, Vr=None) -> DataFrame:
    """(idx, f, f1, f2): sigma1 = |w_j x_j|,
    sigma2 = x_j^2 sum_{j' != j} |x_j' Z_jj'| / (|x_j| + |x_j'|), Z = V V^T,
    as shares of the total over all rows (IM-1).

    A row has one active entry per one-hot field plus its real columns, so
    the pairs are a fixed set of slots.  Rows look up w and v of their codes;
    a task then takes the pairs of slots for a whole Arrow batch at a time and
    adds the terms up by column of X, so that one row per task and column is
    shuffled; nothing pairs rows with other rows."""
    out, flat = rows, []
    for i, (f, (tab, n)) in enumerate(fields.items()):
        out = attach(out, f, tab, {"w": f"__w{i}", "vec": f"__v{i}"}, n, k)
        flat += [(F.lit(starts[f]) + F.col(f)).cast("long").alias(f"i{i}"), F.col(f"__w{i}").alias(f"w{i}"),
                 *[F.col(f"__v{i}")[l].alias(f"v{i}_{l}") for l in range(k)]]
    nf, nr = len(fields), len(reals)
    wr = np.asarray(wr, dtype=float) if nr else None
    Vr = np.asarray(Vr, dtype=float) if nr else None
    real_at = [int(starts[r]) for r in reals]
    flat += [F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, r in enumerate(reals)]

    def run(batches):
        held = TaskSums([""], 2)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            idx, x, w, v = [], [], [], []
            for i in range(nf):
                at = i * (k + 2)
                idx.append(c[at]), x.append(np.ones(n)), w.append(c[at + 1]), v.append(np.stack(c[at + 2:at + 2 + k]))
            for j in range(nr):
                idx.append(np.full(n, real_at[j], np.int64)), x.append(c[nf * (k + 2) + j])
                w.append(np.full(n, wr[j])), v.append(np.repeat(Vr[j][:, None], n, axis=1))
            s2 = [np.zeros(n) for _ in idx]
            for p in range(len(idx)):
                for q in range(p + 1, len(idx)):
                    both = np.abs(x[p]) + np.abs(x[q])
                    t = np.abs(np.einsum("ln,ln->n", v[p], v[q])) / np.where(both == 0, 1.0, both)
                    s2[p] += np.abs(x[q]) * t
                    s2[q] += np.abs(x[p]) * t
            for p in range(len(idx)):
                on = x[p] != 0
                if on.any():
                    held.add(0, idx[p][on], [np.abs(w[p] * x[p])[on], (x[p] * x[p] * s2[p])[on]])
            yield from held.ready()
        yield from held.rest()
    per = out.select(*flat).mapInArrow(run, TaskSums.schema(2))
    # one row per column of X (entity columns included): materialised once,
    # then divided by the scalar total
    by = cut(per.groupBy(F.col("key").alias("idx")).agg(F.sum("v0").alias("s1"), F.sum("v1").alias("s2")))
    T = by.agg(F.sum(F.col("s1") + F.col("s2"))).first()[0]
    tot = F.lit(float(T))
    return by.select("idx", ((F.col("s1") + F.col("s2")) / tot).alias("f"),
                     (F.col("s1") / tot).alias("f1"), (F.col("s2") / tot).alias("f2"))


def collapse_importance(imp: DataFrame, ranges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum per-column importances back to the source feature (IM-2).  The
    ranges (one row per feature of the guide) become one expression over
    ``idx``, so nothing is joined."""
    name = F.lit(None).cast("string")
    for r in ranges.select("feature", "start", "end").collect():
        name = F.when((F.col("idx") >= r["start"]) & (F.col("idx") < r["end"]), F.lit(r["feature"])).otherwise(name)
    named = imp.withColumn("feature", name).filter(F.col("feature").isNotNull())
    return named.groupBy("feature").agg(*[F.sum(c).alias(c) for c in cols])


def _ipr_sums(rows, k, biases, profiled, P, Wcat, reals, Wr):
    """(entities, features, one row of sums e__<field>, f__<feature>__<l>).  A table
    too large to broadcast does not meet the rows: they are summed by its key
    first, and the sums look it up."""
    out, one, aggs, ents = rows, [], [], list(biases or {})
    for i, (f, (tab, n)) in enumerate((biases or {}).items()):
        if fits_broadcast(tab.schema, n):
            out = attach(out, f, tab, {"b": f"__b{i}"}, n)
            aggs.append(F.sum(F.abs(F.col(f"__b{i}"))).alias(f"e__{f}"))
        else:
            per = attach(rows.groupBy(f).agg(F.count(F.lit(1)).alias("__n")), f, tab, {"b": "__b"}, n)
            one.append(per.agg(F.sum(F.abs(F.col("__b")) * F.col("__n")).alias(f"e__{f}")))
    terms = []  # (feature, [per-l deviation beside |P_l|])
    for i, (f, (tab, n)) in enumerate((Wcat or {}).items()):
        out = attach(out, f, tab, {"wvec": f"__w{i}"}, n, k)
        terms.append((f, [F.abs(F.col(f"__w{i}")[l]) for l in range(k)]))
    Wr = np.asarray(Wr, dtype=float) if len(reals) else None
    for j, r in enumerate(reals):
        terms.append((r, [F.lit(abs(float(Wr[l, j]))) * F.abs(F.col(r)) for l in range(k)]))
    tab, n = P
    if fits_broadcast(tab.schema, n, width=k):
        out = attach(out, profiled, tab, {"vec": "__p"}, n, k)
        for f, ts in terms:
            aggs += [F.sum(F.abs(F.col("__p")[l]) * t).alias(f"f__{f}__{l}") for l, t in enumerate(ts)]
    else:
        per = out.groupBy(profiled).agg(*[F.sum(t).alias(f"f__{f}__{l}") for f, ts in terms for l, t in enumerate(ts)])
        per = attach(per, profiled, tab, {"vec": "__p"}, n, k)
        one.append(per.agg(*[F.sum(F.abs(F.col("__p")[l]) * F.col(f"f__{f}__{l}")).alias(f"f__{f}__{l}") for f, _ in terms for l in range(k)]))
    # one scan, and one more per large table; one row of #entities + k * #features sums reaches the driver
    wide = {}
    for a in ([out.agg(*aggs)] if aggs else []) + one:
        wide |= a.first().asDict()
    return ents, [f for f, _ in terms], wide


def ipr_importance(rows: DataFrame, k: int, biases, profiled, P, Wcat, reals=(), Wr=None):
    """Overall (feature, importance) and per-profile (feature, model,
    importance) frames (IM-3, IM-4).  Entity: sum |w_f B|; feature:
    sum_rows sum_l |P_il W_lf x|; both divided by the overall total."""
    ents, feats, wide = _ipr_sums(rows, k, biases, profiled, P, Wcat, reals, Wr)
    T = float(sum(v for v in wide.values() if v is not None))
    spark = rows.sparkSession
    ov, pm = [], []
    for f in ents:
        ov.append((f, wide[f"e__{f}"] / T))
        pm += [(f, l, wide[f"e__{f}"] / T) for l in range(k)]
    for f in feats:
        devs = [wide[f"f__{f}__{l}"] for l in range(k)]
        ov.append((f, sum(devs) / T))
        pm += [(f, l, devs[l] / T) for l in range(k)]
    overall = spark.createDataFrame(ov, "feature string, importance double")
    per_model = spark.createDataFrame(pm, "feature string, model int, importance double")
    return overall, per_model, ents


def profile_membership(rows: DataFrame, k: int, profiled, P, Wcat, reals=(), Wr=None) -> DataFrame:
    """M(i, l) = sum_rows |P_il (W x)_l| / sum_rows sum_l' |P_il' (W x)_l'|
    per entity i (IM-5)."""
    from dyadic.operators.score import profile_score
    s = profile_score(rows, k, 0.0, None, profiled, P, None, Wcat, reals, Wr, keep_parts=True)
    contrib = [F.abs(F.col("__pv")[l] * F.col("__reg")[l]) for l in range(k)]
    per = s.groupBy(profiled).agg(*[F.sum(c).alias(f"m{l}") for l, c in enumerate(contrib)])
    tot = sum((F.col(f"m{l}") for l in range(k)), F.lit(0.0))
    return per.select(profiled, F.explode(F.array(*[
        F.struct(F.lit(l).alias("model"), (F.col(f"m{l}") / tot).alias("membership"))
        for l in range(k)])).alias("e")).select(profiled, "e.*")


def mlr_importance(rows: DataFrame, k: int, uid: str, iid: str, s: tuple, c: tuple, P: tuple,
                   features: Sequence[str], W: np.ndarray) -> DataFrame:
    """User bias sum_rows |s_u| (= sum_u m_u |s_u|), item bias sum_rows |c_i|,
    feature j: sum_rows |(P_u^T W)_j| |x_j|, as shares of the total (IM-6)."""
    out = attach(rows, uid, s[0], {"b": "__s"}, s[1])
    out = attach(out, iid, c[0], {"b": "__c"}, c[1])
    out = attach(out, uid, P[0], {"vec": "__p"}, P[1], k)
    W = np.asarray(W, dtype=float)
    aggs = [F.sum(F.abs("__s")).alias("user"), F.sum(F.abs("__c")).alias("item")]
    for j, f in enumerate(features):
        pw = sum((F.col("__p")[l] * float(W[l, j]) for l in range(k)), F.lit(0.0))
        aggs.append(F.sum(F.abs(pw) * F.abs(F.col(f))).alias(f"x__{j}"))
    wide = out.agg(*aggs).first()  # one scan, 2 + #features sums
    names = ["user", "item"] + [f"x__{j}" for j in range(len(features))]
    labels = [uid, iid] + list(features)
    T = float(sum(wide[n] for n in names))
    return rows.sparkSession.createDataFrame(
        [(lab, wide[n] / T) for n, lab in zip(names, labels)], "feature string, importance double")


def importance_rank(imp: DataFrame, col: str = "importance", ascending: bool = False) -> DataFrame:
    """Explicit rank column, 1 = most important (SO-1).  The frame has one
    row per feature."""
    o = F.col(col).asc() if ascending else F.col(col).desc()
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(o, F.col("feature"))))


def profile_rank(per_model: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per-profile rows ordered by the overall feature rank (SO-2)."""
    return (per_model.join(F.broadcast(ranked.select("feature", "rank")), "feature")
                     .orderBy("rank", "model"))
