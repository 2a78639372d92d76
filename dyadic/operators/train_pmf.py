"""Probabilistic matrix factorisation by minibatch gradient with momentum
(TR-1) and the factor checkpoint sink (SNK-3).

Per batch: the batch's rows join both factor tables, one grouped sum per
side gives sum(2 e v + lambda u) per id, and the (vec, inc) state of every
id moves by  inc = momentum * inc + epsilon * grad / N,  vec -= inc  (ids
outside the batch keep decaying their momentum, as in the reference).
Batches are a counter-draw column (no global shuffle of rows); N is the
actual batch size.  The factor tables are cut into the checkpoint folder
after every batch, so lineage stays one batch long.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.arrays import dot_k, norm2_k, sub_k
from dyadic.functions.crng import crng_init
from dyadic.functions.scalar import clip
from dyadic.operators.epochs import Epochs
from dyadic.operators.iterate import History, cut, group_sums
from dyadic.operators.keyed import Generations, prepare, settle
from dyadic.operators.prep import minibatch_column


@dataclass
class PMFResult:
    U: DataFrame        # (uid, vec)
    I: DataFrame        # (iid, vec)
    mean: float
    history: DataFrame  # (iter=epoch, train_rmse, test_rmse)


def init_factors(ids: DataFrame, key: str, k: int, stream: int, std: float) -> DataFrame:
    return ids.select(key, F.array(*[crng_init(key, stream, l, std) for l in range(k)]).alias("vec"),
                      F.array(*[F.lit(0.0)] * k).alias("inc"))


def pmf_predict(rows: DataFrame, U: DataFrame, I: DataFrame, mean: float, uid="uid", iid="iid",
                bounds=(0.0, 5.0), k: int | None = None) -> DataFrame:
    k = k or len(U.select("vec").first()["vec"])
    j = (rows.join(U.select(uid, F.col("vec").alias("__u")), uid, "left")
             .join(I.select(iid, F.col("vec").alias("__i")), iid, "left"))
    # a user or item without factors: the mean
    p = F.coalesce(dot_k("__u", "__i", k), F.lit(0.0)) + F.lit(float(mean))
    if bounds is not None:
        p = clip(p, bounds[0], bounds[1])
    return j.withColumn("pred", p).drop("__u", "__i")


def _grad(own: str, other: str, k: int, lam: float) -> list:
    return [F.lit(2.0) * F.col("__e") * F.col(other)[l] + F.lit(lam) * F.col(own)[l] for l in range(k)]


def _step(state: DataFrame, sums: DataFrame, name: str, key: str, k: int, n: int, eps: float, mom: float) -> DataFrame:
    g = sums.filter(F.col("set") == name).select(F.col("key").alias("__k"), *[F.col(f"v{l}") for l in range(k)])
    j = state.join(g, state[key].cast("long") == F.col("__k"), "left")
    inc = F.array(*[F.lit(mom) * F.col("inc")[l] +
                    F.lit(eps / n) * F.coalesce(F.col(f"v{l}"), F.lit(0.0)) for l in range(k)])
    j = j.withColumn("inc", inc)
    return j.select(key, sub_k("vec", "inc", k).alias("vec"), "inc")


def fit_pmf(train: DataFrame, test: DataFrame | None, uid="uid", iid="iid", target="y",
            row_id: str = "l_orderkey", row_draw=None, epsilon=50.0, lambda_=0.01, momentum=0.8,
            max_epoch=50, nbatches=9, nf=10, init_std=0.1, seed=71, bounds=(0.0, 5.0),
            checkpoint_every: int = 0, checkpoint_path: str | None = None,
            nusers: int | None = None, nitems: int | None = None,
            resume_path: str | None = None, salted=()) -> PMFResult:
    """Fit w_u, w_i (TR-1).  ``row_id`` / ``row_draw`` feed the counter
    draw that assigns minibatches; ``checkpoint_every`` > 0 writes the
    factors as Parquet ``epoch=N`` under ``checkpoint_path`` (SNK-3).  With
    ``resume_path`` every epoch is committed there, and a fit that finds
    complete epochs goes on behind the last one.  An epoch writes its rows by
    batch once; a batch reads only its own and sums both sides' gradients in
    one shuffle, by key and task first, so no key is bound to a task."""
    spark = train.sparkSession
    row_draw = F.lit(0) if row_draw is None else row_draw
    mean = train.agg(F.avg(target)).first()[0]
    epochs = Epochs(spark, resume_path)
    done = epochs.last()
    rows = train.select(uid, iid, (F.col(target) - F.lit(mean)).alias("__r"),
                        F.col(row_id).alias("__rid"), row_draw.alias("__draw"))
    if done:
        U, I = done[2]["U"], done[2]["I"]
    else:
        ids_u = rows.select(uid) if test is None else rows.select(uid).union(test.select(uid))
        ids_i = rows.select(iid) if test is None else rows.select(iid).union(test.select(iid))
        U = cut(init_factors(ids_u.distinct(), uid, nf, seed, init_std))
        I = cut(init_factors(ids_i.distinct(), iid, nf, seed + 1, init_std))
    nusers = U.count() if nusers is None else nusers
    nitems = I.count() if nitems is None else nitems
    rows, looks = prepare(rows, {uid: (nusers, nf), iid: (nitems, nf)}, salted=salted)
    rows, looks = settle(rows, looks, {uid: (nusers, nf), iid: (nitems, nf)})
    hist, gens = History(), Generations(spark, "pmf-batches")
    hist.rows = [tuple(r) for r in done[1]["history"]] if done else []

    def both(df):
        if looks.plans:
            looks.pin(uid, U), looks.pin(iid, I)
        df = looks.attach(df, uid, U, {"vec": "__u"}, "inner")
        return looks.attach(df, iid, I, {"vec": "__i"}, "inner")

    for epoch in range(done[0] if done else 0, max_epoch):
        b = rows.withColumn("__b", minibatch_column("__rid", F.col("__draw"), epoch, nbatches))
        b = gens.write(b, by="__b") if nbatches > 1 else b
        sizes = {r["__b"]: r["n"] for r in b.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}
        for batch in range(nbatches):
            n = sizes.get(batch, 0)
            if n == 0:
                continue
            j = both(b.filter(F.col("__b") == batch)).withColumn("__e", dot_k("__u", "__i", nf) - F.col("__r"))
            sums = cut(group_sums(j, [("u", uid, _grad("__u", "__i", nf, lambda_)), ("i", iid, _grad("__i", "__u", nf, lambda_))]))
            U, I = (cut(_step(U, sums, "u", uid, nf, n, epsilon, momentum)),
                    cut(_step(I, sums, "i", iid, nf, n, epsilon, momentum)))
        # regularised train RMSE over all train rows, probe RMSE (clipped)
        j = both(rows)
        e = dot_k("__u", "__i", nf) - F.col("__r")
        reg = F.lit(0.5 * lambda_) * (norm2_k("__u", nf) + norm2_k("__i", nf))
        tr = j.agg(F.sqrt(F.avg(e * e + reg))).first()[0]
        te = None
        if test is not None:
            p = pmf_predict(test, U, I, mean, uid, iid, bounds, k=nf)
            te = p.agg(F.sqrt(F.avg((F.col(target) - F.col("pred")) ** 2))).first()[0]
        hist.add(epoch + 1, tr, te)
        if checkpoint_every and checkpoint_path and (epoch + 1) % checkpoint_every == 0:
            save_factors(U, I, checkpoint_path, epoch + 1)
        epochs.commit(epoch + 1, {"U": U, "I": I}, {"history": hist.rows})
    gens.close()
    return PMFResult(U.select(uid, "vec"), I.select(iid, "vec"), mean, hist.frame(spark))


def save_factors(U: DataFrame, I: DataFrame, path: str, epoch: int) -> None:
    """Write both factor tables under ``path/{side}/epoch=N`` (SNK-3)."""
    U.select(F.col(U.columns[0]).alias("id"), "vec").write.mode("overwrite").parquet(
        os.path.join(path, "w_u", f"epoch={epoch}"))
    I.select(F.col(I.columns[0]).alias("id"), "vec").write.mode("overwrite").parquet(
        os.path.join(path, "w_i", f"epoch={epoch}"))
