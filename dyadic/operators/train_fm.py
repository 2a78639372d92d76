"""Factorization machine by alternating least squares (TR-3).

Rows are field coded (one active one-hot column per entity / categorical
field, x = 1) plus real columns.  For a one-hot field the prediction is
linear in the pair (w_c, v_c) of a code c:

    y_hat = const + w_c + v_c . h,   h = q - v_c,   q = sum_j V_j x_j,

and codes of one field touch disjoint rows, so one grouped Gram per field
gives the exact minimiser for every code of the field at once (ridge with
lambda_w on w_c and lambda_v on v_c).

The rows carry their residual e and the vector q.  A block joins only its own
table, for the Grams and again for the change that its new values make to e
and q; every block writes the rows anew (:class:`Generations`).  Rows at home
are scored anew instead, and the first block's sums give the start's RMSE too.

The last fields with small tables and all real columns (the tail) are solved from
one pass.  Without the tail's part, u = q - sum_j V_j x_j and the residual r do
not move while it is solved, and among rows with the same codes (a cell) the
prediction is linear in z = (1, u, x_j, x_j u, x_i x_j).  So sum z z^T, sum z r and
sum r^2 of each cell hold all that the solves, one after the other, need, and the
RMSE after them; they run on the driver.  Tasks read plain columns and make the
products in numpy.  A sweep is w0, each field, each real.  Decisions: true ALS
(no 0.001 factor on V), w0 <- w0 + mean(y - y_hat), all k factors summed in the
two-way term.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_init, crng_init_np
from dyadic.operators.epochs import Epochs
from dyadic.operators.iterate import History, cut
from dyadic.operators.keyed import Generations, prepare, settle
from dyadic.operators.score import fm_score
from dyadic.operators.train_profile import solve_grams

CELL_BYTES = 32 << 20  # of the sums of all cells that the tail's codes may form
CELL_ROWS = 1 << 16    # rows that a task adds up at a time


@dataclass
class FMModel:
    k: int
    w0: float
    fields: dict            # field -> DataFrame(field, w, vec)
    reals: list
    wr: np.ndarray          # (r,)
    Vr: np.ndarray          # r x k
    sizes: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, keep_parts: bool = False, looks=None, own: str | None = None) -> DataFrame:
        return fm_score(rows, self.k, self.w0,
                        {f: (t, self.sizes.get(f)) for f, t in self.fields.items()},
                        self.reals, self.wr, self.Vr, keep_parts, looks, own)


def init_fm_model(ids: dict, k: int, fields, reals, init_std: float = 0.001, seed: int = 300,
                  sizes: dict | None = None) -> FMModel:
    tabs = {f: ids[f].select(f, F.lit(0.0).alias("w"),
                             F.array(*[crng_init(f, seed + i, l, init_std) for l in range(k)]).alias("vec"))
            for i, f in enumerate(fields)}
    r = len(reals)
    Vr = np.array([[crng_init_np(j, seed + 50, l, init_std) for l in range(k)] for j in range(r)]).reshape(r, k)
    sizes = dict(sizes or {})
    for f in fields:
        if f not in sizes:
            sizes[f] = ids[f].count()
    return FMModel(k, 0.0, tabs, list(reals), np.zeros(r), Vr, sizes)


class _Tail:
    """The last fields with small tables and the real columns: their values, their
    part of the prediction as a linear form in z, and their solves from the
    sums of cells.  A field's last place is for codes that its table lacks."""

    def __init__(self, m: FMModel, fields: list):
        self.k, self.reals, self.fields = m.k, m.reals, fields
        self.wr, self.Vr, self.keys, self.w, self.v = m.wr.copy(), m.Vr.copy(), {}, {}, {}
        for f in fields:
            own = m.fields[f].filter(F.col(f).isNotNull()).collect()
            self.keys[f] = [x[f] for x in own]
            self.w[f] = np.array([x["w"] for x in own] + [0.0])
            self.v[f] = np.array([*[x["vec"] for x in own], [0.0] * m.k])
        r = len(self.reals)
        self.pairs = [(i, j) for i in range(r) for j in range(i + 1, r)]
        self.size = self.width(m.k, r)
        self.shape = tuple(len(self.keys[f]) + 1 for f in fields)

    @staticmethod
    def width(k: int, r: int) -> int:
        return 1 + k + r + r * k + r * (r - 1) // 2

    @classmethod
    def of(cls, m: FMModel, small: set) -> list:
        """The last fields, as many as are broadcast and keep the sums of their cells in bounds."""
        out, most = [], CELL_BYTES // (8 * (cls.width(m.k, len(m.reals)) + 1) ** 2)
        for f in reversed(m.fields):
            most //= (m.sizes.get(f) or 0) + 1
            if f not in small or most < 1:
                break
            out.insert(0, f)
        return out

    def places(self, cells: np.ndarray) -> list:
        return list(np.unravel_index(cells, self.shape)) if self.fields else []

    def theta(self, at: list) -> np.ndarray:
        """The form's coefficients over z of the cells with these places (one cell, without fields)."""
        n, r = (len(at[0]) if at else 1), len(self.reals)
        vs = [self.v[f][p] for f, p in zip(self.fields, at, strict=True)]
        s = sum(vs, np.zeros((n, self.k)))
        const = sum((self.w[f][p] for f, p in zip(self.fields, at, strict=True)), np.zeros(n))
        const = const + 0.5 * ((s * s).sum(axis=1) - sum(((v * v).sum(axis=1) for v in vs), np.zeros(n)))
        rest = [self.Vr.reshape(-1), np.array([self.Vr[i] @ self.Vr[j] for i, j in self.pairs])]
        return np.concatenate([const[:, None], s, self.wr + s @ self.Vr.T, np.broadcast_to(np.concatenate(rest), (n, r * self.k + len(self.pairs)))], axis=1)

    def z(self, u: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = len(u)
        return np.concatenate([np.ones((n, 1)), u, x, (x[:, :, None] * u[:, None, :]).reshape(n, -1),
                               *[(x[:, i] * x[:, j])[:, None] for i, j in self.pairs]], axis=1)

    def _others(self, at: list) -> np.ndarray:
        return sum((self.v[f][p] for f, p in zip(self.fields, at, strict=True)), np.zeros((len(at[0]) if at else 1, self.k)))

    def solve(self, cells: np.ndarray, H: np.ndarray, b: np.ndarray, rest: np.ndarray, lacking: np.ndarray, lam: list) -> None:
        """Each field's and each real's exact block.  ``H``, ``b``: sums z z^T and
        z r of the rows with a residual.  Rows without one count in the Grams of
        fields: ``rest``, sums z z^T of those that have z, ``lacking``, number of others."""
        k, r, at, d = self.k, len(self.reals), self.places(cells), 1 + self.k
        for f, p in zip(self.fields, at, strict=True):
            w, v = self.w[f], self.v[f]
            self.w[f], self.v[f] = np.zeros_like(w), np.zeros_like(v)
            B = np.zeros((len(cells), d, self.size))
            B[:, 0, 0] = 1.0
            B[:, 1:, 0] = self._others(at)
            B[:, 1:, 1:1 + k] = np.eye(k)
            B[:, 1:, 1 + k:1 + k + r] = self.Vr.T
            G, c, n = np.zeros((len(w), d, d)), np.zeros((len(w), d)), np.zeros(len(w))
            np.add.at(G, p, B @ (H + rest) @ B.transpose(0, 2, 1))
            np.add.at(G[:, 0, 0], p, lacking)
            np.add.at(c, p, np.einsum("cab,cb->ca", B, b - np.einsum("cab,cb->ca", H, self.theta(at))))
            np.add.at(n, p, H[:, 0, 0])
            n[-1] = 0.0
            own = np.flatnonzero(n)  # a code without a residual keeps its values
            sol = np.linalg.solve(G[own] + np.diag(lam), c[own][:, :, None])[:, :, 0]
            w[own], v[own] = sol[:, 0], sol[:, 1:]
            self.w[f], self.v[f] = w, v
        for j in range(r):
            self.wr[j], self.Vr[j] = 0.0, 0.0
            B = np.zeros((len(cells), d, self.size))
            B[:, 0, 1 + k + j] = 1.0
            B[:, 1:, 1 + k + j] = self._others(at)
            for l in range(k):
                B[:, 1 + l, 1 + k + r + j * k + l] = 1.0
                for n, (a, c) in enumerate(self.pairs):
                    if j in (a, c):
                        B[:, 1 + l, 1 + k + r + r * k + n] = self.Vr[c if a == j else a, l]
            right = np.einsum("cab,cb->a", B, b - np.einsum("cab,cb->ca", H, self.theta(at)))
            sol = np.linalg.solve((B @ H @ B.transpose(0, 2, 1)).sum(axis=0) + np.diag(lam), right)
            self.wr[j], self.Vr[j] = sol[0], sol[1:]

    def table(self, spark, f: str, like: DataFrame) -> DataFrame:
        own = [(key, float(w), [float(x) for x in v]) for key, w, v in zip(self.keys[f], self.w[f][:-1], self.v[f][:-1], strict=True)]
        return spark.createDataFrame(own, like.select(f, "w", "vec").schema)


def _cell_sums(state: DataFrame, tail: _Tail, q: list, bare: bool) -> tuple:
    """(cells, H, b, s, rest, lacking) of the rows ``state`` with residual ``__e`` and
    ``q``, less the tail's part unless they are ``bare`` of it: by cell sum z z^T, z r
    and r^2 of rows with a residual, sum z z^T of those with z alone, and the number
    of those without.  Each task multiplies the rows of a cell together; its sums
    are added by cell after one exchange."""
    import pyarrow as pa
    import pyarrow.compute as pc
    k, r, d = tail.k, len(tail.reals), tail.size + 1
    ncells, upper, nf = int(np.prod(tail.shape, dtype=np.int64)), np.triu_indices(d), len(tail.fields)
    keys = [tail.keys[f] for f in tail.fields]

    def numbers(cols):
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in cols])
        return known, [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols]

    def sums_of(t: pa.Table, M: np.ndarray) -> None:
        cols = [c.combine_chunks() for c in t.columns]
        at = [pc.index_in(c, value_set=pa.array(own, c.type)).fill_null(len(own)).to_numpy(zero_copy_only=False)
              for c, own in zip(cols[:nf], keys, strict=True)]
        cell = np.ravel_multi_index(at, tail.shape) if nf else np.zeros(t.num_rows, np.int64)
        known, y = numbers(cols[nf:nf + 1])
        whole, xq = numbers(cols[nf + 1:])
        x, u = np.stack(xq[k:], axis=1) if r else np.zeros((len(cell), 0)), np.stack(xq[:k], axis=1)
        res = y[0]
        if not bare:
            u = u - x @ tail.Vr - sum((tail.v[f][p] for f, p in zip(tail.fields, at, strict=True)), np.zeros_like(u))
        z = tail.z(u, x)
        if not bare:
            res = res + (tail.theta(at) * z).sum(axis=1)
        z = np.concatenate([z, res[:, None]], axis=1)
        known &= whole
        z[~known, -1], z[~whole] = 0.0, 0.0
        z[~whole, -1] = 1.0  # counted where rows without a residual have none
        cell = cell + np.where(known, 0, ncells)
        order = np.argsort(cell, kind="stable")
        z, (own, first) = z[order], np.unique(cell[order], return_index=True)
        for c, i, j in zip(own, first, [*first[1:], len(z)], strict=True):
            M[c] += z[i:j].T @ z[i:j]

    def partial(batches):
        M, held, n = np.zeros((2 * ncells, d, d)), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CELL_ROWS:
                sums_of(pa.Table.from_batches(held), M)
                held, n = [], 0
        if n:
            sums_of(pa.Table.from_batches(held), M)
        yield from rows_of({c: M[c][upper] for c in np.flatnonzero((M[:, 0, 0] > 0) | (M[:, -1, -1] > 0))})

    def rows_of(sums: dict):
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())],
                                         names=["cell", "sums"])

    def added(batches):
        sums = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, "<f8")
                sums[c] = sums[c] + x if c in sums else x
        yield from rows_of(sums)

    cols = state.select(*tail.fields, F.col("__e").cast("double"), *q, *[F.col(c).cast("double").alias(c) for c in tail.reals])
    parts = cols.mapInArrow(partial, "cell long, sums binary").repartition("cell")
    M = {c["cell"]: np.frombuffer(c["sums"], "<f8") for c in parts.mapInArrow(added, "cell long, sums binary").collect()}
    cells = np.array(sorted({c % ncells for c in M}), np.int64)
    H = np.zeros((2, len(cells), d, d))
    for n, c in enumerate(cells):
        for half in (0, 1):
            if c + half * ncells in M:
                H[half, n][upper] = M[c + half * ncells]
    H = H + H.transpose(0, 1, 3, 2) * (1 - np.eye(d))
    return cells, H[0, :, :-1, :-1], H[0, :, :-1, -1], H[0, :, -1, -1], H[1, :, :-1, :-1], H[1, :, -1, -1]


def fit_fm_als(rows: DataFrame, model: FMModel, target: str = "y", iters: int = 50,
               threshold: float = 1e-6, lambda_w: float = 0.01, lambda_v: float = 0.1, salted=(),
               resume_path: str | None = None):
    """Returns (model, history).  ``salted``: fields to salt in any case.
    ``resume_path``: each sweep is committed there, and a later call goes on
    behind the last one."""
    spark = rows.sparkSession
    m, k = model, model.k
    r = len(m.reals)
    fields = list(m.fields)
    q = [f"__q{l}" for l in range(k)]
    lam = [lambda_w] + [lambda_v] * k
    gens, hist = Generations(spark, "fm-rows"), History(threshold)
    epochs = Epochs(spark, resume_path)
    done = epochs.last()
    if done:
        m = replace(m, w0=done[1]["w0"], wr=done[1]["wr"], Vr=done[1]["Vr"].reshape(r, k), fields={f: done[2][f"f_{f}"] for f in fields})
        hist.rows = [tuple(x) for x in done[1]["history"]]
    # a block looks up old and new values of its own table
    rows, looks = prepare(rows, {f: (m.sizes.get(f), 2 * (k + 1)) for f in fields}, salted=salted)
    keep = [*fields, *m.reals, *looks.salts()]
    homes = bool(looks.plans)
    if homes:
        rows, looks = settle(rows.select(*dict.fromkeys([*keep, target])), looks, {f: (m.sizes.get(f), k + 1) for f in fields})
        keep = list(dict.fromkeys([*keep, *looks.salts()]))

    tail = _Tail.of(m, looks.small)
    head = [f for f in fields if f not in tail]

    def scored(mm, own=None, names=keep):
        """The rows under the model's present tables: residual and q."""
        if homes:  # the own table changes after this pass
            for f, t in mm.fields.items():
                if f != own:
                    looks.pin(f, t)
        s = mm.predict(rows, keep_parts=True, looks=looks, own=own)
        return s.select(*names, (F.col(target).cast("double") - F.col("pred")).alias("__e"), *[F.col("__q")[l].alias(q[l]) for l in range(k)],
                        *(["__ow", *[F.col("__ov")[l].alias(f"__o{l}") for l in range(k)]] if own else []))

    def opening(f):
        """Start and first block of rows at home in one pass: (RMSE, mean, Grams
        of ``f`` with the mean taken off the residuals)."""
        s = scored(m, own=f)
        x, y, d = [F.col(f"__z{a}") for a in range(k + 1)], F.col("__zr"), k + 1
        pairs = [(a, b) for a in range(d) for b in range(a, d)]
        aggs = {"n": F.lit(1).cast("long"), "s": y * y, **{f"c_{a}": x[a] * y for a in range(d)}, **{f"g_{a}_{b}": x[a] * x[b] for a, b in pairs},
                **{f"r_{a}_{b}": F.when(y.isNotNull(), x[a] * x[b]) for a, b in pairs}}  # of rows with a residual
        g = cut(looks.sums(s, f, aggs, {"__z0": F.lit(1.0), **{f"__z{l + 1}": F.col(q[l]) - F.col(f"__o{l}") for l in range(k)}, "__zr": F.col("__e")}))
        t = g.agg(*[F.sum(c).alias(c) for c in ("s", "c_0", "r_0_0")]).first()
        mean = t["c_0"] / t["r_0_0"]
        own = m.fields[f].select(f, "w", "vec")
        theta = [F.col("w") - F.lit(mean), *[F.col("vec")[l] for l in range(k)]]
        mine = {f"b_{a}": F.col(f"c_{a}") + sum((theta[b] * F.col(f"r_{min(a, b)}_{max(a, b)}") for b in range(d)), F.lit(0.0)) for a in range(d)}
        return float(np.sqrt(t["s"] / t["r_0_0"])), mean, g.join(own, f).select(f, "n", *[f"g_{a}_{b}" for a, b in pairs], *[c.alias(n) for n, c in mine.items()])

    first = 1 + (done[0] if done else 0)
    opens = homes and bool(head) and first <= iters
    state = (None if opens else scored(m)) if homes else gens.write(scored(m).hint("rebalance"))

    def record(it, s, again=False):
        g = s.agg(F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("mean")).first()
        return not again and hist.add(it, float(g["rmse"])), g["mean"]

    if not opens:
        stop, mean = record(0, state, again=bool(done))
    for it in range(first, iters + 1):
        if opens and it == first:
            rmse, mean, grams = opening(head[0])
            if not done:
                hist.add(0, rmse)
        m = replace(m, w0=m.w0 + mean)
        e = F.col("__e") if homes else F.col("__e") - F.lit(float(mean))
        for f in head:
            own = m.fields[f].select(f, "w", *[F.col("vec")[l].alias(f"v{l}") for l in range(k)])
            if opens and it == first and f == head[0]:
                g = grams
            else:
                if homes:  # rows at home are scored anew, which moves none
                    s = scored(m, own=f)
                else:
                    s = looks.attach(state, f, own, {"w": "__ow", **{f"v{l}": f"__o{l}" for l in range(k)}})
                h = [F.col(q[l]) - F.col(f"__o{l}") for l in range(k)]
                mine = F.col("__ow") + sum((F.col(f"__o{l}") * h[l] for l in range(k)), F.lit(0.0))
                g = looks.gram(s, f, [F.lit(1.0), *h], e + mine)
            new = solve_grams(g, f, k + 1, lam, "__wv")
            j = own.join(new, f, "left")
            change = cut(j.select(f, "w", *[f"v{l}" for l in range(k)],
                                  (F.coalesce(F.col("__wv")[0], F.col("w")) - F.col("w")).alias("dw"),
                                  *[(F.coalesce(F.col("__wv")[l + 1], F.col(f"v{l}")) - F.col(f"v{l}")).alias(f"d{l}") for l in range(k)]))
            m = replace(m, fields={**m.fields, f: change.select(f, (F.col("w") + F.col("dw")).alias("w"),
                                                                F.array(*[F.col(f"v{l}") + F.col(f"d{l}") for l in range(k)]).alias("vec"))})
            if homes:
                continue
            s = looks.attach(state, f, change, {"dw": "__dw", **{f"v{l}": f"__o{l}" for l in range(k)}, **{f"d{l}": f"__d{l}" for l in range(k)}})
            moved = F.col("__dw") + sum((F.col(f"__d{l}") * (F.col(q[l]) - F.col(f"__o{l}")) for l in range(k)), F.lit(0.0))
            state = gens.write(s.select(*keep, (e - F.coalesce(moved, F.lit(0.0))).alias("__e"),
                                        *[(F.col(q[l]) + F.coalesce(F.col(f"__d{l}"), F.lit(0.0))).alias(q[l]) for l in range(k)]))
            e = F.col("__e")
        if tail or r:
            t = _Tail(m, tail)
            if homes:  # the head's part alone
                s = scored(replace(m, fields={f: m.fields[f] for f in head}, reals=[], wr=m.wr[:0], Vr=m.Vr[:0]), names=[*tail, *m.reals])
            else:
                s = state.withColumn("__e", e)
            cells, H, b, ss, *rest = _cell_sums(s, t, q, bare=homes)
            t.solve(cells, H, b, *rest, lam)
            m = replace(m, wr=t.wr, Vr=t.Vr, fields={**m.fields, **{f: t.table(spark, f, m.fields[f]) for f in tail}})
            w, n = t.theta(t.places(cells)), H[:, 0, 0].sum()
            mean = float((b[:, 0] - np.einsum("cb,cb->c", H[:, 0], w)).sum() / n)
            sse = float((ss - 2.0 * (w * b).sum(axis=1) + np.einsum("ca,cab,cb->c", w, H, w)).sum())
            stop = hist.add(it, float(np.sqrt(max(sse, 0.0) / n)))
        else:
            state = scored(m) if homes else state
            stop, mean = record(it, state)
        epochs.commit(it, {f"f_{f}": t for f, t in m.fields.items()}, {"w0": m.w0, "wr": m.wr, "Vr": m.Vr, "history": hist.rows})
        if stop or it == iters:
            break
        if not homes and (tail or r):
            state = gens.write(scored(m))
    gens.close()
    return replace(m, fields={f: cut(t) for f, t in m.fields.items()}), hist.frame(spark)
