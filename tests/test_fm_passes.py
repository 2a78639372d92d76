"""One pass for the FM's small fields and reals: what it reads, and that the fit stays."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadic.operators import train_fm
from dyadic.operators.iterate import cut
from dyadic.operators.keyed import Homes, Lookups
from dyadic.operators.train_fm import fit_fm_als, init_fm_model

FIELDS, REALS = ["uid", "iid", "cat", "kind"], ["x0", "x1"]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    """Rows at home change a setting of the session, on which plans of other tests hang."""
    yield
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that come twice, lack a target, a real or a code, or have a code without a table."""
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(0, 1, (n, 2))
    pdf = pd.DataFrame({"row": np.arange(n), "uid": rng.integers(0, 30, n), "iid": rng.integers(0, 20, n), "cat": rng.integers(0, 4, n),
                        "kind": rng.integers(0, 3, n), "x0": x[:, 0], "x1": x[:, 1]})
    pdf["y"] = 2.0 + 0.1 * pdf.uid + 0.4 * pdf["cat"] * x[:, 0] + 0.3 * x[:, 0] * x[:, 1] + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pd.concat([pdf, pdf[:50]]))
    return df.withColumns({"y": F.when((F.col("row") % 11 > 0) & (F.col("cat") != 3), F.col("y")), "x1": F.when(F.col("row") % 13 > 0, F.col("x1")),
                           "cat": F.when(F.col("row") % 7 > 0, F.col("cat")), "uid": F.when(F.col("row") % 17 > 0, F.col("uid"))}).repartition(5).persist()


def _model(df):
    ids = {f: cut(df.select(f).distinct().filter(f"{f} is not null and ({f} <> 2 or '{f}' <> 'kind')")) for f in FIELDS}
    return init_fm_model(ids, 2, FIELDS, REALS, init_std=0.1)


def _values(m, h):
    tabs = [m.fields[f].orderBy(f).toPandas() for f in FIELDS]
    return [h.orderBy("iter").toPandas()["train_rmse"].to_numpy(), np.array([m.w0]), m.wr, m.Vr,
            *[t["w"].to_numpy() for t in tabs], *[np.stack(t["vec"]) for t in tabs]]


def _plain(df, m0, iters, lam):
    """The fit by plain sums over the rows, one block after the other."""
    p = df.toPandas()
    k, X = m0.k, p[REALS].to_numpy(dtype=float)
    tabs = {f: {r[f]: np.array([r["w"], *r["vec"]]) for r in t.collect()} for f, t in m0.fields.items()}
    w0, real = m0.w0, np.concatenate([m0.wr[:, None], m0.Vr], axis=1).copy()
    none = np.zeros(1 + k)

    def parts():
        P = [np.stack([tabs[f].get(c, none) for c in p[f]]) for f in FIELDS] + [X[:, [j]] * real[j] for j in range(len(REALS))]
        q = sum(a[:, 1:] for a in P)
        y = w0 + sum(a[:, 0] for a in P) + 0.5 * ((q * q).sum(axis=1) - sum((a[:, 1:] ** 2).sum(axis=1) for a in P))
        return P, q, p["y"].to_numpy() - y

    def solved(z, r):
        G = np.array([[np.nansum(z[:, a] * z[:, b]) for b in range(1 + k)] for a in range(1 + k)])
        return np.linalg.solve(G + np.diag(lam), np.nansum(z * r[:, None], axis=0))

    hist = [np.sqrt(np.nanmean(parts()[2] ** 2))]
    for _ in range(iters):
        w0 += np.nanmean(parts()[2])
        for i, f in enumerate(FIELDS):
            P, q, e = parts()
            z = np.concatenate([np.ones((len(p), 1)), q - P[i][:, 1:]], axis=1)
            r = e + (P[i] * z).sum(axis=1)
            for c in tabs[f]:
                at = (p[f] == c).to_numpy()
                if not np.isnan(r[at]).all():
                    tabs[f][c] = solved(z[at], r[at])
        for j in range(len(REALS)):
            P, q, e = parts()
            z = X[:, [j]] * np.concatenate([np.ones((len(p), 1)), q - P[len(FIELDS) + j][:, 1:]], axis=1)
            whole = ~np.isnan(e)
            real[j] = solved(z[whole], (e + (z * real[j]).sum(axis=1))[whole])
        hist.append(np.sqrt(np.nanmean(parts()[2] ** 2)))
    order = {f: sorted(tabs[f]) for f in FIELDS}
    return [np.array(hist), np.array([w0]), real[:, 0], real[:, 1:], *[np.array([tabs[f][c][0] for c in order[f]]) for f in FIELDS],
            *[np.stack([tabs[f][c][1:] for c in order[f]]) for f in FIELDS]]


@pytest.mark.parametrize("salted", [(), ("uid", "iid")])
@pytest.mark.parametrize("cells", [train_fm.CELL_BYTES, 0, 8 * 15 ** 2 * 20])
def test_the_fit_is_that_of_plain_sums(odd, monkeypatch, salted, cells):
    monkeypatch.setattr(train_fm, "CELL_BYTES", cells)
    monkeypatch.setattr(train_fm, "CELL_ROWS", 64)
    m0 = _model(odd)
    got = _values(*fit_fm_als(odd, m0, iters=2, threshold=-1.0, lambda_w=0.5, lambda_v=0.3, salted=salted))
    for a, b in zip(got, _plain(odd, m0, 2, [0.5, 0.3, 0.3]), strict=True):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("kind,salted", [(Lookups, ()), (Homes, ("uid", "iid"))])
def test_small_fields_and_reals_take_one_pass(odd, monkeypatch, kind, salted):
    asked, seen = [], []
    by_key, sums = kind.sums, train_fm._cell_sums
    monkeypatch.setattr(kind, "sums", lambda self, rows, key, *a: (asked.append(key), by_key(self, rows, key, *a))[1])
    monkeypatch.setattr(train_fm, "_cell_sums", lambda s, t, *a, **b: (seen.append((t.fields, t.reals)), sums(s, t, *a, **b))[1])
    monkeypatch.setattr(train_fm, "CELL_BYTES", 8 * 15 ** 2 * 5 * 4)
    fit_fm_als(odd, _model(odd), iters=1, lambda_w=1.0, lambda_v=1.0, salted=salted)
    assert asked == ["uid", "iid"] and seen == [(["cat", "kind"], REALS)]


def test_rows_at_home_take_one_pass_for_the_start_and_the_first_block(odd, monkeypatch):
    pinned, scored = [], []
    pin, score = Homes.pin, train_fm.fm_score
    monkeypatch.setattr(Homes, "pin", lambda self, key, t: (pin(self, key, t), pinned.append([p[0] for p in self.pinned]))[0])
    monkeypatch.setattr(train_fm, "fm_score", lambda *a, **b: (scored.append(1), score(*a, **b))[1])
    m0 = _model(odd)
    m0 = replace(m0, sizes={**m0.sizes, "iid": 40})  # rows lie by iid
    _, h = fit_fm_als(odd, m0, iters=1, lambda_w=1.0, lambda_v=1.0, salted=("uid", "iid"))
    assert len(scored) == 3 and h.count() == 2  # uid, iid, the rest
    assert pinned[0] == []  # the start's values of the other key are read once and not kept
