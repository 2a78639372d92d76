"""DuckDB SQL of whole sampled runs (TR-2, TR-8): the same draws, sweep by
sweep, as common table expressions."""

from __future__ import annotations

import math

from dyadic.functions.crng import crng_uniform_sql
from dyadic.functions.draws import CounterRNG, SqlDraws, inverse_sql, normal_sql, normal_wishart_sql, select_sql, stream_of, times_sql
from dyadic.operators.train_bpmf import ITEM_HYPER, USER_HYPER
from dyadic.operators.train_bpmlr import HYPER_C, HYPER_P, HYPER_S, HYPER_W, NOISE, SHARED_P, START, W_ROWS
from dyadic.plans.common import s6
from dyadic.plans.params import init_sql
from dyadic.plans.registry import SPLIT_SQL
from dyadic.plans.score_queries import REALS, Z_SQL, ZCOLS

K = 2


def _id_normal(key: str, stream: int, a: int, b: int) -> str:
    u1, u2 = (crng_uniform_sql(key, stream, d) for d in (a, b))
    return f"(sqrt(-2.0 * ln(GREATEST({u1}, 1e-300))) * cos({2.0 * math.pi!r} * {u2}))"


def _moments(cols: list, table: str) -> tuple[str, list, list, list]:
    """(subquery, columns, names of mean and covariance) of a table's vectors."""
    k = len(cols)
    sub = ", ".join(["CAST(count(*) AS DOUBLE) AS n"] + [f"sum({c}) AS s_{i}" for i, c in enumerate(cols)]
                    + [f"sum({cols[i]} * {cols[j]}) AS ss_{i}_{j}" for i in range(k) for j in range(i, k)])
    out = [f"s_{i} / n AS x_{i}" for i in range(k)]
    out += [f"(ss_{i}_{j} - s_{i} * s_{j} / n) / (n - 1) AS sb_{i}_{j}" for i in range(k) for j in range(i, k)]
    return f"(SELECT {sub} FROM {table})", out, [f"x_{i}" for i in range(k)], [[f"sb_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]


def _hyper(name: str, cols: list, table: str, stream: int) -> str:
    """CTE with the columns h_a_b (precision) and h_mu_a."""
    sub, out, mean, S = _moments(cols, table)
    normal_wishart_sql("n", mean, S, SqlDraws(stream), "h", out)
    return f"{name} AS MATERIALIZED (SELECT * FROM {select_sql(out, sub)})"


def _sym(p: str, k: int) -> list:
    return [[f"{p}_{min(a, b)}_{max(a, b)}" for b in range(k)] for a in range(k)]


def _vectors(name: str, key: str, ids: str, rows: str, z: list, rhs: str, hyper: str, beta: str, stream: int, out_cols: list,
             lam: list | None = None, mu: list | None = None) -> str:
    """CTE of new vectors per id: precision lam + beta sum z z^T, normals of the
    id; ``rows`` a FROM clause in which z and rhs are columns."""
    k = len(z)
    lam, mu = lam or _sym("h", k), mu or [f"h_mu_{a}" for a in range(k)]
    sums = [f"sum(({z[a]}) * ({z[b]})) AS g_{a}_{b}" for a in range(k) for b in range(a, k)] + [f"sum(({z[a]}) * ({rhs})) AS r_{a}" for a in range(k)]
    out = []
    cov = inverse_sql([[f"({lam[a][b]} + {beta} * coalesce(g_{min(a, b)}_{max(a, b)}, 0.0))" for b in range(k)] for a in range(k)], "i", out)
    for a in range(k):
        out.append(f"{beta} * coalesce(r_{a}, 0.0) + " + " + ".join(f"{lam[a][b]} * {mu[b]}" for b in range(k)) + f" AS c_{a}")
    mean = times_sql(cov, [f"c_{a}" for a in range(k)], "m", out)
    vec = normal_sql(cov, mean, [_id_normal(key, stream, 2 * a, 2 * a + 1) for a in range(k)], "v", out)
    return f"""{name}g AS (SELECT q.{key}, {', '.join(sums)} FROM {rows} GROUP BY q.{key}),
{name} AS MATERIALIZED (SELECT {key}, {', '.join(f'{v} AS {c}' for v, c in zip(vec, out_cols, strict=True))} 
  FROM {select_sql(out, f"(SELECT {key}, h.*, {', '.join(x.rsplit(' AS ', 1)[1] for x in sums)} FROM {ids} LEFT JOIN {name}g USING ({key}), {hyper} h)")})"""


def bpmf_sql(epochs: int = 2, ngibbs: int = 2, beta: float = 2.0, seed: int = 1234, std: float = 0.1) -> str:
    v = [f"v{a}" for a in range(K)]
    parts = [f"""{SPLIT_SQL},
m AS MATERIALIZED (SELECT avg(y) AS mean FROM ds WHERE split = 'train'),
r AS MATERIALIZED (SELECT uid, iid, y - mean AS r FROM ds, m WHERE split = 'train'),
te AS MATERIALIZED (SELECT row_number() OVER () AS row, uid, iid, y FROM ds WHERE split = 'test'),
uids AS MATERIALIZED (SELECT DISTINCT uid FROM ds), iids AS MATERIALIZED (SELECT DISTINCT iid FROM ds),
u0 AS (SELECT uid, {init_sql('uid', 11, 0, std)} AS v0, {init_sql('uid', 11, 1, std)} AS v1 FROM uids),
i0 AS (SELECT iid, {init_sql('iid', 12, 0, std)} AS v0, {init_sql('iid', 12, 1, std)} AS v1 FROM iids)"""]
    u, i = "u0", "i0"
    for e in range(epochs):
        parts += [_hyper(f"hi{e}", v, i, stream_of(seed, e, ITEM_HYPER)), _hyper(f"hu{e}", v, u, stream_of(seed, e, USER_HYPER))]
        for g in range(ngibbs):
            t = e * ngibbs + g
            parts.append(_vectors(f"i{t + 1}", "iid", "iids", f"r q JOIN {u} o ON q.uid = o.uid", ["o.v0", "o.v1"], "q.r", f"hi{e}", repr(beta),
                                  seed * 1000 + 2 * t + 1, v))
            i = f"i{t + 1}"
            parts.append(_vectors(f"u{t + 1}", "uid", "uids", f"r q JOIN {i} o ON q.iid = o.iid", ["o.v0", "o.v1"], "q.r", f"hu{e}", repr(beta),
                                  seed * 1000 + 2 * t, v))
            u = f"u{t + 1}"
        new = f"LEAST(5.0, GREATEST(0.0, coalesce({u}.v0 * {i}.v0 + {u}.v1 * {i}.v1, 0.0) + mean))"
        pred = new if e == 0 else f"({float(e)!r} * p{e - 1}.pred + {new}) / {e + 1}"
        parts.append(f"""p{e} AS MATERIALIZED (SELECT te.row, te.y, {pred} AS pred FROM te LEFT JOIN {u} ON te.uid = {u}.uid LEFT JOIN {i} ON te.iid = {i}.iid
  {'' if e == 0 else f'JOIN p{e - 1} ON p{e - 1}.row = te.row'}, m)""")
    rows = " UNION ALL ".join(f"SELECT CAST({e + 1} AS INTEGER) AS iter, {s6('sqrt(avg((y - pred) * (y - pred)))')} AS test_rmse FROM p{e}" for e in range(epochs))
    return f"WITH {', '.join(parts)} {rows}"


class _Bpmlr:
    """The CTEs of a BPMLR run (k = 2) and where its tables stand."""

    def __init__(self, variant: str, nsamples: int, burnin: int, seed: int, init_std: float = 0.1):
        self.variant, self.shared, self.use_b = variant, variant == "np", variant not in ("nb", "np")
        self.simple, self.seed, self.r = variant in ("s", "np"), seed, len(REALS)
        r = self.r
        W = CounterRNG(stream_of(seed, 0, START)).normal(0.0, init_std, (K, r))
        one = [f"{float(W[l][j])!r} AS w_{l}_{j}" for l in range(K) for j in range(r)]
        one += ["1.0 AS ag", "1.0 AS as_", "0.0 AS ms", "1.0 AS ac", "0.0 AS mc"]
        one += [f"{float(a == b)!r} AS lp_{a}_{b}" for a in range(K) for b in range(a, K)] + [f"0.0 AS mp_{a}" for a in range(K)]
        one += [f"{float(a == b)!r} AS lw_{a}_{b}" for a in range(r) for b in range(a, r)] + [f"0.0 AS mw_{a}" for a in range(r)]
        one += [f"{1.0 / K!r} AS p_{a}" for a in range(K)] + ["1.0 AS ap", "0.0 AS mpp"]
        self.base = [x.rsplit(" AS ", 1)[1] for x in one]
        zs = ", ".join(f"{z} AS z{j}" for j, z in enumerate(ZCOLS))
        self.parts = [f"""{SPLIT_SQL}, {Z_SQL},
z AS MATERIALIZED (SELECT row_number() OVER () AS row, split, uid, iid, y, {zs} FROM ds, st),
tr AS MATERIALIZED (SELECT * FROM z WHERE split = 'train'), te AS MATERIALIZED (SELECT * FROM z WHERE split = 'test'),
users AS MATERIALIZED (SELECT DISTINCT uid FROM z), items AS MATERIALIZED (SELECT DISTINCT iid FROM z),
s0 AS (SELECT uid, 0.0 AS b FROM users), c0 AS (SELECT iid, 0.0 AS b FROM items),
P0 AS (SELECT uid, {', '.join(f'{1.0 / K!r} AS v{a}' for a in range(K))} FROM users),
o0 AS MATERIALIZED (SELECT {', '.join(f'CAST({x.rsplit(" AS ", 1)[0]} AS DOUBLE) AS {x.rsplit(" AS ", 1)[1]}' for x in one)})"""]
        self.s, self.c, self.P, self.o, self.last = "s0", "c0", "P0", "o0", None
        self.samples = []
        for t in range(1, nsamples + 1):
            self.sweep(t)
            self.samples.append({"t": t, "s": self.s, "c": self.c, "P": self.P, "o": self.o, "kept": t > burnin})

    def state(self, new: dict) -> str:
        """The columns of the one-row state, some of them replaced."""
        return ", ".join(f"{new.get(c, c)} AS {c}" for c in self.base)

    def rows(self, source: str = "tr") -> str:
        """Rows next to everything they are predicted from."""
        reg = [" + ".join(f"w_{l}_{j} * z{j}" for j in range(self.r)) for l in range(K)]
        p = ", ".join(f"o.p_{a} AS p{a}" if self.shared else f"P.v{a} AS p{a}" for a in range(K))
        bias = "s.b AS sb, c.b AS cb" if self.use_b else "0.0 AS sb, 0.0 AS cb"
        joins = f"JOIN {self.s} s ON s.uid = t.uid JOIN {self.c} c ON c.iid = t.iid " if self.use_b else ""
        joins += "" if self.shared else f"JOIN {self.P} P ON P.uid = t.uid "
        return (f"(SELECT t.*, {bias}, {p}, {', '.join(f'({g}) AS g{l}' for l, g in enumerate(reg))}, ag, as_, ms, ac, mc "
                f"FROM {source} t {joins}, {self.o} o)")

    def bias(self, t: int, name: str, key: str, ids: str, rest: str, prec: str, mean: str, stream: int) -> str:
        new = f"{name}{t}"
        self.parts.append(f"""{new}g AS (SELECT {key}, count(*) AS n, sum({rest}) AS sr FROM {self.rows()} GROUP BY {key}),
{new} AS MATERIALIZED (SELECT {key}, CASE WHEN n IS NULL THEN {mean} ELSE ({prec} * {mean} + ag * sr) / ({prec} + ag * n) END
         + {_id_normal(key, stream, 0, 1)} / sqrt({prec} + ag * coalesce(n, 0)) AS b FROM {ids} LEFT JOIN {new}g USING ({key}), {self.o})""")
        return new

    def sweep(self, t: int) -> None:
        r, seed, st = self.r, self.seed, self.seed * 100 + t * 10
        draws = lambda block: SqlDraws(stream_of(seed, t, block))
        fit = "(p0 * g0 + p1 * g1)"
        if self.use_b:
            self.s = self.bias(t, "s", "uid", "users", f"y - cb - {fit}", "as_", "ms", st)
            self.c = self.bias(t, "c", "iid", "items", f"y - sb - {fit}", "ac", "mc", st + 1)
        lam, mu = _sym("lp", K), [f"mp_{a}" for a in range(K)]
        if self.shared:
            sums = [f"sum(g{a} * g{b}) AS g_{a}_{b}" for a in range(K) for b in range(a, K)] + [f"sum(g{a} * y) AS r_{a}" for a in range(K)]
            out = []
            cov = inverse_sql([[f"({lam[a][b]} + ag * g_{min(a, b)}_{max(a, b)})" for b in range(K)] for a in range(K)], "i", out)
            for a in range(K):
                out.append(f"ag * r_{a} + " + " + ".join(f"{lam[a][b]} * {mu[b]}" for b in range(K)) + f" AS c_{a}")
            d = draws(SHARED_P)
            vec = normal_sql(cov, times_sql(cov, [f"c_{a}" for a in range(K)], "m", out), [d.normal() for _ in range(K)], "v", out)
            self.parts.append(f"op{t} AS MATERIALIZED (SELECT {self.state({f'p_{a}': v for a, v in enumerate(vec)})} FROM "
                              f"{select_sql(out, f'(SELECT * FROM {self.o}, (SELECT ' + ', '.join(sums) + f' FROM {self.rows()}))')})")
            self.o = f"op{t}"
        else:
            self.parts.append(_vectors(f"P{t}", "uid", "users", f"{self.rows()} q", [f"q.g{a}" for a in range(K)], "q.y - q.sb - q.cb", self.o, "ag", st + 2,
                                       [f"v{a}" for a in range(K)], lam, mu))
            self.P = f"P{t}"
        # rows of W, one after the other
        ix = [(l, j) for l in range(K) for j in range(r)]
        sums = [f"sum(p{l} * z{j} * p{m} * z{i}) AS a_{l * r + j}_{m * r + i}" for x, (l, j) in enumerate(ix) for m, i in ix[x:]]
        sums += [f"sum(p{l} * z{j} * (y - sb - cb)) AS q_{l}_{j}" for l, j in ix]
        A = lambda x, y: f"a_{min(x, y)}_{max(x, y)}"
        lw, mw, d, out = _sym("lw", r), [f"mw_{a}" for a in range(r)], draws(W_ROWS), []
        cur = {(l, j): f"w_{l}_{j}" for l, j in ix}
        for l in range(K):
            cov = inverse_sql([[f"({lw[a][b]} + ag * {A(l * r + a, l * r + b)})" for b in range(r)] for a in range(r)], f"i{l}", out)
            for a in range(r):
                others = "".join(f" - {A(l * r + a, m * r + i)} * {cur[m, i]}" for m, i in ix if m != l)
                out.append(" + ".join(f"{lw[a][b]} * {mw[b]}" for b in range(r)) + f" + ag * (q_{l}_{a}{others}) AS c{l}_{a}")
            vec = normal_sql(cov, times_sql(cov, [f"c{l}_{a}" for a in range(r)], f"m{l}", out), [d.normal() for _ in range(r)], f"v{l}", out)
            cur |= {(l, a): vec[a] for a in range(r)}
        self.parts.append(f"""mo{t} AS MATERIALIZED (SELECT {', '.join(sums)} FROM {self.rows()}),
ow{t} AS MATERIALIZED (SELECT {self.state({f'w_{l}_{j}': v for (l, j), v in cur.items()})} FROM {select_sql(out, f"(SELECT * FROM {self.o}, mo{t})")})""")
        self.o = f"ow{t}"
        self.parts.append(f"""se{t} AS MATERIALIZED (SELECT sum((y - sb - cb - {fit}) * (y - sb - cb - {fit})) AS sse, CAST(count(*) AS DOUBLE) AS nn FROM {self.rows()})""")
        # precision of the noise and hyperparameters
        cols = {"ag": f"({draws(NOISE).gamma('1.0 + nn / 2.0')} / (1.0 + sse / 2.0))"}
        froms, pre = [f"se{t}"], []
        if self.use_b:
            for name, tab, pn, mn, block in (("s", self.s, "as_", "ms", HYPER_S), ("c", self.c, "ac", "mc", HYPER_C)):
                d = draws(block)
                froms.append(f"(SELECT CAST(count(*) AS DOUBLE) AS n_{name}, avg(b) AS m_{name}, sum(b * b) AS ss_{name} FROM {tab})")
                n, m, sxx = f"n_{name}", f"m_{name}", f"(ss_{name} - n_{name} * m_{name} * m_{name})"
                pre.append(f"{d.gamma(f'1.0 + {n} / 2.0')} / (1.0 + 0.5 * {sxx} + {n} * {m} * {m} / (2 * (1.0 + {n}))) AS np_{name}")
                pre.append((f"{d.normal()} / sqrt(np_{name})" if self.simple else f"{n} * {m} / (1.0 + {n}) + {d.normal()} / sqrt((1.0 + {n}) * np_{name})") + f" AS nm_{name}")
                cols |= {pn: f"np_{name}", mn: f"nm_{name}"}
        d = draws(HYPER_P)
        if self.shared:
            m = "((p_0 + p_1) / 2.0)"
            pre.append(f"{d.gamma('2.0')} / (1.0 + 0.5 * ((p_0 - {m}) * (p_0 - {m}) + (p_1 - {m}) * (p_1 - {m})) + 2.0 * {m} * {m} / 6.0) AS np_p")
            pre.append(f"2.0 * {m} / 3.0 + {d.normal()} / sqrt(3.0 * np_p) AS nm_p")
            cols |= {"ap": "np_p", "mpp": "nm_p", **{f"lp_{a}_{b}": "np_p" if a == b else "0.0" for a in range(K) for b in range(a, K)},
                     **{f"mp_{a}": "nm_p" for a in range(K)}}
        elif self.variant == "s":
            froms.append("(SELECT CAST(count(*) AS DOUBLE) AS n_u FROM users)")
            for a in range(K):  # the precision of P is held at one
                pre.append(f"{d.normal()} / sqrt(2.0 + n_u) AS nmp_{a}")
                cols[f"mp_{a}"] = f"nmp_{a}"
        else:
            self.parts.append(_hyper(f"hp{t}", [f"v{a}" for a in range(K)], self.P, stream_of(seed, t, HYPER_P)))
            froms.append(f"(SELECT {', '.join([f'h_{a}_{b} AS hh_{a}_{b}' for a in range(K) for b in range(a, K)] + [f'h_mu_{a} AS hm_{a}' for a in range(K)])} FROM hp{t})")
            cols |= {f"lp_{a}_{b}": f"hh_{a}_{b}" for a in range(K) for b in range(a, K)} | {f"mp_{a}": f"hm_{a}" for a in range(K)}
        for j in range(r):
            pre.append(f"(w_0_{j} + w_1_{j}) / 2.0 AS xw_{j}")
        for a in range(r):
            for b in range(a, r):
                pre.append(f"(w_0_{a} - xw_{a}) * (w_0_{b} - xw_{b}) + (w_1_{a} - xw_{a}) * (w_1_{b} - xw_{b}) AS sw_{a}_{b}")
        alpha, muw = normal_wishart_sql("2.0", [f"xw_{j}" for j in range(r)], _sym("sw", r), draws(HYPER_W), "hw", pre, diagonal=self.simple)
        cols |= {f"lw_{a}_{b}": alpha[a][b] for a in range(r) for b in range(a, r)} | {f"mw_{a}": muw[a] for a in range(r)}
        self.parts.append(f"""o{t} AS MATERIALIZED (SELECT o.* REPLACE ({', '.join(f'{v} AS {c}' for c, v in cols.items())}) 
  FROM {select_sql(pre, f"(SELECT * FROM {self.o}, {', '.join(froms)})")} o)""")
        self.o = f"o{t}"

    def history(self) -> str:
        """CTEs of the predictions and a query of the history."""
        prev, n, rows = None, 0, []
        for x in self.samples:
            t = x["t"]
            self.s, self.c, self.P, self.o = x["s"], x["c"], x["P"], x["o"]
            te = "CAST(NULL AS DOUBLE)"
            if x["kept"]:
                n += 1
                self.parts.append(f"""pr{t} AS MATERIALIZED (SELECT q.row, q.y, {f'{prev}.total + ' if prev else ''}(q.sb + q.cb + (q.p0 * q.g0 + q.p1 * q.g1)) AS total
  FROM {self.rows('te')} q {f'JOIN {prev} ON {prev}.row = q.row' if prev else ''})""")
                prev = f"pr{t}"
                te = s6(f"(SELECT sqrt(avg((y - total / {n}) * (y - total / {n}))) FROM {prev})")
            rows.append(f"SELECT CAST({t} AS INTEGER) AS iter, {s6('sqrt(sse / nn)')} AS train_rmse, {te} AS test_rmse FROM se{t}")
        return " UNION ALL ".join(rows)

    def trace(self) -> str:
        """(sample, param, value) of the kept samples."""
        r, rows = self.r, []
        for x in (x for x in self.samples if x["kept"]):
            t, o = x["t"], x["o"]
            put = lambda name, value, table, t=t: rows.append(f"SELECT {t} AS sample, '{name}' AS param, {value} AS value FROM {table}")
            put("s", "b", x["s"]), put("c", "b", x["c"])
            put("P", f"unnest([{', '.join(f'v{a}' for a in range(K))}])", x["P"])
            for name, col in (("alpha_G", "ag"), ("alpha_s", "as_"), ("mu_s", "ms"), ("alpha_c", "ac"), ("mu_c", "mc")):
                put(name, col, o)
            for name, cols in (("W", [f"w_{l}_{j}" for l in range(K) for j in range(r)]), ("lambda_W", [c for row in _sym("lw", r) for c in row]),
                               ("mu_W", [f"mw_{a}" for a in range(r)]), ("lambda_P", [c for row in _sym("lp", K) for c in row]), ("mu_P", [f"mp_{a}" for a in range(K)])):
                put(name, f"unnest([{', '.join(cols)}])", o)
        return " UNION ALL ".join(rows)


def bpmlr_sql(variant: str = "full", nsamples: int = 3, burnin: int = 1, seed: int = 1234) -> str:
    run = _Bpmlr(variant, nsamples, burnin, seed)
    q = run.history()
    return f"WITH {', '.join(run.parts)} {q}"


def bpmlr_variants_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM ({bpmlr_sql(v)})" for v in ("s", "nb", "np"))


def bpmlr_trace_sql(nsamples: int = 3, burnin: int = 1, seed: int = 1234) -> str:
    run = _Bpmlr("full", nsamples, burnin, seed)
    q = run.trace()
    return f"""WITH {', '.join(run.parts)}
SELECT param, CAST(sample AS INTEGER) AS sample, {s6('sqrt(sum(value * value))')} AS norm, {s6('avg(value)')} AS mean, {s6('stddev_pop(value)')} AS std,
       CASE WHEN contains(param, 'P') THEN 'profile' WHEN contains(param, 'W') THEN 'weights' ELSE param END AS "group"
FROM ({q}) GROUP BY param, sample"""
