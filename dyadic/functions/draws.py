"""Replayable draws for the driver's hyperparameters.

:class:`CounterRNG` has the methods of a numpy generator that the samplers use,
but its n-th number is a function of (stream, n) only: a stream belongs to one
block of one sweep, so a run can be repeated, continued or written as SQL from
any sweep on.  Normals are Box-Muller pairs; a gamma takes a fixed run of
``GAMMA_SLOTS`` numbers, of which the first candidate that Marsaglia and
Tsang's test accepts is the draw (more than 95 % of the first ones are).

``SqlDraws`` writes the same draws as DuckDB expressions.
"""

from __future__ import annotations

import math
import re

import numpy as np

from dyadic.functions.crng import crng_uniform_np, crng_uniform_sql

TRIES = 24
GAMMA_SLOTS = 3 * TRIES


class CounterRNG:
    def __init__(self, stream: int):
        self.stream, self.slot = int(stream), 0

    def _u(self, slot: int) -> float:
        return max(float(crng_uniform_np(0, self.stream, slot)), 1e-300)

    def _z(self, slot: int) -> float:
        return math.sqrt(-2.0 * math.log(self._u(slot))) * math.cos(2.0 * math.pi * self._u(slot + 1))

    def standard_normal(self, n: int | None = None):
        out = [self._z(self.slot + 2 * i) for i in range(1 if n is None else n)]
        self.slot += 2 * len(out)
        return out[0] if n is None else np.array(out)

    def normal(self, mu: float = 0.0, sd: float = 1.0, shape=None):
        if shape is None:
            return mu + sd * self.standard_normal()
        return mu + sd * self.standard_normal(int(np.prod(shape))).reshape(shape)

    def gamma(self, shape: float, scale: float = 1.0) -> float:
        at, self.slot = self.slot, self.slot + GAMMA_SLOTS
        d = shape - 1.0 / 3.0
        c = 1.0 / math.sqrt(9.0 * d)
        for t in range(TRIES):
            x, u = self._z(at + 3 * t), self._u(at + 3 * t + 2)
            v = (1.0 + c * x) ** 3
            if v > 0 and math.log(u) < 0.5 * x * x + d - d * v + d * math.log(v):
                return scale * d * v
        raise ArithmeticError("no candidate of a gamma draw was accepted")

    def chisquare(self, df: float) -> float:
        return 2.0 * self.gamma(df / 2.0)

    def multivariate_normal(self, mean, cov) -> np.ndarray:
        return np.asarray(mean) + np.linalg.cholesky(cov) @ self.standard_normal(len(mean))


def stream_of(seed: int, sweep: int, block: int) -> int:
    """The stream of a block of a sweep (at most 32 blocks to a sweep)."""
    return (seed * 100_003 + sweep) * 32 + block


class SqlDraws:
    """The draws of one stream, in order, as DuckDB expressions."""

    def __init__(self, stream: int):
        self.stream, self.slot = stream, 0

    def _u(self, slot) -> str:
        return f"GREATEST({crng_uniform_sql('0', self.stream, slot)}, 1e-300)"

    def _z(self, slot: str) -> str:
        return f"(sqrt(-2.0 * ln({self._u(slot)})) * cos({2.0 * math.pi!r} * {self._u(f'{slot} + 1')}))"

    def normal(self) -> str:
        at, self.slot = self.slot, self.slot + 2
        return self._z(str(at))

    def gamma(self, shape: str) -> str:
        """Scale one; ``shape`` an expression over the columns in reach."""
        at, self.slot = self.slot, self.slot + GAMMA_SLOTS
        cand = (f"list_transform(range({TRIES}), lambda t: {{'x': {self._z(f'({at} + 3 * t)')}, 'u': {self._u(f'({at} + 3 * t + 2)')}}})")
        d = f"(CAST(({shape}) AS DOUBLE) - {1.0 / 3.0!r})"
        v = f"pow(1.0 + y.x / sqrt(9.0 * {d}), 3)"
        ok = f"CASE WHEN {v} > 0 THEN ln(y.u) < 0.5 * y.x * y.x + {d} - {d} * {v} + {d} * ln({v}) ELSE false END"
        return f"list_filter(list_transform({cand}, lambda y: CASE WHEN {ok} THEN {d} * {v} END), lambda g: g IS NOT NULL)[1]"

    def chisquare(self, df: str) -> str:
        return f"(2.0 * {self.gamma(f'({df}) / 2.0')})"


# ---------------------------------------------------------------- small matrices as columns
# A matrix is a list of lists of expressions; each step adds columns ``expr AS
# name`` that later ones use; ``select_sql`` nests them.
def select_sql(out: list, source: str) -> str:
    """(SELECT ...) with the columns ``expr AS name`` of ``out`` beside those of
    ``source``; a column may use those before it (one subquery per depth, so
    that each is computed once)."""
    depth: dict[str, int] = {}
    steps: list[list[str]] = []
    for col in out:
        expr, name = col.rsplit(" AS ", 1)
        d = max((depth[w] + 1 for w in set(re.findall(r"[a-zA-Z_]\w*", expr)) if w in depth), default=0)
        depth[name] = d
        while len(steps) <= d:
            steps.append([])
        steps[d].append(col)
    for cols in steps:
        source = f"(SELECT *, {', '.join(cols)} FROM {source})"
    return source


def named(p: str, k: int, m: int | None = None) -> list:
    return [[f"{p}_{a}_{b}" for b in range(k if m is None else m)] for a in range(k)]


def chol_sql(A: list, p: str, out: list) -> list:
    """Lower Cholesky factor of A as columns ``p_a_b``."""
    k = len(A)
    L = [["0.0"] * k for _ in range(k)]
    for i in range(k):
        for j in range(i + 1):
            s = A[i][j] + "".join(f" - {L[i][m]} * {L[j][m]}" for m in range(j))
            out.append(f"{f'sqrt({s})' if i == j else f'({s}) / {L[j][j]}'} AS {p}_{i}_{j}")
            L[i][j] = f"{p}_{i}_{j}"
    return L


def inverse_sql(A: list, p: str, out: list) -> list:
    """Inverse of a symmetric positive matrix, by its Cholesky factor."""
    k = len(A)
    L = chol_sql(A, f"{p}_l", out)
    M = [["0.0"] * k for _ in range(k)]
    for i in range(k):
        for j in range(i + 1):
            s = ("1.0" if i == j else "0.0") + "".join(f" - {L[i][m]} * {M[m][j]}" for m in range(j, i))
            out.append(f"({s}) / {L[i][i]} AS {p}_m_{i}_{j}")
            M[i][j] = f"{p}_m_{i}_{j}"
    for i in range(k):
        for j in range(i, k):
            out.append(" + ".join(f"{M[m][i]} * {M[m][j]}" for m in range(j, k)) + f" AS {p}_{i}_{j}")
    return [[f"{p}_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]


def times_sql(A: list, x: list, p: str, out: list) -> list:
    """A x as columns ``p_a``."""
    for i, row in enumerate(A):
        out.append(" + ".join(f"{a} * {b}" for a, b in zip(row, x, strict=True)) + f" AS {p}_{i}")
    return [f"{p}_{i}" for i in range(len(A))]


def normal_sql(cov: list, mean: list, z: list, p: str, out: list) -> list:
    """mean + chol(cov) z as columns ``p_a``."""
    L = chol_sql(cov, f"{p}_c", out)
    for i in range(len(mean)):
        out.append(mean[i] + "".join(f" + {L[i][j]} * {z[j]}" for j in range(i + 1)) + f" AS {p}_{i}")
    return [f"{p}_{i}" for i in range(len(mean))]


def wishart_sql(W: list, df: str, draws: SqlDraws, p: str, out: list) -> list:
    """A Wishart draw by the Bartlett decomposition, columns ``p_a_b``."""
    k = len(W)
    L = chol_sql(W, f"{p}_w", out)
    A = [["0.0"] * k for _ in range(k)]
    for i in range(k):
        out.append(f"sqrt({draws.chisquare(f'{df} - {i}')}) AS {p}_a_{i}_{i}")
        A[i][i] = f"{p}_a_{i}_{i}"
        for j in range(i):
            out.append(f"{draws.normal()} AS {p}_a_{i}_{j}")
            A[i][j] = f"{p}_a_{i}_{j}"
    for i in range(k):
        for j in range(i + 1):
            out.append(" + ".join(f"{L[i][m]} * {A[m][j]}" for m in range(j, i + 1)) + f" AS {p}_la_{i}_{j}")
    for i in range(k):
        for j in range(i, k):
            out.append(" + ".join(f"{p}_la_{i}_{m} * {p}_la_{j}_{m}" for m in range(i + 1)) + f" AS {p}_{i}_{j}")
    return [[f"{p}_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]


def normal_wishart_sql(n: str, mean: list, S: list, draws: SqlDraws, p: str, out: list, mu0: float = 0.0, b0: float = 2.0,
                       diagonal: bool = False) -> tuple[list, list]:
    """(precision, mean) given ``n`` vectors with this mean and covariance, from
    the Normal-Wishart posterior of (mu0, b0, k, I); ``diagonal`` keeps only
    the diagonal of the precision and draws the mean around the prior."""
    k = len(mean)
    inner = [[f"({float(i == j)!r} + {n} * {S[i][j]} + {n} * {b0!r} * ({mu0!r} - {mean[i]}) * ({mu0!r} - {mean[j]}) / ({b0!r} + {n}))"
              for j in range(k)] for i in range(k)]
    alpha = wishart_sql(inverse_sql(inner, f"{p}_wp", out), f"({k} + {n})", draws, p, out)
    if diagonal:
        alpha = [[alpha[i][j] if i == j else "0.0" for j in range(k)] for i in range(k)]
        mu = [repr(mu0)] * k
    else:
        mu = [f"({b0!r} * {mu0!r} + {n} * {mean[i]}) / ({b0!r} + {n})" for i in range(k)]
    cov = inverse_sql([[f"({b0!r} + {n}) * {alpha[i][j]}" for j in range(k)] for i in range(k)], f"{p}_ic", out)
    z = []
    for i in range(k):
        out.append(f"{draws.normal()} AS {p}_z_{i}")
        z.append(f"{p}_z_{i}")
    return alpha, normal_sql(cov, mu, z, f"{p}_mu", out)
