"""Small dense-vector algebra on ``array<double>`` columns via higher-order
functions (stay inside whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def arr_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def arr_dot(a, b) -> Column:
    return arr_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def arr_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def arr_sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def arr_scale(a, s) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else _c(s)
    return F.transform(_c(a), lambda x: x * s)


def arr_abs(a) -> Column:
    return F.transform(_c(a), lambda x: F.abs(x))


def arr_nonneg(a) -> Column:
    return F.transform(_c(a), lambda x: F.greatest(F.lit(0.0), x))


def arr_norm2(a) -> Column:
    return arr_sum(F.transform(_c(a), lambda x: x * x))


def arr_get(a, i: int) -> Column:
    """0-based element access."""
    return F.element_at(_c(a), i + 1)


# Fixed-length forms: when the vector length k is known, element access and
# scalar arithmetic stay inside whole-stage code generation (the lambda
# functions above are evaluated by the interpreter).
def dot_k(a, b, k: int) -> Column:
    a, b = _c(a), _c(b)
    out = a[0] * b[0]
    for i in range(1, k):
        out = out + a[i] * b[i]
    return out


def norm2_k(a, k: int) -> Column:
    return dot_k(a, a, k)


def comps(a, k: int) -> list:
    a = _c(a)
    return [a[i] for i in range(k)]


def add_k(arrays, k: int) -> Column:
    """Element-wise sum of several arrays of length k (or lists of k
    scalar columns)."""
    cs = [comps(x, k) if not isinstance(x, list) else x for x in arrays]
    out = []
    for i in range(k):
        e = cs[0][i]
        for c in cs[1:]:
            e = e + c[i]
        out.append(e)
    return F.array(*out)


def sub_k(a, b, k: int) -> Column:
    a, b = _c(a), _c(b)
    return F.array(*[a[i] - b[i] for i in range(k)])
