"""Counter-based uniform draws in integer arithmetic.

A draw is a pure function of (id, stream, draw) so the same value is produced
by Spark, by DuckDB and by numpy regardless of partitioning or retries:

    id = low + high * 2147483648, folded to
    f = low + (h * ((h * 69621 + 40692) mod 2147483647)) mod 2147483647,
        h = high mod 2147483647        (f = id below 2147483647; the low word
        2147483647 itself, which is 0 modulo the modulus, moves on by 12345)
    x = (f  * 48271 + stream) mod 2147483647
    x = (x  * 48271 + draw)   mod 2147483647
    x = (x  * x + 12345)      mod 2147483647   (non-linear: neighbouring
                                               draws of one id decorrelate)
    x = (x  * 48271)          mod 2147483647
    u = x / 2147483647

Any 64-bit id is allowed: the high word enters by a non-linear round of its
own, so ids that differ by a multiple of the modulus have different draws.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Park-Miller multiplier and modulus, squaring offset.
MULT = 48271
MOD = 2147483647
SQ = 12345
# Fixed values of the round that folds the high word.
WORD = 1 << 31
FOLD_A, FOLD_B = 69621, 40692


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(int(x))


def crng_uniform(id_, stream, draw) -> Column:
    id_ = _c(id_).cast("long")
    h, low = F.pmod(F.shiftright(id_, 31), F.lit(MOD)), F.pmod(id_, F.lit(WORD))
    f = low + F.when(low == MOD, F.lit(SQ)).otherwise(F.lit(0)) + F.pmod(h * F.pmod(h * FOLD_A + FOLD_B, F.lit(MOD)), F.lit(MOD))
    x = F.pmod(f * MULT + _c(stream).cast("long"), F.lit(MOD))
    x = F.pmod(x * MULT + _c(draw).cast("long"), F.lit(MOD))
    x = F.pmod(x * x + SQ, F.lit(MOD))
    x = F.pmod(x * MULT, F.lit(MOD))
    return x.cast("double") / float(MOD)


def crng_uniform_sql(id_sql: str, stream, draw) -> str:
    """Same draw as SQL text (DuckDB / Spark SQL); ids are not negative."""
    i = f"CAST({id_sql} AS BIGINT)"
    h = f"(CAST(({i} - {i} % {WORD}) / {WORD} AS BIGINT) % {MOD})"
    f = f"({i} % {WORD} + CASE WHEN {i} % {WORD} = {MOD} THEN {SQ} ELSE 0 END + ({h} * (({h} * {FOLD_A} + {FOLD_B}) % {MOD})) % {MOD})"
    x = (f"(((({f} * {MULT} + CAST({stream} AS BIGINT)) % {MOD})"
         f" * {MULT} + CAST({draw} AS BIGINT)) % {MOD})")
    x = f"(({x} * {x} + {SQ}) % {MOD})"
    return f"((({x} * {MULT}) % {MOD}) / CAST({MOD} AS DOUBLE))"


def crng_uniform_np(ids, stream, draw) -> np.ndarray:
    ids = np.asarray(ids, dtype=np.int64)
    h = (ids >> 31) % MOD
    low = ids % WORD
    f = low + np.where(low == MOD, SQ, 0) + (h * ((h * FOLD_A + FOLD_B) % MOD)) % MOD
    x = (f * MULT + np.int64(stream)) % MOD
    x = (x * MULT + np.asarray(draw, dtype=np.int64)) % MOD
    x = (x * x + SQ) % MOD
    x = (x * MULT) % MOD
    return x.astype(np.float64) / float(MOD)


def crng_init(id_, stream, draw, std: float) -> Column:
    """Zero-mean initial value with standard deviation ``std`` (uniform)."""
    return (crng_uniform(id_, stream, draw) * 2.0 - 1.0) * (std * 3.0 ** 0.5)


def crng_init_sql(id_sql: str, stream, draw, std: float) -> str:
    return f"(({crng_uniform_sql(id_sql, stream, draw)} * 2.0 - 1.0) * {std * 3.0 ** 0.5!r})"


def crng_init_np(ids, stream, draw, std: float) -> np.ndarray:
    return (crng_uniform_np(ids, stream, draw) * 2.0 - 1.0) * (std * 3.0 ** 0.5)
