"""Column expressions used across operators (all JVM-side built-ins)."""

from dyadic.functions.scalar import (
    bin_levels, clip, grade_logit, logistic_bounded, nonfinite_to_zero,
    nonneg, squared_features,
)
from dyadic.functions.crng import crng_uniform, crng_uniform_sql
from dyadic.functions.arrays import (
    arr_add, arr_dot, arr_scale, arr_sub, arr_sum, arr_abs, arr_nonneg,
    arr_norm2, arr_get,
)

__all__ = [
    "bin_levels", "clip", "grade_logit", "logistic_bounded", "nonfinite_to_zero",
    "nonneg", "squared_features", "crng_uniform", "crng_uniform_sql",
    "arr_add", "arr_dot", "arr_scale", "arr_sub", "arr_sum", "arr_abs",
    "arr_nonneg", "arr_norm2", "arr_get",
]
