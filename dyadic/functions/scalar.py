"""Scalar column functions (PRJ-3..7, PRJ-9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Academic-level bin edges (hours), lowest edge included.
LEVEL_EDGES = (0, 30, 60, 90, 120, 200)

# Ad-hoc grade score coefficients and the logistic squashing.
GRADE_COEF = {
    "gpa_x_cgpa": 1.0,      # cum_gpa * cum_cgpa
    "gpa": 1.0,             # cum_gpa
    "cgpa": 0.5,            # cum_cgpa
    "age_div": 30.0,        # age / 30
    "gender": 0.2,          # gender * 0.2
    "level_gap": 2.0,       # - |alevel - clevel| * 2
    "chrs_div": 3.0,        # - (chrs / 3 - 1)
    "term_chrs_base": 12.0,  # - (term_chrs - 12) * 0.5
    "term_chrs": 0.5,
    "enrolled": 0.01,       # - term_enrolled * 0.01
}
LOGISTIC_TOP = 4.0
LOGISTIC_MID = 7.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    """Bound a value to [lo, hi] (PRJ-4).  Only the value is clamped."""
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), _c(x)))


def bin_levels(x, edges: Sequence[float] = LEVEL_EDGES) -> Column:
    """Bins [e0,e1], (e1,e2], ... -> 0, 1, ...; outside -> null (PRJ-5)."""
    x = _c(x)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= lo) & (x <= hi) if i == 0 else (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.cast("int")


def logistic_bounded(g, top: float = LOGISTIC_TOP, mid: float = LOGISTIC_MID) -> Column:
    """top / (1 + e^-(g - mid)) (PRJ-6 squashing)."""
    return F.lit(top) / (F.lit(1.0) + F.exp(-(_c(g) - F.lit(mid))))


def grade_logit(cum_gpa, cum_cgpa, age, gender, alevel, clevel, chrs,
                term_chrs, term_enrolled) -> Column:
    """Linear ad-hoc grade score before squashing (PRJ-6)."""
    k = GRADE_COEF
    gpa, cgpa = _c(cum_gpa), _c(cum_cgpa)
    return (gpa * cgpa * k["gpa_x_cgpa"] + gpa * k["gpa"] + cgpa * k["cgpa"]
            + _c(age) / k["age_div"] + _c(gender) * k["gender"]
            - F.abs(_c(alevel) - _c(clevel)) * k["level_gap"]
            - (_c(chrs) / k["chrs_div"] - 1.0)
            - (_c(term_chrs) - k["term_chrs_base"]) * k["term_chrs"]
            - _c(term_enrolled) * k["enrolled"])


def nonfinite_to_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN and +-inf by 0 in every floating column (PRJ-7)."""
    fl = (T.DoubleType, T.FloatType)
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, fl) and (cols is None or f.name in cols)]
    return df.withColumns({
        c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(0.0))
            .otherwise(F.col(c)).cast(df.schema[c].dataType)
        for c in targets})


def nonneg(x) -> Column:
    """max(0, x) projection (PRJ-9)."""
    return F.greatest(F.lit(0.0), _c(x))


def squared_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Append f^2 = f*f for each feature; return the frame and new names (PRJ-3)."""
    names = [f"{f}^2" for f in features]
    return df.withColumns({n: F.col(f) * F.col(f) for n, f in zip(names, features)}), names
