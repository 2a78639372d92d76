"""Term rollups with carried state (SE-3 with WN-3, WN-4).

A state table holds what a running mean needs: per student the quality points
and hours so far, per course the grade sum and enrolment so far.  A new term
sums its own rows by key, adds them to the state and gives the term's rows of
the running means; the next state is written, so a term costs its own rows and
one pass over the state, never the history, and its plan is the same for the
first term and the thousandth.  The result is that of the full windows
(:func:`~dyadic.operators.windows.cumulative_gpa`,
:func:`~dyadic.operators.windows.cumulative_course_mean`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.scalar import bin_levels
from dyadic.operators.iterate import cut

EXACT = "decimal(24,6)"  # points are added exactly, whatever the order of rows


def student_state(seeds: DataFrame, sid: str = "sid", hsgpa: str = "hsgpa", schrs0: str = "schrs0") -> DataFrame:
    """(sid, hsgpa, schrs, points) before the first term."""
    return seeds.select(sid, F.col(hsgpa).alias("hsgpa"), F.col(schrs0).cast("double").alias("schrs"),
                        (F.col(schrs0) * F.col(hsgpa)).cast(EXACT).alias("points"))


def add_student_term(state: DataFrame, dyads: DataFrame, sid: str = "sid", grade: str = "grade", hours: str = "hours") -> DataFrame:
    """The state after a term with these dyads."""
    own = dyads.groupBy(sid).agg(F.sum(F.col(grade) * F.col(hours)).alias("__q"), F.sum(hours).alias("__h"))
    return state.join(own, sid, "left").select(
        sid, "hsgpa", (F.col("schrs") + F.coalesce("__h", F.lit(0.0))).alias("schrs"),
        (F.col("points") + F.coalesce(F.col("__q"), F.lit(0.0)).cast(EXACT)).cast(EXACT).alias("points"))


def student_rows(state: DataFrame, term: int, sid: str = "sid") -> DataFrame:
    """(sid, term, schrs, cum_gpa, alevel) of the term that led to ``state``."""
    gpa = F.when(F.col("schrs") > 0, F.col("points").cast("double") / F.col("schrs")).otherwise(F.col("hsgpa"))
    return state.select(sid, F.lit(term).cast("long").alias("term"), "schrs", gpa.alias("cum_gpa"), bin_levels(F.col("schrs")).alias("alevel"))


def course_state(courses: DataFrame, cgpa0: float, enrolled0: float, cid: str = "cid") -> DataFrame:
    """(cid, total, num, grade_sum, enrolled) before the first term; the last
    two are the latest term's own."""
    return courses.select(cid, F.lit(float(enrolled0)).alias("total"), F.lit(float(cgpa0) * float(enrolled0)).alias("num"),
                          F.lit(0.0).alias("grade_sum"), F.lit(0.0).alias("enrolled"))


def add_course_term(state: DataFrame, dyads: DataFrame, cid: str = "cid", grade: str = "grade") -> DataFrame:
    own = dyads.groupBy(cid).agg(F.sum(grade).alias("__g"), F.count(F.lit(1)).cast("double").alias("__n"))
    g, n = F.coalesce("__g", F.lit(0.0)), F.coalesce("__n", F.lit(0.0))
    return state.join(own, cid, "left").select(cid, (F.col("total") + n).alias("total"), (F.col("num") + g).alias("num"),
                                               g.alias("grade_sum"), n.alias("enrolled"))


def course_rows(state: DataFrame, term: int, cgpa0: float, cid: str = "cid") -> DataFrame:
    """(cid, term, total_enrolled, cum_cgpa, term_cgpa) of the latest term."""
    return state.select(
        cid, F.lit(term).cast("long").alias("term"), F.col("total").alias("total_enrolled"),
        F.when(F.col("total") > 0, F.col("num") / F.col("total")).otherwise(F.lit(float(cgpa0))).alias("cum_cgpa"),
        F.when(F.col("enrolled") > 0, F.col("grade_sum") / F.col("enrolled")).alias("term_cgpa"))


def run_terms(state: DataFrame, terms: Iterable[int], dyads_of, add, rows_of, out_path: str) -> DataFrame:
    """Advance ``state`` term by term: ``dyads_of(term)`` are the term's own
    rows, ``add(state, dyads)`` the next state, ``rows_of(state, term)`` its
    results, appended below ``out_path``.  Returns the last state."""
    for t in terms:
        state = cut(add(state, dyads_of(t)))
        rows_of(state, t).write.mode("append").parquet(out_path)
    return state
