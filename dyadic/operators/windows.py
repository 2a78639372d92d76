"""Term rollups and windows (WN-1, WN-3..6).

Per-group totals attached to rows are computed as a grouped aggregate
joined back (map-side partial sums, so a hot student or course is never
gathered into one task); running means use a window over the already
aggregated (entity, term) rows, whose groups are bounded by the number of
terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadic.functions.crng import MOD, MULT, SQ, crng_uniform
from dyadic.functions.scalar import bin_levels
from dyadic.operators.ranking import rank_within


def term_totals(dyads: DataFrame, sid: str = "sid", cid: str = "cid", term: str = "term",
                hours: str = "hours") -> DataFrame:
    """Each dyad gets its student's total hours in the term (term_chrs) and
    its course's enrolment in the term (term_enrolled) (WN-1).

    The totals are grouped sums joined back on (key, salt): a student or
    course holding a third of a term's rows is split over several tasks
    (hot keys found from the same counts, at most #partitions of them)."""
    from dyadic.operators.iterate import row_partitions
    from dyadic.operators.joins import plan_salts, salt_rows, salted_lookup
    n = row_partitions(dyads.sparkSession)
    s = dyads.groupBy(sid, term).agg(F.sum(hours).alias("term_chrs"), F.count(F.lit(1)).alias("n"))
    c = dyads.groupBy(cid, term).agg(F.count(F.lit(1)).cast("long").alias("term_enrolled"))
    ps = plan_salts(dyads, [sid, term], n, counts=s.select(sid, term, "n"))
    pc = plan_salts(dyads, [cid, term], n, counts=c.select(cid, term, F.col("term_enrolled").alias("n")))
    out = salted_lookup(salt_rows(dyads, ps, "__s1"), s.drop("n"), ps, "inner", "__s1")
    out = salted_lookup(salt_rows(out, pc, "__s2"), c, pc, "inner", "__s2")
    return out.drop("__s1", "__s2")


def term_spine(entities: DataFrame, key: str, first_term: int, last_term: int,
               term: str = "term") -> DataFrame:
    """Every entity once per term in [first, last] (generated per row, no
    join): the reindex target of the rollups."""
    return entities.select(key, F.explode(F.sequence(F.lit(int(first_term)).cast("long"),
                                                     F.lit(int(last_term)).cast("long"))).alias(term))


def cumulative_gpa(qpts: DataFrame, seeds: DataFrame, sid: str = "sid", term: str = "term",
                   hsgpa: str = "hsgpa", schrs0: str = "schrs0") -> DataFrame:
    """Running credit-weighted GPA per student (WN-3):

        cum_gpa(t) = (schrs0 * hsgpa + sum_{t'<=t} qpts) / (schrs0 + sum_{t'<=t} hours)

    with hsgpa where no hours exist yet; ``schrs`` is the running hours and
    ``alevel`` its level bin.  ``qpts`` is the spine of AG-12.  Points are
    summed as decimals, so the result does not depend on the order of rows."""
    w = Window.partitionBy(sid).orderBy(term).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = qpts.join(seeds, sid, "inner")
    schrs = F.col(schrs0) + F.sum("term_hours").over(w)
    exact = "decimal(24,6)"
    num = ((F.col(schrs0) * F.col(hsgpa)).cast(exact) + F.sum(F.col("qpts").cast(exact)).over(w)).cast("double")
    out = j.select(sid, term, schrs.alias("schrs"), num.alias("__num"), F.col(hsgpa))
    return out.select(
        sid, term, "schrs",
        F.when(F.col("schrs") > 0, F.col("__num") / F.col("schrs")).otherwise(F.col(hsgpa)).alias("cum_gpa"),
        bin_levels(F.col("schrs")).alias("alevel"))


def cumulative_course_mean(dyads: DataFrame, courses_spine: DataFrame, cgpa0: float,
                           enrolled0: float, cid: str = "cid", term: str = "term",
                           grade: str = "grade") -> DataFrame:
    """Running enrolment-weighted course mean and enrolment, plus the
    per-term mean term_cgpa (WN-4, per-course sums)."""
    agg = dyads.groupBy(cid, term).agg(F.sum(grade).alias("grade_sum"),
                                       F.count(F.lit(1)).cast("double").alias("enrolled"))
    j = (courses_spine.join(agg, [cid, term], "left")
                      .fillna({"grade_sum": 0.0, "enrolled": 0.0}))
    w = Window.partitionBy(cid).orderBy(term).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.lit(float(enrolled0)) + F.sum("enrolled").over(w)
    num = F.lit(float(cgpa0) * float(enrolled0)) + F.sum("grade_sum").over(w)
    return j.select(
        cid, term, total.alias("total_enrolled"),
        F.when(total > 0, num / total).otherwise(F.lit(float(cgpa0))).alias("cum_cgpa"),
        F.when(F.col("enrolled") > 0, F.col("grade_sum") / F.col("enrolled")).alias("term_cgpa"))


def share_of_model_total(df: DataFrame, value: str, model: str = "model",
                         name: str = "share") -> DataFrame:
    """value / sum(value) over its model (WN-5)."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(model)))


def per_group_sample(wants: DataFrame, candidates: DataFrame, who: str, level: str,
                     count: str, item: str, seed: int = 7) -> DataFrame:
    """For each (who, level) choose ``count`` distinct items of that level,
    capped at what exists (WN-6).

    A keyed permutation of 0..n-1 belongs to each (who, level): Feistel rounds
    over an a x b grid of at least n cells, with a key per round drawn for (who,
    level); a place beyond n walks on along its cycle until it is inside
    (there are fewer than a such cells, so it gets there).  The images of
    0..count-1 are the ranks of the chosen items: distinct, independent
    between students, and no candidate pair is ever made."""
    ranked = rank_within(candidates.select(level, item), level, [item], rank="__rank")
    sizes = candidates.groupBy(level).agg(F.count(F.lit(1)).cast("long").alias("__n"))
    a = F.ceil(F.sqrt(F.col("__n").cast("double"))).cast("long")
    keys = {f"__k{r}": F.floor(crng_uniform(who, F.lit(seed + 1 + r), level) * MOD).cast("long") for r in range(FEISTEL_ROUNDS)}
    picks = (wants.join(sizes, level, "inner")
                  .withColumn("__take", F.least(F.col(count).cast("long"), F.col("__n")))
                  .filter(F.col("__take") > 0)
                  .withColumn("__a", a).withColumn("__b", F.expr("(__n + __a - 1) div __a")).withColumns(keys)
                  .withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__take") - 1))))
    # the walk: as many steps as there are cells beyond n
    beyond = F.sequence(F.lit(0).cast("long"), F.least(F.col("__a") * F.col("__b") - F.col("__n"), F.lit(WALK)))
    walked = F.aggregate(beyond, F.lit(-1).cast("long"), lambda y, _: F.when(y < 0, _feistel(F.col("__i")))
                         .when(y < F.col("__n"), y).otherwise(_feistel(y)))
    picks = picks.withColumn("__rank", walked)
    return (picks.join(ranked.select(level, "__rank", item), [level, "__rank"], "inner")
                 .select(who, level, item))


FEISTEL_ROUNDS = 4
WALK = 64  # steps kept for a walk: beyond 4,096 items a place needs that many with a chance under 64^-64


def _feistel(x):
    """The permutation of the a x b grid under the keys ``__k0``.. of the row."""
    left = F.pmod(x, F.col("__a"))
    right = ((x - left) / F.col("__a")).cast("long")
    for r in range(FEISTEL_ROUNDS):
        side = right if r % 2 == 0 else left
        t = F.pmod(side * MULT + F.col(f"__k{r}"), F.lit(MOD))
        mixed = F.pmod(t * t + SQ, F.lit(MOD))
        if r % 2 == 0:
            left = F.pmod(left + mixed, F.col("__a"))
        else:
            right = F.pmod(right + mixed, F.col("__b"))
    return right * F.col("__a") + left


def feistel_sql(x: str) -> str:
    """The same in SQL, over columns a, b, k0.."""
    left, right = f"(({x}) % a)", f"(({x}) // a)"
    for r in range(FEISTEL_ROUNDS):
        side = right if r % 2 == 0 else left
        t = f"(({side} * {MULT} + k{r}) % {MOD})"
        mixed = f"(({t} * {t} + {SQ}) % {MOD})"
        if r % 2 == 0:
            left = f"(({left} + {mixed}) % a)"
        else:
            right = f"(({right} + {mixed}) % b)"
    return f"({right} * a + {left})"
