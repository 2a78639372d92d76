"""Mixing sources to target weights by Pareto order sampling.

Every source is given a target in words; a document is expected in the mix
``e`` times.  ``floor(e)`` whole copies are certain.  The rest is drawn: a
document's inclusion probability is ``p = e - floor(e)``, its random odds
``u / (1 - u)`` are divided by its inclusion odds ``p / (1 - p)``, and the
documents of a source enter in ascending order of that quotient until the words
that the certain copies leave open are taken (the fixed size of the sample is
in words).  A document that no longer fits is passed over and the order goes on
behind it, ``ROUNDS`` times in all, so what stays open is small beside a
document.  ``e`` is the same for all documents of a source, or proportional to
a column ``preference``, limited to ``MOST`` copies.

The draw is the MD5 of id and text, so reruns agree.  Nothing is sorted as a
whole: rows fall into buckets by their draw, the buckets' words are summed
before any shuffle, and only the one bucket per source in which the limit falls
is put in order.  A source's bounds are looked up in parts, so one that holds a
third of the rows spreads over all tasks.  Equal rows are one row with a count.

Only built-in functions are used.  Defined cases: a null or blank text has no
words and takes none; a null source is a source, placed last; repeated rows are
separate copies; null ids are drawn by their text; a preference that is null or
not positive is never taken; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import positions, stored

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words, as a fraction
MOST = 2
ROUNDS = 4
BUCKET_ROWS = 1000  # expected rows of a bucket
PARTS = 64  # of a source, in the lookup of its bounds
DRAWS = 1 << 52


def draw(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """13 hex digits of the MD5 of ``id:text`` as an integer below 2^52."""
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, preference: str | None = None) -> DataFrame:
    """(source, doc_id, size, pref, h, n): equal rows with their number."""
    pref = F.lit(1.0) if preference is None else F.coalesce(F.greatest(F.col(preference).cast("double"), F.lit(0.0)), F.lit(0.0))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.select("source", "doc_id", size.alias("size"), pref.alias("pref"), draw().alias("h"))
    return rows.groupBy("source", "doc_id", "size", "pref", "h").agg(F.count("*").alias("n"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``: the weights
    repeat over the sources in code-point order, null last; a target above
    ``most`` times its source's size stops there and the excess is shared among
    the others by weight, until none is above."""
    placed = positions(sources.withColumn("__all", F.lit(0)), "__all", [F.col("source").asc_nulls_last()], "__pos", "__n").drop("__all", "__n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    src = stored(placed.withColumn("weight", weight).drop("__pos"), "sources")
    cap = F.col("source_size") * most
    level, full = None, F.lit(False)
    while True:  # a round stops more sources or is the last
        r = src.select(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("n")).first()
        if level is not None and r["n"] == level[2] or r["open"] == 0:
            break
        level = (share[0] * r["words"] - share[1] * most * r["held"], share[1] * r["open"], r["n"])
        full = cap <= _part(level)
    return src.withColumn("target", F.least(cap.cast("double"), _part(level)) if level else F.lit(0.0))


def _part(level) -> Column:
    return F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1]))


def _looked_up(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows (with ``part``) next to their source's columns."""
    wide = per_source.withColumnRenamed("source", "__s").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.join(wide, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__part"))).drop("__s", "__part")


def _levels(rows: DataFrame, src: DataFrame, most: int) -> DataFrame:
    """``src`` with ``level``: copies per unit of preference, such that the
    expected words are the target and no document is expected more than
    ``most`` times.  A source whose documents with a preference cannot carry
    the target gives what they can."""
    sums = rows.withColumn("part", F.col("h") % PARTS)
    level = F.col("target") / F.col("open")
    src = src.join(rows.groupBy(F.col("source").alias("__s"))
                   .agg(F.sum(F.col("pref") * F.col("size") * F.col("n")).alias("open")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    src = stored(src.withColumns({"level": F.when(F.col("open") > 0, level).otherwise(0.0), "n_full": F.lit(0).cast("long")}), "levels")
    while True:
        full = F.col("pref") * F.col("level") > most
        held = _looked_up(sums, src.select("source", "level")).groupBy(F.col("source").alias("__s")).agg(
            F.sum(F.when(full, F.col("size") * F.col("n")).otherwise(0)).alias("held"),
            F.sum(F.when(~full, F.col("pref") * F.col("size") * F.col("n")).otherwise(0.0)).alias("left"),
            F.sum(F.when(full, F.col("n")).otherwise(0)).alias("now"))
        new = F.when(F.col("left") > 0, F.greatest(F.col("level"), (F.col("target") - most * F.col("held")) / F.col("left"))).otherwise(F.col("level"))
        src = stored(src.join(held, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
                     .withColumns({"more": F.col("now") > F.col("n_full"), "level": new})
                     .withColumn("n_full", F.col("now")).drop("held", "left", "now"), "levels")
        if not src.filter("more").limit(1).count():
            return src.drop("more", "open", "n_full")
        src = src.drop("more")


def ranked(rows: DataFrame, src: DataFrame, preference: bool, most: int) -> DataFrame:
    """Rows with their certain copies, their place in the order and bucket."""
    if preference:
        src = _levels(rows, src, most)
        e = F.least(F.col("pref") * F.col("level"), F.lit(float(most)))
    else:
        e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    src = src.withColumn("buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS))
    d = _looked_up(rows.withColumn("part", F.col("h") % PARTS), src).withColumn("e", e)
    d = d.withColumns({"certain": F.floor("e").cast("long"), "u": (F.col("h") + 0.5) / float(DRAWS)})
    d = d.withColumn("p", F.col("e") - F.col("certain"))
    d = d.withColumn("xi", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    # the mean odds of the source make the quotient spread evenly over (0, 1); any increasing function would be right
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    frac = F.least(F.greatest(mean - F.floor(mean), F.lit(1e-9)), F.lit(1 - 1e-9))
    even = F.col("xi") * (frac / (1 - frac))
    bucket = F.least(F.floor(F.col("buckets") * (even / (1 + even))), F.col("buckets") - 1)
    return d.select("source", "doc_id", "size", "pref", "h", "n", "part", "source_size", "target", "certain", "xi", bucket.alias("bucket"))


def _after(low: str) -> Column:
    """Rows behind the place that ``low`` (xi, doc_id, size, h) marks."""
    key = _key()
    return F.col(low).isNull() | (key > F.col(low))


def _key() -> Column:
    return F.struct("xi", "h", "doc_id", "size", "pref")


def _next(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One round: for each source, in order behind its place ``low`` and among
    the rows that fit ``open``, the last row that is still taken and how many
    of its copies; ``state`` with ``to`` (that place), ``k`` and the words."""
    d = _looked_up(rows, state.select("source", "low", "open"))
    d = d.filter(F.col("xi").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("open")) & _after("low"))
    words = F.col("size") * F.col("n")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "bucket").agg(F.sum(words).alias("w"), F.first("open").alias("open"))
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(w), F.lit(0)))
    # the bucket in which the limit falls, or the last one where all is taken
    edge = (sums.filter(F.col("before") <= F.col("open")).groupBy("source")
            .agg(F.max(F.struct("bucket", "before")).alias("x")).select("source", "x.bucket", "x.before"))
    edge = edge.select(F.col("source").alias("__e"), F.col("bucket").alias("__b"), "before", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__q"))
    one = d.join(edge, F.col("source").eqNullSafe(F.col("__e")) & (F.col("bucket") == F.col("__b")) & (F.col("part") == F.col("__q")))
    o = Window.partitionBy("source", "bucket").orderBy(_key()).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("at", F.col("before") + F.coalesce(F.sum(words).over(o), F.lit(0)))
    one = one.withColumn("k", F.least(F.col("n"), F.floor((F.col("open") - F.col("at")) / F.col("size"))).cast("long"))
    # a row is reached while all before it were taken whole; the first row of an edge bucket may itself not fit
    last = (one.filter(F.col("at") <= F.col("open")).groupBy(F.col("source").alias("__s"))
            .agg(F.max(F.struct(_key().alias("to"), "k", (F.col("at") + F.col("k") * F.col("size")).alias("words"))).alias("x")))
    out = state.join(last, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select("source", "target", "source_size", "low", "open", "x.to", "x.k", F.coalesce("x.words", F.lit(0)).alias("words"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
        preference: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) per row."""
    rows = stored(sized(docs, preference), "sized")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_rows"))
    src = targets(sources, weights, share, most)
    rows = stored(ranked(rows, src, preference is not None, most), "ranked")
    certain = rows.groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("certain") * F.col("size") * F.col("n")).alias("sure"))
    place = dict(rows.select(_key().alias("k")).dtypes)["k"]
    state = src.join(certain, F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", "target", "source_size", (F.col("target") - F.col("sure")).alias("open"), F.lit(None).cast(place).alias("low"))
    picks = []
    for k in range(ROUNDS):
        state = stored(_next(rows, state), f"round-{k}")
        picks.append(state.select(F.col("source").alias("__s"), F.struct("low", "open", "to", "k").alias(f"r{k}")))
        state = state.select("source", "target", "source_size", (F.col("open") - F.col("words")).alias("open"),
                             F.coalesce("to", "low").alias("low"))
    bounds = picks[0].withColumnRenamed("__s", "source")
    for p in picks[1:]:
        bounds = bounds.join(p, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    d, extra, key = _looked_up(rows, bounds), F.lit(0).cast("long"), _key()
    for k in range(ROUNDS):
        r = f"r{k}"
        inside = F.col(f"{r}.to").isNotNull() & (F.col("size") <= F.col(f"{r}.open")) & (F.col("size") > 0) & _after(f"{r}.low") & (key <= F.col(f"{r}.to"))
        extra = extra + F.when(F.col("xi").isNotNull() & inside, F.when(key == F.col(f"{r}.to"), F.col(f"{r}.k")).otherwise(F.col("n"))).otherwise(0)
    d = d.withColumn("extra", extra)
    # equal rows part again; the first of them take the drawn copies
    d = d.select("source", "doc_id", "size", "source_size", "target", "certain", "extra", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    copies = F.col("certain") + (F.col("i") <= F.col("extra")).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")
