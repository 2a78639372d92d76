"""Id dictionaries, one-hot field codes and the design layout
(WN-2, JN-5, RS-4/5/6, AG-6, PRJ-8 inside :func:`encode`).

A dictionary maps each distinct value of a field to 0..n-1 in sorted order.
All fields are ranked in one job by :func:`dyadic.operators.ranking.rank_within`
(range partitioning, no single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadic.guide import FeatureGuide, GuideError
from dyadic.operators.joins import fits_broadcast, packable, packed_codes, sized_broadcast, unpacked_codes
from dyadic.operators.prep import fit_zscore, apply_zscore
from dyadic.operators.ranking import rank_within

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _value_struct(df: DataFrame, i: int, col: str):
    dt = df.schema[col].dataType
    num = F.col(col).cast("double") if isinstance(dt, _NUMERIC) else F.lit(None).cast("double")
    s = F.lit(None).cast("string") if isinstance(dt, _NUMERIC) else F.col(col).cast("string")
    return F.struct(F.lit(i).alias("f"), num.alias("num"), s.alias("str"))


def build_dictionaries(df: DataFrame, fields: Sequence[str],
                       num_partitions: int | None = None) -> DataFrame:
    """One table ``(f int, num double, str string, code long)`` holding the
    sorted contiguous codes of every field (WN-2)."""
    vals = (df.select(F.explode(F.array(*[_value_struct(df, i, c) for i, c in enumerate(fields)]))
                      .alias("v")).select("v.*").distinct())
    return rank_within(vals, "f", ["num", "str"], rank="code", num_partitions=num_partitions)


def contiguous_ids(df: DataFrame, col: str) -> DataFrame:
    """``(col, idx)`` with idx = rank of the value among distinct values - 1."""
    d = build_dictionaries(df, [col])
    dt = df.schema[col].dataType
    v = F.col("num").cast(dt) if isinstance(dt, _NUMERIC) else F.col("str")
    return d.select(v.alias(col), F.col("code").alias("idx"))


def field_dictionary(dicts: DataFrame, df_schema: T.StructType, i: int, col: str) -> DataFrame:
    dt = df_schema[col].dataType
    v = F.col("num").cast(dt) if isinstance(dt, _NUMERIC) else F.col("str")
    return dicts.filter(F.col("f") == i).select(v.alias(col), F.col("code").alias(f"{col}__code"))


def encode_ids(df: DataFrame, dictionary: DataFrame, col: str, nvalues: int | None = None) -> DataFrame:
    """Replace a raw id by its contiguous index (JN-5)."""
    return (df.join(sized_broadcast(dictionary, nvalues), col, "left")
              .withColumn(col, F.col(f"{col}__code")).drop(f"{col}__code"))


@dataclass
class Encoding:
    """Field-coded rows plus everything needed to interpret them."""
    guide: FeatureGuide
    frame: DataFrame                       # split, y, <field> int codes, z-scored reals, keep cols
    cards: dict[str, int]                  # values per one-hot field
    ranges: list[tuple[str, str, int, int]]  # (feature, kind, start, end) in X
    scale: dict[str, tuple[float, float]]  # real -> (mean, std) fitted on train
    dicts: DataFrame                       # (f, num, str, code)
    keep: tuple[str, ...] = field(default_factory=tuple)

    @property
    def nb(self) -> int:
        """Number of entity columns at the front of X."""
        return sum(self.cards[e] for e in self.guide.ents)

    @property
    def p(self) -> int:
        """Columns of X after the entity block (categoricals and reals)."""
        return sum(self.cards[c] for c in self.guide.cats) + len(self.guide.reals)

    def codes(self, field: str) -> DataFrame:
        """The codes of one field (from the checkpointed dictionary)."""
        i = list(self.guide.fields).index(field)
        return self.dicts.filter(F.col("f") == i).select(F.col("code").alias(field))

    def feature_ranges(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(f, k, s, e) for f, k, s, e in self.ranges],
            "feature string, kind string, start long, `end` long")


def check_columns(df: DataFrame, guide: FeatureGuide, source: str = "") -> None:
    missing = [(c, r) for c, r in guide.roles().items() if c not in df.columns]
    if missing:
        c, r = missing[0]
        raise GuideError(f"{r} column '{c}' not found in {source or 'input'}")


def encode(df: DataFrame, guide: FeatureGuide, split: str = "split",
           keep: Sequence[str] = (), term: str = "term") -> Encoding:
    """One-hot codes for entities and categoricals from one dictionary over
    train and test, z-scored reals fitted on train (RS-4/5/6, PRJ-8).
    Without a ``split`` column the temporal hold-out on ``term`` labels the
    rows (FLT-1)."""
    from dyadic.operators.iterate import cut
    from dyadic.operators.prep import with_split
    check_columns(df, guide)
    fields = list(guide.fields)
    # one materialisation of the input columns feeds the hold-out term, the
    # dictionaries, the scaling statistics and the encoded rows
    if split in df.columns:
        df = cut(df.select(*keep, split, *guide.columns), spread=True)
    else:
        extra = [] if term in keep else [term]
        df = cut(df.select(*keep, *extra, *guide.columns), spread=True)
        df = with_split(df, term, None)
        if extra:
            df = df.drop(term)
    dicts = build_dictionaries(df, fields)
    cards = {r["f"]: r["n"] for r in dicts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    cards = {c: int(cards.get(i, 0)) for i, c in enumerate(fields)}
    out = df.select(*keep, split, F.col(guide.target).cast("double").alias(guide.target),
                    *fields, *guide.reals)
    # short codes replace the values of small fields before rows move for a large
    # one; the first entity comes last, so that its rows lie together
    small = [c for c in fields if fits_broadcast(dicts.schema, cards[c])]
    packed = packable({c: cards[c] for c in small}) if len(small) < len(fields) else []
    for i, c in sorted(enumerate(fields), key=lambda f: (f[1] not in small, -f[0])):
        d = field_dictionary(dicts, df.schema, i, c)
        if packed and c not in small and "__packed" not in out.columns:
            out = out.withColumn("__packed", packed_codes(packed, cards)).drop(*packed)
        out = out.join(sized_broadcast(d, cards[c]), c, "left").withColumn(
            c, F.col(f"{c}__code")).drop(f"{c}__code")
    if packed:
        out = out.withColumns(unpacked_codes(packed, cards, {c: dict(dicts.dtypes)["code"] for c in packed}))
    out = out.select(*reversed(fields), *keep, split, guide.target, *guide.reals)
    scale = {}
    if guide.reals:
        scale = fit_zscore(df.filter(F.col(split) == "train"), guide.reals)
        out = apply_zscore(out, scale, guide.reals)
    out = cut(out)
    ranges, start = [], 0
    for c in fields:
        kind = "entity" if c in guide.ents else "categorical"
        ranges.append((c, kind, start, start + cards[c]))
        start += cards[c]
    for r in guide.reals:
        ranges.append((r, "real", start, start + 1))
        start += 1
    return Encoding(guide, out, cards, ranges, scale, dicts, tuple(keep))


def long_design(enc: Encoding) -> DataFrame:
    """Long form of X: ``(split, y, <keep...>, idx, value)`` - one entry per
    active one-hot column and per real (RS-5).  For inspection / export; the
    model jobs use the field-coded rows directly."""
    g = enc.guide
    starts = {f: s for f, _, s, _ in enc.ranges}
    entries = [F.struct((F.lit(starts[c]) + F.col(c)).cast("long").alias("idx"),
                        F.lit(1.0).alias("value")) for c in g.fields]
    entries += [F.struct(F.lit(starts[r]).cast("long").alias("idx"),
                         F.col(r).cast("double").alias("value")) for r in g.reals]
    return (enc.frame.select(*enc.keep, "split", g.target, F.explode(F.array(*entries)).alias("e"))
                     .select(*enc.keep, "split", g.target, "e.idx", "e.value"))
