"""Scans (SRC-1/2/3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.guide import FeatureGuide, GuideError


def triplet_scan(spark: SparkSession, path: str, uid: str = "uid", iid: str = "iid",
                 target: str = "target") -> DataFrame:
    """Headerless CSV of 1-based (uid, iid, target); ids shifted to 0-based
    (SRC-1)."""
    schema = f"{uid} long, {iid} long, {target} double"
    df = spark.read.schema(schema).option("header", "false").csv(path)
    return df.withColumns({uid: F.col(uid) - 1, iid: F.col(iid) - 1})


def _read(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """CSV types come from ``schema``; without one Spark infers them, which
    reads the file once more."""
    if fmt == "csv":
        r = spark.read.option("header", "true")
        return (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)
    return spark.read.format(fmt).load(path)


def guided_scan(spark: SparkSession, path: str, guide: FeatureGuide, fmt: str = "parquet",
                extra: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Read only the guide's columns (pruned at the scan); a missing column
    raises an error naming its role and the file (SRC-2)."""
    df = _read(spark, path, fmt, schema)
    for c, role in guide.roles().items():
        if c not in df.columns:
            raise GuideError(f"{role} column '{c}' not found in {path}")
    return df.select(*extra, *guide.columns)


def read_train_test(spark: SparkSession, train_path: str, test_path: str, guide: FeatureGuide,
                    fmt: str = "parquet", extra: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Both files through :func:`guided_scan`, stacked with a split label."""
    tr = guided_scan(spark, train_path, guide, fmt, extra, schema).withColumn("split", F.lit("train"))
    te = guided_scan(spark, test_path, guide, fmt, extra, schema).withColumn("split", F.lit("test"))
    return tr.unionByName(te)


def keyed_scan(spark: SparkSession, path: str, uid: str = "uid", iid: str = "iid",
               target: str = "target", fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read every column; fail if a key or the target is missing (SRC-3)."""
    df = _read(spark, path, fmt, schema)
    for c, role in ((uid, "user key"), (iid, "item key"), (target, "target")):
        if c not in df.columns:
            raise GuideError(f"{role} column '{c}' not found in {path}")
    return df
