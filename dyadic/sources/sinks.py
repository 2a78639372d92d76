"""Sinks and parameter tables (SNK-1/2/3, SRC-4).

Parameters are tables: one Parquet table per parameter under a model
folder.  Scalars are one-row tables that keep their type.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions.scalar import nonfinite_to_zero


def dyad_sink(df: DataFrame, path: str, partition_by: str | None = "term",
              fmt: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    """Replace +-inf / NaN by 0 and write, partitioned by term (SNK-1).
    Returns the cleaned frame that was written."""
    clean = nonfinite_to_zero(df)
    w = clean.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
    return clean


class ParamExistsError(FileExistsError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def param_save(spark: SparkSession, params: dict, path: str, ow: bool = False) -> None:
    """Save every parameter; refuse an existing folder unless ``ow`` (SNK-2).
    DataFrames are written as tables, Python scalars as typed one-row tables."""
    if _exists(spark, path) and not ow:
        raise ParamExistsError(f"model folder exists: {path}")
    mode = "overwrite" if ow else "errorifexists"
    kinds = {}
    for name, v in params.items():
        if isinstance(v, DataFrame):
            v.write.mode(mode).parquet(os.path.join(path, name))
            kinds[name] = "table"
        else:
            typ = "long" if isinstance(v, (bool, int)) and not isinstance(v, float) else "double"
            if isinstance(v, str):
                typ = "string"
            spark.createDataFrame([(v,)], f"value {typ}").write.mode(mode).parquet(
                os.path.join(path, name))
            kinds[name] = f"scalar:{typ}"
    spark.createDataFrame([(json.dumps(kinds),)], "kinds string").write.mode(mode).parquet(
        os.path.join(path, "_kinds"))


def param_load(spark: SparkSession, path: str) -> dict:
    """Mirror of :func:`param_save`: tables as DataFrames, scalars typed."""
    kinds = json.loads(spark.read.parquet(os.path.join(path, "_kinds")).first()["kinds"])
    out = {}
    for name, kind in kinds.items():
        df = spark.read.parquet(os.path.join(path, name))
        out[name] = df if kind == "table" else df.first()["value"]
    return out


class DimensionError(ValueError):
    pass


def warm_start(spark: SparkSession, path: str, expect: dict[str, tuple[int | None, int | None]]) -> dict:
    """Load saved parameters and check each table's (rows, vector length)
    with one aggregate per table; fail on mismatch (SRC-4)."""
    params = param_load(spark, path)
    for name, (rows, dim) in expect.items():
        df = params.get(name)
        if df is None:
            raise DimensionError(f"missing parameter {name}")
        if not isinstance(df, DataFrame):
            continue
        aggs = [F.count(F.lit(1)).alias("n")]
        if "vec" in df.columns:
            aggs += [F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")]
        r = df.agg(*aggs).first()
        if rows is not None and r["n"] != rows:
            raise DimensionError(f"{name}: {r['n']} rows, expected {rows}")
        if dim is not None and "vec" in df.columns and not (r["lo"] == r["hi"] == dim):
            raise DimensionError(f"{name}: vector length {r['lo']}..{r['hi']}, expected {dim}")
    return params
