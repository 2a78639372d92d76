"""Shared helpers of the corpus operators: reading tables, cutting lineage
into the shared folder, and per-worker caches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from dyadic.session import ensure_checkpoint_dir, scratch_path

# ASCII white space that separates words in the word-based operators.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage is cut there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A public vocabulary: the one of the ``public_tokenizers`` package, or of
    another folder."""
    if folder is None:
        import public_tokenizers
        return public_tokenizers.path(name)
    return os.path.join(folder, name)


BITS = 1 << 26  # bounds every bit set: 8 MB, whatever the corpus


def bit_set(df: DataFrame, col: str, bits: int = BITS):
    """Which values of ``col mod bits`` occur, as a numpy bit set (64 to a
    word).  At most ``bits / 64`` rows come to the driver."""
    import numpy as np
    from pyspark.sql import functions as F
    at = F.pmod(F.col(col), F.lit(bits))
    words = (df.select(at.alias("a")).select(F.shiftright("a", 6).alias("w"), F.expr("shiftleft(1L, cast(a & 63 AS int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bit_set(words, values):
    """Which of the int64 ``values`` may be in the set: never misses one."""
    import numpy as np
    at = (values & np.int64(len(words) * 64 - 1)).astype(np.uint64)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def release_memory() -> None:
    """Give freed memory of a worker back to the system; workers outlive
    their tasks, and an executor's limit counts all of them."""
    import ctypes
    import gc
    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def positions(df: DataFrame, group: str, order: list, pos: str = "pos", total: str = "n_rows") -> DataFrame:
    """``df`` with each row's 0-based place inside its ``group`` when sorted by
    the columns ``order``, and the group's number of rows.

    Rows are range partitioned on (group, order), so a group of any size spans
    as many tasks as it needs; what a group holds per partition is summed and
    shifted in Spark, nothing comes to the driver.  The sorted rows are written
    once, so that places and counts read one materialisation.  A null group is
    a group like any other; rows equal in ``order`` get places in any order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranged")
    held = ranged.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("__part").alias("__p"), F.col(group).alias("__g"),
                       (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
                       F.sum("__n").over(whole).alias(total))
    same = (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g"))
    return (ranged.join(held, same).withColumn(pos, F.col("__at") + F.col("__shift"))
            .drop("__part", "__at", "__p", "__g", "__shift"))
