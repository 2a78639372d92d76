"""Dense ranks inside groups without a single-partition window.

Rows are range partitioned on (group, order...) and sorted inside each
partition; ``monotonically_increasing_id`` then numbers rows in sorted order
inside a partition.  A table of (partition, group) -> (first id, count) - at
most #partitions x #groups rows - turns those numbers into ranks within the
group.  A group larger than a partition simply spans several partitions, so
a hot group is split across tasks.  The ranged table is written (in the shared
checkpoint folder) so the counts and the ids read one materialisation even if
an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.operators.iterate import cut


def rank_within(df: DataFrame, group: str, order: Sequence[str], rank: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rank`` = 0-based position of each row inside its ``group`` when
    rows are sorted by ``order`` (rows must be distinct on group + order for
    a deterministic result)."""
    spark = df.sparkSession
    keys = [group, *order]
    # without an explicit count, adaptive execution sizes the range partitions
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    ranged = cut(ranged.sortWithinPartitions(*keys)
                 .withColumn("__pid", F.spark_partition_id())
                 .withColumn("__mid", F.monotonically_increasing_id()))
    parts = (ranged.groupBy("__pid", group).agg(F.min("__mid").alias("mid0"),
                                                 F.count(F.lit(1)).alias("n"))
                   .orderBy(group, "__pid").collect())
    shift, running = {}, {}
    for r in parts:
        g = r[group]
        start = running.get(g, 0)
        shift[(r["__pid"], g)] = start - r["mid0"]
        running[g] = start + r["n"]
    # The shift table is bounded by #partitions x #groups; it joins as a
    # broadcast constant.  A null group is a group like any other.
    sh = spark.createDataFrame([(p, g, int(s)) for (p, g), s in shift.items()],
                               schema=f"__p int, __g {dict(df.dtypes)[group]}, __shift long")
    return (ranged.join(F.broadcast(sh), (F.col("__pid") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "inner")
                  .withColumn(rank, F.col("__mid") + F.col("__shift"))
                  .drop("__pid", "__mid", "__shift", "__p", "__g"))
