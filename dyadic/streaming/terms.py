"""Term-by-term accumulation of dyads as a file stream (SE-3).

Each term's dyads land as new files in a landing folder; the stream appends
them to a table partitioned by term.  The checkpoint location lives in the
shared checkpoint folder, so a restarted query (or one that lost
executors) continues from the last committed batch and every term is
appended exactly once.  ``availableNow`` processes whatever has landed and
stops, which is how a term-at-a-time batch job runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_terms_stream(spark: SparkSession, landing: str, table: str, checkpoint: str,
                        schema: T.StructType | str, partition_by: str = "term",
                        max_files_per_trigger: int | None = None) -> None:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src: DataFrame = reader.parquet(landing)
    q = (src.writeStream.format("parquet").outputMode("append")
            .option("path", table).option("checkpointLocation", checkpoint)
            .partitionBy(partition_by).trigger(availableNow=True).start())
    q.awaitTermination()
