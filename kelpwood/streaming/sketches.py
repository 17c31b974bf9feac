"""Sketching as records arrive.

The result doesn't depend on how the input is cut into batches: what arrives is
turned into k-mer occurrences that carry their own order, appended to shared
storage batch by batch, and counted when the sample ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch's files, about: work for all cores, and what is done again after a failure.
BATCH_BYTES = 1 << 30


def drain(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Everything a stream has now, transformed and appended to path/batches, read back.

    A batch that is run again after a failure replaces its own folder, so nothing
    counts twice.
    """
    spark = stream.sparkSession
    schema = []

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch)
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not schema:
        return transform(spark.createDataFrame([], stream.schema))
    return spark.read.schema(schema[0]).parquet(f"{path}/batches/batch=*")


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream: in batches of BATCH_BYTES,
    or of so many files. Batches come one after another, so small ones leave cores idle."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is accepted too
    size = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", BATCH_BYTES)
    return spark.readStream.schema(spark.read.parquet(path).schema).option(*size).parquet(pattern)


def joined_mates(left: DataFrame, right: DataFrame, ordinal: str, lag: int = 100_000) -> DataFrame:
    """Two streams of mates joined by their ordinal. What has no partner yet is
    state, until the other stream is more than ``lag`` ordinals past it: the
    ordinal is the event time, one second each, and the lag its watermark."""
    late = f"{lag} seconds"
    at = F.timestamp_seconds(F.col(ordinal) + 1)  # a watermark starts at the epoch, and nothing is late there
    a, b = (side.withColumn("at_", at).withWatermark("at_", late) for side in (left, right))
    return a.join(b, [ordinal, "at_"]).drop("at_")
