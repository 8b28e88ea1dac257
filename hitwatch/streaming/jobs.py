"""Structured Streaming jobs: incremental ingest, stateless vectors and scores. Frames over arriving events are in ``frames``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hitwatch.functions.vectors import has_non_finite, pad, repair, zscore_keep


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = 16, pattern: str | None = None) -> DataFrame:
    """New Parquet files of a folder, so many a micro-batch, or (None) all that are there."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def event_vectors(df: DataFrame, column: str, input_dim: int, normalise: bool = True, out: str = "x") -> DataFrame:
    """Fixed-length vectors of a (streaming or batch) table, with ``repaired`` where non-finite values became 0."""
    vector = pad(F.col(column), input_dim)
    made = df.withColumn(out, zscore_keep(vector) if normalise else vector)
    return made.withColumn("repaired", has_non_finite(F.col(out))).withColumn(out, repair(F.col(out)))


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, append the rows to a Parquet folder, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
