"""Filters and projections over a stream, written out as files: the operators are the same
DataFrame functions, the source and the sink differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def run_once(stream: DataFrame, change: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Everything that is there now, then stop; started again, it goes on from where it was."""
    return change(stream).writeStream.format(format).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
