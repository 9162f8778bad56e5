"""Cleaning and cascade routing of arriving comments.

All steps are row-wise, so the batch functions run unchanged on a stream; there
is no state and hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from vigil.functions.text import clean_nonempty
from vigil.operators.sweeps import cascade_scores


def comment_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder; the batch size is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_comments(stream: DataFrame) -> DataFrame:
    return clean_nonempty(stream)


def route_comments(stream: DataFrame, t1: float = 0.20) -> DataFrame:
    """Rows with p1 and p2 get the final score and the routing flag."""
    return cascade_scores(stream, t1)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once file sink; the caller starts it."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
