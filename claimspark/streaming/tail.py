"""Structured Streaming over the log: a resumable tail, derived claims kept up to date, effects delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """New files of operations as they are committed; the sink's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def follow(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``handle`` on each batch of everything there is, then stop."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(source: DataFrame, at: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than ``late`` are left out."""
    return source.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
