"""Intake as a stream: text units that arrive over time become blocks, and coverage is kept up to date. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidra.sources import text


def block_stream(spark: SparkSession, folder: str, schema: str, source: str, column: str) -> DataFrame:
    """Blocks of the Parquet files that come into ``folder``; stateless, so any number of executors share the work."""
    return text.line_blocks(spark.readStream.schema(schema).parquet(folder), source, column)


def keep_blocks(blocks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends blocks to Parquet, each input once; takes what is there and ends."""
    return blocks.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_stream(blocks: DataFrame, time: str, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """blocks and needs_review for each window of ``time``; a window is final once the watermark has passed it."""
    timed = blocks.withWatermark(time, lateness).groupBy(F.window(time, window))
    return timed.agg(F.count("*").alias("blocks"), F.count_if(F.col("disposition") != "parsed").alias("needs_review"))
