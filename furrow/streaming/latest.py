"""Running latest value per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from furrow.operators.stats import latest_per_key
from furrow.session import scratch_path
from furrow.streaming.levels import LeveledTable


def start_latest(stream: DataFrame, key: str, order: Sequence[str], value: str, table: str, checkpoint: str, fanout: int = 8):
    """Keep the latest value per key of a stream in a table of levels.

    State is one row per key, and each trigger writes only the keys it changed. A late row that is
    older than the known one changes nothing, and neither does a batch that is tried again.
    """
    levels = LeveledTable(stream.sparkSession, table, key, fanout)
    latest = latest_per_key(stream, key, order, value)
    writer = latest.writeStream.outputMode("update").foreachBatch(levels.append)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, table: str, key: str) -> DataFrame:
    """Current values: per key, the one of the last batch that changed it."""
    return LeveledTable(spark, table, key).read()


def latest_of_stream(stream: DataFrame, key: str, order: Sequence[str], value: str, fanout: int = 8) -> DataFrame:
    """Drain what is available and return the current values."""
    spark = stream.sparkSession
    table = scratch_path(spark, "latest")
    start_latest(stream, key, order, value, table, scratch_path(spark, "latest-state"), fanout).awaitTermination()
    return published(spark, table, key)
