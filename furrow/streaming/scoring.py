"""Prediction requests as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from furrow.operators.enrich import accepted, rejected, validated
from furrow.session import cut_lineage, scratch_path


def read_requests(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def start_scoring(requests: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> list:
    """Validate and score a stream as one plan: projections, joins with stored lookups, the model, a file sink.

    ``score`` may use what streams offer row by row. The sink's own log makes every request answered
    exactly once; rejected requests are a second query with a sink of their own.
    """
    checked = validated(requests)
    parts = {"scored": score(accepted(checked)), "rejected": rejected(checked)}
    started = []
    for part, rows in parts.items():
        writer = rows.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", f"{output}/{part}").option("checkpointLocation", f"{checkpoint}/{part}")
        started.append((writer.trigger(availableNow=True) if once else writer).start())
    return started


def start_allocating(requests: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True):
    """Validate and answer each micro-batch with batch functions that look at a whole request.

    The crops of a request are compared with each other, which streams do not offer, hence
    ``foreachBatch``. Every batch writes to its own folder: a retry replaces it, so each request is
    answered exactly once.
    """

    def publish(batch: DataFrame, number: int) -> None:
        checked = cut_lineage(validated(batch))
        score(accepted(checked)).write.mode("overwrite").parquet(f"{output}/scored/batch={number}")
        rejected(checked).write.mode("overwrite").parquet(f"{output}/rejected/batch={number}")

    writer = requests.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def scored_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Drain the available requests; scored and rejected rows."""
    spark = requests.sparkSession
    output = scratch_path(spark, "scores")
    for query in start_scoring(requests, score, output, scratch_path(spark, "scores-state")):
        query.awaitTermination()
    return tuple(spark.read.parquet(f"{output}/{part}") for part in ("scored", "rejected"))


def allocated_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The same for answers that look at a whole request."""
    spark = requests.sparkSession
    output = scratch_path(spark, "plans")
    start_allocating(requests, score, output, scratch_path(spark, "plans-state")).awaitTermination()
    return tuple(spark.read.parquet(f"{output}/{part}").drop("batch") for part in ("scored", "rejected"))
