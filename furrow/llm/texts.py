"""Helpers shared by the text operators: Arrow maps, staged tables, tokenizer files, word positions."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import furrow
from furrow.session import scratch_path

#: White space of the word definition: blank and \t \n \v \f \r, as bytes.split() has it.
BLANKS = b" \t\n\x0b\x0c\r"
#: Texts that one Arrow batch may hold; a worker keeps one batch and its results.
BATCH_ROWS = 1000


#: What operators keep in a Python worker from task to task, by their module.
_kept: dict[str, dict] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` turns one Arrow batch of at most ``BATCH_ROWS`` rows into another (None: no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = each(batch) if batch.num_rows else None
            if made is not None:
                yield made

    return map_partition(df, run, schema, each.__module__)


def map_partition(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str | None = None
) -> DataFrame:
    """``owner``: the module of the operator, by default that of ``run``; what other operators keep in the worker goes."""
    owner = owner or run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from run(batches)

    reachable(df.sparkSession)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(alone, schema)


def kept_by_worker(owner: str) -> dict:
    """A place for tables that an operator's module keeps in a worker; it is emptied when another operator comes."""
    return _kept.setdefault(owner, {})


def forget_others(owner: str) -> None:
    """A worker lives through many steps, and shares an executor's memory: it keeps the tables of one operator."""
    gone = [tables for name, tables in _kept.items() if name != owner and tables]
    for tables in gone:
        tables.clear()
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()


def reachable(spark: SparkSession) -> None:
    """Workers that share the driver's file system find the package where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(furrow.__file__).parents[1]))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """While caches fill, the collector would walk over them again and again; they hold no cycles."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def task() -> int:
    """Number of this task's partition; the same when the task is repeated."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    values = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
    return [value or b"" for value in values]


def table(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)],
        schema=pa.schema(schema),
    )


def keyed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; others cannot clash with its own."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def shared_file(spark: SparkSession, path: str):
    """A vocabulary file, read on the driver and sent to the workers once (a few MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def most_frequent(counts: DataFrame, most: int) -> int:
    """The least ``n`` at which no more than ``most`` rows are left; by a histogram of eighths of powers of two."""
    level = F.floor(8 * F.log2(F.col("n"))).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in rows:
        total += row["rows"]
        if total > most:
            break
        least = row["level"]
    return 1 if total <= most else (1 << 62 if least is None else math.ceil(2 ** (least / 8) - 1e-9))


def windows(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, joined by blanks, in order; none if there are fewer words."""
    if len(words) < size:
        return []
    joined = b" ".join(words)
    ends = []
    at = -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-1]]]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :])]
