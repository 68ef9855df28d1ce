"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.files import Store


def build_session(app: str = "furrow", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on (UTC dates, AQE, ANSI)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="furrow-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


class _Scratch:
    """What this driver has below the shared folder: its own folder, and small tables it has stored there."""

    #: Small tables that are remembered; older ones are stored anew.
    MOST = 256
    #: A table read from more files is not compared with earlier ones.
    FILES = 1000

    def __init__(self) -> None:
        self.folders: dict[str, str] = {}
        self.known: OrderedDict[tuple, list[tuple[DataFrame, DataFrame, int]]] = OrderedDict()

    def folder(self, spark: SparkSession) -> str:
        """A folder of this application, removed when its JVM ends."""
        root = checkpoint_root(spark)
        if root not in self.folders:
            store = Store(spark, f"{root}/stages-{uuid.uuid4().hex}")
            store.delete_on_exit()
            self.folders[root] = store.root
        return self.folders[root]

    def key(self, df: DataFrame) -> tuple | None:
        """What a stored table must share with ``df`` to stand for it, files and their times included."""
        if df.isStreaming:
            return None
        files = df.inputFiles()
        if len(files) > self.FILES:
            return None
        seen = Store(df.sparkSession, self.folder(df.sparkSession)).stamps(sorted(files))
        return self.folder(df.sparkSession), df.semanticHash(), df.schema.json(), seen

    def find(self, df: DataFrame, key: tuple | None) -> tuple[DataFrame, int] | None:
        for plan, stored, size in self.known.get(key, []) if key else []:
            if plan.sparkSession is df.sparkSession and plan.sameSemantics(df):
                self.known.move_to_end(key)
                return stored, size
        return None

    def keep(self, df: DataFrame, key: tuple | None, stored: DataFrame, size: int) -> None:
        if key:
            self.known.setdefault(key, []).append((df, stored, size))
            while len(self.known) > self.MOST:
                self.known.popitem(last=False)

    def clear(self, spark: SparkSession) -> None:
        root = checkpoint_root(spark)
        if root in self.folders:
            Store(spark, self.folders.pop(root)).delete()
        self.known.clear()


_SCRATCH = _Scratch()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder; it goes when the application ends."""
    return f"{_SCRATCH.folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_stages(spark: SparkSession) -> None:
    """Remove all stages now; tables that were read from them cannot be read any more."""
    _SCRATCH.clear(spark)


def cut_lineage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Written to the shared folder as parquet and read back.

    Computed once, survives lost executors, and later steps still read only the columns and
    row groups that they need. Files of at most ``rows_per_file`` rows (0: any) can be read by as many tasks.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Store ``df`` and return it with its size in bytes, seen in the same job.

    The same plan over the same files is stored once per application; later calls get what is there.
    """
    key = _SCRATCH.key(df)
    known = _SCRATCH.find(df, key)
    if known:
        return known
    width = sum(_fixed_width(f.dataType) for f in df.schema.fields)
    size = F.lit(width).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
    seen = Observation()
    stored = cut_lineage(df.observe(seen, F.coalesce(F.sum(size), F.lit(0)).alias("bytes")))
    bytes_ = int(seen.get["bytes"])
    _SCRATCH.keep(df, key, stored, bytes_)
    return stored, bytes_


def _fixed_width(data_type: T.DataType) -> int:
    return 16 if isinstance(data_type, T.StringType) else 8


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# A task should hold about this much of a file.
TASK_BYTES = 64 * 1024 * 1024
# A file of so much per core has row groups for all cores, unless they are large.
SPLIT_BYTES = 16 * 1024 * 1024
# A task that keeps its rows as objects should hold about so many.
TASK_ROWS = 250_000


@contextmanager
def read_by(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Files are read by about so many tasks within the block, or by one per core if that is more.

    Left to itself a scan gives each task up to 128 MB of a file, however many rows that is.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if tasks > max(spark.sparkContext.defaultParallelism, int(before or 0)):
        spark.conf.set(name, tasks)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """Use all cores for rows that come from a small table stored in few row groups.

    When the scan of ``source`` is split already the rows are left as they are: shuffling them would only cost.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few_tasks(source) else df


def few_tasks(source: DataFrame) -> bool:
    """Whether a scan leaves cores idle: one of less than ``SPLIT_BYTES`` per core, or of less than ``TASK_BYTES``
    with more than twice an even share of its rows in one task. Rows are counted without reading a column."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not cores * SPLIT_BYTES <= size < cores * TASK_BYTES:
        return size < cores * TASK_BYTES
    counts = source.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    most, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return not rows or most * cores > 2 * rows
