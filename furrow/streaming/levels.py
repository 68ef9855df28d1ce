"""A keyed table that a stream appends to: runs of batches in levels, and a manifest that names them.

A batch becomes a run of level 0. When a level has ``fanout`` runs they are merged into one run of the
next level, which keeps one row per key. So n batches leave fewer than ``fanout`` runs on each of about
log(n) levels, and a row is rewritten once per level, whatever the number of batches.

What counts is the newest manifest: a run that none names is not read. It is switched after its runs are
whole, so a crash before the switch leaves the table as it was, and the next commit removes the leftovers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.files import Store

#: Manifests that stay, so a reader who has just read the one before still finds its runs.
KEPT_MANIFESTS = 2


@dataclass(frozen=True)
class Run:
    """Rows of the batches ``first`` to ``last``; in level 0 one batch."""

    name: str
    level: int
    first: int
    last: int


@dataclass(frozen=True)
class Manifest:
    version: int
    runs: tuple[Run, ...]
    schema: str | None

    @property
    def last(self) -> int:
        return max((run.last for run in self.runs), default=-1)


class LeveledTable:
    """Latest row per key of batches that come in order; one writer, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, key: str, fanout: int = 8):
        if fanout < 2:
            raise ValueError("a merge takes at least two runs")
        self.spark, self.path, self.key, self.fanout = spark, path.rstrip("/"), key, fanout
        self.store = Store(spark, self.path)

    # --- reading --------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        names = [x for x in self.store.names("manifests") if not x.startswith(".")]
        return self._load(names[-1]) if names else Manifest(0, (), None)

    def _load(self, name: str) -> Manifest:
        found = json.loads(self.store.read(f"manifests/{name}"))
        return Manifest(found["version"], tuple(Run(**x) for x in found["runs"]), found["schema"])

    def read(self) -> DataFrame:
        """The newest row of every key, without the batch it came from."""
        state = self.manifest()
        if state.schema is None:
            raise FileNotFoundError(f"nothing was published to {self.path}")
        return self._newest(state.runs, state.schema).drop("_batch")

    def _newest(self, runs: tuple[Run, ...], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        rows = [self.spark.read.schema(kind).parquet(f"{self.path}/runs/{run.name}") for run in runs]
        every = reduce(DataFrame.unionByName, rows)
        values = [c for c in every.columns if c not in (self.key, "_batch")]
        newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in values], "_batch"), "_batch").alias("_row")
        return every.groupBy(F.col(f"`{self.key}`")).agg(newest).select(f"`{self.key}`", "_row.*")

    # --- writing --------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch: int) -> None:
        """Publish the changed keys of a batch, at most one row each; a batch that is there already changes nothing."""
        state = self.manifest()
        if batch <= state.last:
            return
        written = rows.withColumn("_batch", F.lit(batch).cast("long"))
        runs = (*state.runs, self._write(written, 0, batch, batch))
        schema = state.schema or written.schema.json()
        runs = self._merged(runs, schema)
        self._switch(Manifest(state.version + 1, runs, schema))
        self._clean()

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Run:
        run = Run(f"{level}-{first}-{last}-{uuid.uuid4().hex[:8]}", level, first, last)
        rows.write.parquet(f"{self.path}/runs/{run.name}")
        return run

    def _merged(self, runs: tuple[Run, ...], schema: str) -> tuple[Run, ...]:
        """Merge levels that are full, from the lowest up; a merge may fill the next one."""
        level = 0
        while level <= max(run.level for run in runs):
            full = tuple(run for run in runs if run.level == level)
            if len(full) >= self.fanout:
                made = self._write(self._newest(full, schema), level + 1, min(x.first for x in full), max(x.last for x in full))
                runs = (*[run for run in runs if run.level != level], made)
            level += 1
        return runs

    def _switch(self, state: Manifest) -> None:
        """The new state counts from here on; a second writer fails here."""
        text = json.dumps({"version": state.version, "schema": state.schema, "runs": [asdict(run) for run in state.runs]})
        self.store.create(f"manifests/{state.version:012d}.json", text)

    def _clean(self) -> None:
        """Remove old manifests, and the runs that no manifest left names: merged ones and those of a crash."""
        names = [x for x in self.store.names("manifests") if not x.startswith(".")]
        for name in names[:-KEPT_MANIFESTS]:
            self.store.delete(f"manifests/{name}")
        named = {run.name for name in names[-KEPT_MANIFESTS:] for run in self._load(name).runs}
        for name in self.store.names("runs"):
            if name not in named:
                self.store.delete(f"runs/{name}")
