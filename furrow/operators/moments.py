"""One scan for the co-moments of many columns, whole or per group: correlations, linear models, r2."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import comoments
from furrow.functions.comoments import Moments

# executors need not have this package: the state travels with the task
cloudpickle.register_pickle_by_value(comoments)

PARTS = ("n", "mean", "square", "cross")
#: Groups a task keeps apart; more are sent on and merged later.
HELD = 1024
#: Partial states are merged in so many groups first, then these.
LANES = 64


def comoment_states(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """``key, n, mean, square, cross``: one mergeable state per value of ``key`` (null is one), from one scan.

    ``columns`` are numbers, or one array of doubles of the same length in every row. A task sends one
    state per key, whatever its rows; a table without rows gives none.
    """
    state = Moments
    array = len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array")
    wanted = [F.col(f"`{columns[0]}`")] if array else [F.array(*[F.col(f"`{c}`").cast("double") for c in columns])]
    keys = F.lit(None).cast("string") if key is None else F.col(f"`{key}`").cast("string")
    rows = df.select(keys.alias("key"), wanted[0].alias("values"))
    schema = "key string, lane int, " + ", ".join(f"{x} array<double>" for x in PARTS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1)
            width = len(values[0])
            table = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            names = batch.column(0).to_pandas()
            codes, found = pd.factorize(names, use_na_sentinel=False)
            for i, name in enumerate(found):
                name = None if pd.isna(name) else name
                made = state.of(table[codes == i])
                held[name] = held[name].merge(made) if name in held else made
            if len(held) > HELD:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    def packed(held: dict) -> pa.RecordBatch:
        parts = [x.pack() for x in held.values()]
        columns = [pa.array(list(held), pa.string()), pa.array([0] * len(held), pa.int32())]
        columns += [pa.array([p[i] for p in parts], pa.list_(pa.float64())) for i in range(len(PARTS))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "lane", *PARTS])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        whole = state.total(state.unpack(row) for row in group[list(PARTS)].itertuples(index=False)).pack()
        return pd.DataFrame({"key": group["key"][:1].to_numpy(), "lane": np.int32([0]), **{n: [x] for n, x in zip(PARTS, whole)}})

    states = rows.mapInArrow(partial, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    states = states.groupBy("key", "lane").applyInPandas(merged, schema).groupBy("key").applyInPandas(merged, schema)
    kind = "string" if key is None else dict(df.dtypes)[key]
    return states.select(F.col("key").cast(kind).alias(key or "key"), *PARTS)


def collected(states: DataFrame) -> dict:
    """States by key; their size depends on columns and keys, not on rows."""
    return {row[0]: Moments.unpack(row[1:]) for row in states.collect()}


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``first, second, n, corr`` of every pair of columns in order, over the rows that have both; null for a constant column."""
    names = list(columns)
    states = comoment_states(df, names)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for parts in batch[list(PARTS)].itertuples(index=False):
                whole = Moments.unpack(parts)
                corr = whole.correlations()
                i, j = np.triu_indices(len(names), 1)
                yield pd.DataFrame({
                    "first": np.array(names, object)[i], "second": np.array(names, object)[j], "n": whole.n[i, j].astype("int64"),
                    "corr": [None if np.isnan(x) else x for x in corr[i, j]],
                })

    return states.mapInPandas(rows, "first string, second string, n long, corr double")
