"""Factorization machines fitted on blocks of rows: MLlib's steps, without its loops over the factors of single values."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import factors

# Wider rows are left to MLlib, which never lays them out whole.
WIDEST = 512
# Blocks that a Python worker gets at a time; a block of nonzero values has at most 3 MB.
AT_ONCE = 8
BLOCKS = "labels binary, at binary, vals binary"


def fitted_machine(estimator: FMRegressor, rows: DataFrame) -> FMRegressionModel:
    """What ``estimator.fit(rows)`` gives, but for the order of sums; every iteration goes over all rows.

    MLlib checks the rows and draws the first weights itself, in a fit without iterations. Drawn batches, plain descent
    and machines without a linear part or intercept are fitted by it altogether.
    """
    of = estimator.getOrDefault
    plain = of("solver") == "adamW" and of("miniBatchFraction") == 1.0 and of("fitLinear") and of("fitIntercept")
    if not plain or of("maxIter") == 0:
        return estimator.fit(rows)
    start = estimator.copy({estimator.maxIter: 0}).fit(rows)
    if start.numFeatures > WIDEST:
        return estimator.fit(rows)
    blocks = _blocks(rows, of("featuresCol"), of("labelCol"))
    try:
        blocks.count()  # packed before the batches of Arrow become small
        n = rows.count()
        weights = np.append(np.column_stack([start.factors.toArray(), start.linear.toArray()]).ravel(), start.intercept)
        steps = factors.Steps(of("stepSize"), of("regParam"))
        with _arrow_rows(rows.sparkSession, AT_ONCE):
            for i in range(of("maxIter") if n else 0):
                before, weights = weights, steps.after(weights, _slopes(blocks, weights, start.numFeatures) / n)
                if i > 0 and factors.settled(before, weights, of("tol")):
                    break
    finally:
        blocks.unpersist()
    return _model(estimator, start, weights)


def _blocks(rows: DataFrame, features: str, label: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = list(factors.packed(x, batch.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], ["labels", "at", "vals"])

    dense = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return dense.mapInArrow(pack, BLOCKS).persist(StorageLevel.DISK_ONLY)


@contextmanager
def _arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Python workers get so many rows at a time within the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _slopes(blocks: DataFrame, weights: np.ndarray, width: int) -> np.ndarray:
    """The slopes by all weights, in their order, summed over all rows."""
    inner, intercept = weights[:-1].reshape(width, -1), weights[-1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(v.as_buffer() for v in row) for b in batches for row in zip(*b.columns))
        slopes, slope = factors.gradient(each, inner, intercept)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(slopes.ravel(), slope).tobytes()], pa.binary())], ["slopes"])

    parts = blocks.mapInArrow(partial, "slopes binary").collect()
    return np.sum([np.frombuffer(r.slopes) for r in parts], axis=0)


def _model(estimator: FMRegressor, start: FMRegressionModel, weights: np.ndarray) -> FMRegressionModel:
    """The weights as MLlib's model, with the estimator's parameters."""
    width, inner = start.numFeatures, weights[:-1].reshape(start.numFeatures, -1)
    context = SparkContext._active_spark_context
    linear = _py2java(context, DenseVector(inner[:, -1]))
    matrix = _py2java(context, DenseMatrix(width, inner.shape[1] - 1, inner[:, :-1].ravel(), True))
    made = context._jvm.org.apache.spark.ml.regression.FMRegressionModel(start.uid, float(weights[-1]), linear, matrix)
    model = FMRegressionModel(made)
    model._resetUid(start.uid)
    return estimator._copyValues(model)
