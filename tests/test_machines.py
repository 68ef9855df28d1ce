"""Factorization machines fitted on blocks of rows give what MLlib gives."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from furrow.functions import factors
from furrow.operators import machines, ml


@pytest.fixture(scope="module")
def encoded(spark):
    """300 encoded rows in 4 parts, two of them empty; many values are 0, some rows only have zeros."""
    rows = spark.range(0, 300, 1, 2).selectExpr(
        "if(id % 3 = 0, 0D, id % 7 - 2.5D) as a", "cast(id % 5 = 1 as double) as b", "if(id % 3 = 0, 0D, id % 11 * 100D) as c", "id % 13 * 1D as y"
    )
    rows = rows.union(rows.where("y < 0"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows).select("x", "y").localCheckpoint()


def weights(model):
    return np.concatenate([model.factors.toArray().ravel(), model.linear.toArray(), [model.intercept]])


def parameters(model):
    return {p.name: v for p, v in model.extractParamMap().items()}


def machine(**params):
    return ml.rg.FMRegressor(featuresCol="x", labelCol="y", seed=3, **params)


@pytest.mark.parametrize("params", [
    {"maxIter": 30}, {"maxIter": 7, "factorSize": 3, "regParam": 0.1, "stepSize": 0.05}, {"maxIter": 40, "tol": 0.05}, {"maxIter": 0},
    {"maxIter": 3, "solver": "gd", "stepSize": 1e-6}, {"maxIter": 3, "miniBatchFraction": 0.5}, {"maxIter": 3, "fitLinear": False},
    {"maxIter": 3, "fitIntercept": False},
])
def test_a_machine_of_blocks_is_the_one_of_mllib(spark, encoded, params):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    estimator = machine(**params)
    made, plain = machines.fitted_machine(estimator, encoded), estimator.fit(encoded)
    assert weights(made) == pytest.approx(weights(plain), rel=1e-9, abs=1e-9)
    assert made.uid == plain.uid and parameters(made) == parameters(plain)
    loaded = ml._reloaded(PipelineModel([made]), spark).transform(encoded).select("prediction").collect()
    assert [r[0] for r in loaded] == pytest.approx([r.prediction for r in plain.transform(encoded).collect()])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_wide_rows_are_left_to_mllib(encoded, monkeypatch):
    monkeypatch.setattr(machines, "WIDEST", 2)
    monkeypatch.setattr(machines, "_blocks", None)
    assert weights(machines.fitted_machine(machine(maxIter=2), encoded)) == pytest.approx(weights(machine(maxIter=2).fit(encoded)))


def test_sparse_vectors_and_no_rows(spark, encoded):
    sparse = spark.createDataFrame([(Vectors.sparse(3, {1: 2.0}), 1.0), (Vectors.dense(1.0, 0.0, 3.0), 2.0), (Vectors.sparse(3, {}), 0.5)], ["x", "y"])
    none = encoded.where("y < 0")
    for rows in (sparse, none):
        assert weights(machines.fitted_machine(machine(maxIter=5), rows)) == pytest.approx(weights(machine(maxIter=5).fit(rows)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bad", ["null", "double('NaN')", "double('Infinity')"])
def test_rows_that_mllib_refuses_are_refused(encoded, bad):
    with pytest.raises(Exception, match="MUST NOT"):
        machines.fitted_machine(machine(maxIter=2), encoded.withColumn("y", F.expr(f"if(y = 3, {bad}, y)")))


def test_rows_are_cut_into_blocks(monkeypatch):
    x = np.random.default_rng(1).integers(0, 3, (50, 4)).astype(float)
    y, v = np.arange(50.0), np.random.default_rng(2).random((4, 3))
    whole = factors.gradient(factors.packed(x, y), v, 0.5)
    monkeypatch.setattr(factors, "CELLS", 28)
    blocks = list(factors.packed(x, y))
    assert len(blocks) == 8 and b"".join(b[0] for b in blocks) == y.tobytes()
    for got, want in zip(factors.gradient(blocks, v, 0.5), whole):
        assert got == pytest.approx(want)


def test_the_model_jobs_fit_machines_in_blocks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "fitted_machine", lambda estimator, rows: seen.append(rows.columns) or estimator.fit(rows))
    spec = ml.ModelSpec("y", (), ("kind",), ("x",))
    train = spark.range(20).selectExpr("id * 1D as x", "string(id % 2) as kind", "id * 2D as y")
    estimator = ml.rg.FMRegressor(labelCol="y", maxIter=1)
    ml.fitted(ml.pipeline(spec, estimator), train)
    ml.fitted_all(spec, {"line": ml.rg.LinearRegression(labelCol="y"), "machine": estimator}, train)
    assert seen == [["features", "y"]] * 2
