"""Co-moments, correlations and linear searches against numpy, pandas and MLlib."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from furrow.functions.comoments import Moments
from furrow.operators import linear, ml, moments


def numbers(rows=400, holes=0.2, seed=1):
    draw = np.random.default_rng(seed)
    made = draw.normal(size=(rows, 5)) @ draw.normal(size=(5, 5)) + [1e6, 0, -3, 50, 7]
    made[:, 4] = 2.5
    made[draw.random(made.shape) < holes] = np.nan
    return made


def test_merged_states_equal_one_state():
    rows = numbers()
    whole = Moments.of(rows)
    parts = Moments.total(Moments.of(x) for x in np.array_split(rows, [0, 1, 5, 100, 101, 390]))
    for a, b in zip(whole.pack(), parts.pack()):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-7)
    back = Moments.unpack(whole.pack())
    assert all((a == b).all() for a, b in ((back.n, whole.n), (back.cross, whole.cross)))
    wanted = pd.DataFrame(rows).corr().to_numpy()
    found = whole.correlations()
    assert np.allclose(found[:4, :4], wanted[:4, :4], atol=1e-9) and np.isnan(found[4]).all()


def test_no_rows_and_one_row():
    none = Moments.of(np.zeros((0, 3)))
    assert (none.n == 0).all() and np.isnan(none.correlations()).all()
    one = none.merge(Moments.of(np.array([[1.0, np.nan, 3.0]])))
    assert one.n.tolist() == [[1, 0, 1], [0, 0, 0], [1, 0, 1]] and one.mean[0, 2] == 1 and np.isnan(one.correlations()).all()


def test_correlation_matrix_against_pandas(spark):
    frame = pd.DataFrame(numbers(), columns=list("abcde"))
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in frame.to_numpy()], "a double, b double, c double, d double, e double")
    wanted, there = frame.corr(), frame.notna()
    found = moments.correlation_matrix(df.repartition(7), list("abcde")).collect()
    assert len(found) == 10
    for r in found:
        assert r["n"] == (there[r["first"]] & there[r["second"]]).sum()
        if "e" in (r["first"], r["second"]):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(wanted.loc[r["first"], r["second"]], abs=1e-9)
    assert moments.correlation_matrix(df.limit(0), list("abcde")).collect() == []


def test_states_per_group(spark):
    rows = [(i % 3 if i % 10 else None, float(i), float(i * i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    found = moments.collected(moments.comoment_states(df, ["x", "y"], "g"))
    assert set(found) == {0, 1, 2, None}
    for key, state in found.items():
        own = np.array([r[1:] for r in rows if r[0] == key])
        assert state.n[0, 0] == len(own) and np.allclose(np.diag(state.mean), own.mean(0))
        assert state.cross[0, 1] == pytest.approx(((own - own.mean(0))[:, 0] * (own - own.mean(0))[:, 1]).sum())


def regression_rows(spark, n=600):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 5, 2, 0]
    x[:, 3] = 0.5 * x[:, 0] + 0.1 * x[:, 3]
    y = x @ [3.0, -0.2, 8.0, 0.0] + 4 + draw.normal(size=n)
    rows = [(*map(float, a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).cache()


@pytest.mark.parametrize("reg, elastic", [(0.0, 0.0), (0.1, 0.0), (0.1, 0.5), (0.5, 1.0)])
def test_fit_equals_mllib(spark, reg, elastic):
    df = regression_rows(spark)
    wanted = LinearRegression(featuresCol="features", labelCol="y", regParam=reg, elasticNetParam=elastic, solver="normal", tol=1e-12, maxIter=1000).fit(df)
    state = moments.collected(moments.comoment_states(df, ["a", "b", "c", "d", "y"]))[None]
    line = linear.fit(state, reg, elastic)
    assert np.allclose(line.coefficients, wanted.coefficients.toArray(), atol=2e-5) and line.intercept == pytest.approx(wanted.intercept, abs=2e-4)
    found = linear.judged(state, linear.fit(state, reg, elastic))
    assert found["r2"] == pytest.approx(wanted.summary.r2, abs=1e-6) and found["rmse"] == pytest.approx(wanted.summary.rootMeanSquaredError, abs=1e-5)


def test_search_equals_cross_validation(spark):
    df = regression_rows(spark)
    model = LinearRegression(featuresCol="features", labelCol="y", tol=1e-10, maxIter=500)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 0.01, 0.1]).addGrid(model.elasticNetParam, [0.0, 0.5, 1.0]).build()
    judge = RegressionEvaluator(labelCol="y", metricName="r2")
    wanted = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold", parallelism=4).fit(df)
    found = linear.search(linear.fold_states(df.select(*"abcd", "y", "fold"), list("abcd"), "y", "fold"))
    for setting, r2 in zip(grid, wanted.avgMetrics):
        own = next(r for r in found.rows if (r["regParam"], r["elasticNetParam"]) == (setting[model.regParam], setting[model.elasticNetParam]))
        assert own["r2"] == pytest.approx(r2, abs=1e-6)
    best = grid[int(np.argmax(wanted.avgMetrics))]
    assert (found.best["regParam"], found.best["elasticNetParam"]) == (best[model.regParam], best[model.elasticNetParam])
    assert found.train["r2"] == pytest.approx(judge.evaluate(wanted.bestModel.transform(df)), abs=1e-6)


def test_search_over_encoded_categories(spark, data):
    from furrow.plans.catalog import _training

    train, _ = _training(spark, data, ml.PROFIT)
    stages = ml.Pipeline(stages=ml.feature_stages(ml.PROFIT)).fit(train)
    rows = linear.assembled(
        train.withColumn("fold", train["record_id"] % 3), stages, ["profit", "fold"])
    found = linear.search(linear.fold_states(rows, "features", "profit", "fold"), {"regParam": [0.0, 0.1]})
    fitted = ml.pipeline(ml.PROFIT, LinearRegression(labelCol="profit", solver="normal")).fit(train)
    wanted = ml.regression_metrics(fitted.transform(train), "profit").first()
    line = linear.fit(Moments.total(linear.fold_states(rows, "features", "profit", "fold").values()))
    scored = rows.select("profit", line.column().alias("prediction"))
    assert ml.regression_metrics(scored, "profit").first()["r2"] == pytest.approx(wanted["r2"], abs=1e-6)
    assert found.train["r2"] == pytest.approx(wanted["r2"], abs=1e-4)


def test_one_fold_is_refused(spark):
    with pytest.raises(ValueError):
        linear.search({0: Moments.of(np.ones((3, 2)))})
