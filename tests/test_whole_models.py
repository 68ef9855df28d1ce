"""Boards fit their models as far as the notebooks do: all iterations, trees, levels and factors."""

import pytest
from pyspark.sql import functions as F

from furrow.operators import ml
from furrow.plans import catalog

COLS = {"featuresCol": "features"}


@pytest.fixture(scope="module")
def records(spark):
    """600 prepared records whose levels and profits depend on several inputs, some more than on others."""
    def unit(n):
        return F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(1000)) / 1000

    numbers = dict.fromkeys([*ml.DEMAND.numeric_columns, *ml.PROFIT.numeric_columns])
    categories = dict.fromkeys([*ml.DEMAND.categories, *ml.PROFIT.categories])
    rows = spark.range(600).select(
        "id", *[unit(i).alias(c) for i, c in enumerate(numbers)],
        *[F.concat(F.lit(c[0]), F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(4))).alias(c) for c in categories],
    )
    score = F.expr("humidity * rainfall + 0.3 * temperature + 0.2 * supply_score - 0.3 * wind_speed + 0.001 * sale_gap_days")
    level = F.when(score < 0.2, "Low").when(score < 0.45, "Medium").otherwise("High")
    made = rows.select("*", level.alias("demand_level"), F.expr("area_size * water_used - 0.5 * rainfall").alias("profit")).localCheckpoint()
    return made.where("id < 450"), made.where("id >= 450")


def board_of(query, records, spark, monkeypatch):
    monkeypatch.setattr(catalog, "_training", lambda *_: records)
    return {r.model: r.asDict() for r in catalog.QUERIES[query](spark, "").collect()}


def fit(estimator, spec, records):
    return {k: v for k, v in ml.train_and_evaluate("", estimator, spec, *records)[1].items() if k != "model"}


def check(board, name, whole, less, spec, records):
    """The board's row is the one of the whole model, which ``less`` does not reach."""
    found = {k: v for k, v in board[name].items() if k != "model"}
    expected = fit(whole, spec, records)
    assert found == pytest.approx(expected)
    assert fit(less, spec, records) != pytest.approx(expected)


def test_train_demand_iterates_the_logistic_regression_to_its_end(spark, records, monkeypatch):
    board = board_of("train_demand", records, spark, monkeypatch)
    assert set(board) == {"Logistic Regression", "Decision Tree"}
    line = ml.cl.LogisticRegression(**COLS)
    check(board, "Logistic Regression", line.copy().setMaxIter(100), line.copy().setMaxIter(5), ml.DEMAND, records)


def test_train_demand_rest_grows_a_whole_forest_and_iterates_to_the_end(spark, records, monkeypatch):
    board = board_of("train_demand_rest", records, spark, monkeypatch)
    assert set(board) == {"Random Forest", "Naive Bayes", "OneVsRest"}
    forest, line = ml.cl.RandomForestClassifier(seed=ml.SEED, **COLS), ml.cl.LogisticRegression(**COLS)
    check(board, "Random Forest", forest.copy().setNumTrees(20).setMaxDepth(5), forest.copy().setNumTrees(5).setMaxDepth(4), ml.DEMAND, records)
    whole, less = (ml.cl.OneVsRest(classifier=line.copy().setMaxIter(n), **COLS) for n in (100, 5))
    check(board, "OneVsRest", whole, less, ml.DEMAND, records)


def test_train_profit_rest_iterates_the_factorization_machine_with_all_factors(spark, records, monkeypatch):
    board = board_of("train_profit_rest", records, spark, monkeypatch)
    assert set(board) == {"Gaussian GLM", "Factorization Machine"}
    machine = ml.rg.FMRegressor(labelCol="profit", seed=ml.SEED, **COLS)
    check(board, "Factorization Machine", machine.copy().setMaxIter(100).setFactorSize(8), machine.copy().setMaxIter(5).setFactorSize(2), ml.PROFIT, records)
