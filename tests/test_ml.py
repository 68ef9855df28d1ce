import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from furrow.operators import ml
from furrow.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def records(spark, data):
    from furrow.plans.farm_view import farm_records

    return farm_records(spark, data).limit(1500).persist()


@pytest.fixture(scope="module")
def parts(records):
    return ml.hash_split(ml.prepared(records, ml.YIELD, keep=["record_id"]), ["record_id"])


@pytest.fixture(scope="module")
def model(parts):
    return ml.pipeline(ml.YIELD, ml.rg.DecisionTreeRegressor(labelCol="actual_yield", seed=1)).fit(parts[0])


def test_split_does_not_depend_on_partitions(records):
    rows = ml.prepared(records, ml.YIELD, keep=["record_id"])
    first = ml.hash_split(rows, ["record_id"])[0].select("record_id").distinct().collect()
    second = ml.hash_split(rows.repartition(7), ["record_id"])[0].select("record_id").distinct().collect()
    assert sorted(first) == sorted(second) and 0.7 < len(first) / rows.select("record_id").distinct().count() < 0.9
    train, test = ml.random_split(rows)
    assert train.count() + test.count() == rows.count()


def test_feature_counts(model, parts):
    names = ml.feature_names(model.transform(parts[1]))
    assert names[:14] == ml.YIELD.numeric_columns and len(ml.PROFIT.numeric_columns) == 16 and len(ml.PRICE.numeric_columns) == 6


def test_regression_metrics_equal_the_evaluator(model, parts):
    scored = model.transform(parts[1])
    found = ml.regression_metrics(scored, "actual_yield").first()
    for name in ("r2", "rmse", "mae"):
        expected = RegressionEvaluator(labelCol="actual_yield", metricName=name).evaluate(scored)
        assert found[name] == pytest.approx(expected, abs=1e-9)


def test_classification_metrics_equal_the_evaluator(spark):
    pairs = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(2.0, 1.0)] * 4 + [(1.0, 0.0)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    found = ml.classification_metrics(df).first()
    for name, metric in (("accuracy", "accuracy"), ("f1", "f1"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall")):
        assert found[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_model_survives_saving(model, parts, tmp_path):
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    order = ["record_id", "actual_yield", "prediction"]
    assert again.transform(parts[1]).select(order).orderBy(order).collect() == model.transform(parts[1]).select(order).orderBy(order).collect()


def test_importances_and_unseen(model, parts):
    top = ml.feature_importances(model, model.transform(parts[0])).collect()
    assert top[0].feature == "temperature" and len(top) == 20 and sum(r.importance for r in top) == pytest.approx(1.0)
    odd = parts[1].withColumn("crop_name", F.lit("Kiwi"))
    found = {r.column_name: r.unseen for r in ml.unseen_categories(odd, model, ml.YIELD).collect()}
    assert found["crop_name"] == parts[1].count() and found["region_type"] == 0


def test_grids_have_the_expected_sizes():
    zoo = {**ml.regressors("y")}
    assert sum(len(ml.param_grid(m)) for m in zoo.values()) == 46
    four = ("Linear Regression", "Decision Tree", "Random Forest", "GBT")
    assert sum(len(ml.param_grid(zoo[n])) for n in four) == 35
    assert sum(len(ml.param_grid(m)) for n, m in ml.classifiers().items() if n != "OneVsRest") == 26


def test_training_tuning_and_boards(spark, parts):
    train, test = parts
    tree = ml.rg.DecisionTreeRegressor(labelCol="actual_yield", seed=1)
    _, base = ml.train_and_evaluate("tree", tree, ml.YIELD, train, test)
    found, row = ml.tune_and_evaluate("tuned", tree, ml.YIELD, train, test, {"maxDepth": [1, 4]}, folds=2)
    assert found.bestModel.stages[-1].getMaxDepth() == 4 and row["test_r2"] > 0.5
    first = ml.leaderboard(spark, [base, {"model": "a", "r2": 0.1, "rmse": 1.0, "mae": 1.0}], "r2")
    second = ml.leaderboard(spark, [row], "test_r2")
    assert [r.model for r in first.collect()] == ["tree", "a"]
    assert [(r.version, r.model) for r in ml.compared(first, second, "r2", "test_r2").collect()] == [("untuned", "tree"), ("tuned", "tuned")]


@pytest.mark.parametrize("train, test, verdict", [(0.9, 0.8, "Overfitting"), (0.6, 0.6, "Underfitting"), (0.8, 0.78, "Well-balanced")])
def test_verdict(spark, train, test, verdict):
    assert ml.with_verdict(spark.createDataFrame([(train, test)], "a double, b double"), "a", "b").first().verdict == verdict


def test_bake_off_needs_a_positive_score(spark):
    line = spark.range(200).selectExpr("if(id % 2 = 0, 'a', 'b') as k", "cast(id as double) as x", "cast(id * 3 as double) as y")
    models = {"linear": ml.rg.LinearRegression(featuresCol="scaled_features", labelCol="y")}
    name, fitted, board = ml.bake_off(models, ["k"], ["x"], "y", line)
    assert name == "linear" and board.first().r2 == pytest.approx(1.0) and len(fitted.stages) == 4
    noise = spark.range(200).selectExpr("'a' as k", "cast(hash(id) as double) as x", "cast(hash(id, 7) % 100 as double) as y")
    with pytest.raises(ValueError, match="r2 > 0"):
        ml.bake_off({"tree": ml.rg.DecisionTreeRegressor(featuresCol="scaled_features", labelCol="y", maxDepth=10)}, ["k"], ["x"], "y", noise)


def test_readable_predictions(records):
    known = ml.prepared(records.where("demand_level in ('Low', 'Medium', 'High')"), ml.DEMAND)
    model = ml.pipeline(ml.DEMAND, ml.cl.NaiveBayes(labelCol="label")).fit(known)
    scored = ml.readable_predictions(model.transform(known), model, "demand_level")
    labels = ml.learned_labels(model, "demand_level")
    sizes = {r["demand_level"]: r["count"] for r in known.groupBy("demand_level").count().collect()}
    assert sizes[labels[0]] == max(sizes.values())  # the most frequent level comes first
    assert all(labels[int(r.prediction)] == r.predicted_demand_level for r in scored.select("prediction", "predicted_demand_level").distinct().collect())


def test_all_models_are_judged_in_one_scan(spark):
    rows = [(float(i), float(i % 7), float(2 * i + i % 3), "hi" if i % 5 < 3 else "lo") for i in range(120)] + [(1.0, 2.0, None, "lo")]
    df = spark.createDataFrame(rows, "a double, b double, y double, level string")
    spec = ml.ModelSpec("y", (), (), ("a", "b"))
    models = {name: ml.line_model(spec, [name]).fit(df.dropna()) for name in ("a", "b")}
    found = {r["model"]: r.asDict() for r in ml.evaluated(models, spec, df).collect()}
    for name, model in models.items():
        wanted = ml.regression_metrics(model.transform(df), "y").first().asDict()
        assert {k: found[name][k] for k in wanted} == pytest.approx(wanted)
    spec = ml.ModelSpec("level", (), (), ("a", "b"), classes=True)
    tree = ml.cl.DecisionTreeClassifier(maxDepth=2)
    models = {name: ml.line_model(spec, [name], tree).fit(df) for name in ("a", "b")}
    found = {r["model"]: r.asDict() for r in ml.evaluated(models, spec, df).collect()}
    for name, model in models.items():
        wanted = ml.classification_metrics(model.transform(df)).first().asDict()
        assert {k: found[name][k] for k in wanted} == pytest.approx(wanted)
