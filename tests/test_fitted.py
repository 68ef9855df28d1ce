"""Fitted models on tasks: what they carry, and how many rows a task takes."""

from pyspark.ml import classification as cl
from pyspark.sql import functions as F

from furrow.operators import ml
from furrow.plans import catalog
from furrow.session import cut_lineage, measured, read_by

LEVELS = ml.ModelSpec("level", (), ("kind",), ("x",), classes=True)


def test_classifiers_of_two_classes_score_in_a_session_that_observed(spark):
    measured(spark.range(3))
    rows = spark.range(60).select(
        F.element_at(F.array(F.lit("Low"), F.lit("High")), (F.col("id") % 2 + 1).cast("int")).alias("level"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 2 + F.col("id") / 100).alias("x"),
    )
    line = cl.LogisticRegression(labelCol="label", maxIter=5)
    each = cl.OneVsRest(classifier=line, labelCol="label")
    models = {n: ml.fitted(ml.pipeline(LEVELS, e), rows) for n, e in (("line", line), ("each", each))}
    found = {r.model: r.accuracy for r in ml.evaluated(models, LEVELS, rows).collect()}
    assert found == {"line": 1.0, "each": 1.0}
    assert ml.train_and_evaluate("line", line, LEVELS, rows, rows)[1]["accuracy"] == 1.0


def test_a_task_of_a_fit_takes_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "TASK_ROWS", 500)
    rows = cut_lineage(spark.range(10_000).select((F.col("id") % 7).cast("double").alias("x"), F.lit("a").alias("kind"), F.lit(1.0).alias("y")).coalesce(1), 500)
    seen = []

    class Seen(ml.Pipeline):
        def _fit(self, dataset):
            seen.extend(dataset.groupBy(F.spark_partition_id()).count().toPandas()["count"])
            return super()._fit(dataset)

    spec = ml.ModelSpec("y", (), ("kind",), ("x",))
    ml.fitted(Seen(stages=ml.pipeline(spec, ml.rg.DecisionTreeRegressor(labelCol="y")).getStages()), rows)
    assert sum(seen) == 10_000 and max(seen) <= 1000
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_settings_of_the_caller_come_back(spark):
    name = "spark.sql.files.minPartitionNum"
    spark.conf.set(name, 50)
    try:
        with read_by(spark, 20):
            assert spark.conf.get(name) == "50"
        with read_by(spark, 70):
            assert spark.conf.get(name) == "70"
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.unset(name)


def test_requests_arrive_in_bounded_files(spark, data, monkeypatch, tmp_path):
    """A stream reads whole files in its tasks: their number grows with the requests."""
    monkeypatch.setattr(catalog, "TASK_ROWS", 500)
    files = catalog._request_files(spark, data, str(tmp_path / "requests"))
    sizes = spark.read.parquet(str(tmp_path / "requests")).groupBy(F.input_file_name()).count().toPandas()["count"]
    assert len(sizes) == files >= 12 and max(sizes) <= 600
