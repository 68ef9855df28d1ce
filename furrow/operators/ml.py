"""Feature pipelines, model zoo, tuning, metrics and leaderboards on MLlib."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as cl
from pyspark.ml import regression as rg
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.machines import fitted_machine
from furrow.session import TASK_ROWS, cut_lineage, read_by, scratch_path
from furrow.sources.models import load_model, save_model

SEED = 42
FOLDS = 3
GAP_LIMIT, SCORE_LIMIT = 0.05, 0.7


@dataclass(frozen=True)
class ModelSpec:
    """Columns of one model; ``ordinals`` are Low/Medium/High columns read as 0, 1, 2."""

    target: str
    dates: tuple[str, ...]
    categories: tuple[str, ...]
    numbers: tuple[str, ...]
    ordinals: tuple[str, ...] = ()
    classes: bool = False

    @property
    def raw_columns(self) -> list[str]:
        return [*self.categories, *self.dates, *self.numbers, self.target]

    @property
    def numeric_columns(self) -> list[str]:
        parts = [f"{d.split('_')[0]}_{p}" for d in self.dates for p in ("year", "month", "day")]
        return [*self.numbers, *parts]

    @property
    def label(self) -> str:
        return "label" if self.classes else self.target


# Inputs and target of the four models.
PROFIT = ModelSpec(
    "profit", ("planting_date", "sale_date"), ("crop_name", "farm_location"),
    ("area_size", "fertilizer_used", "water_used", "actual_yield", "market_price", "supply_level",
     "humidity", "rainfall", "wind_speed", "demand_level_ord"),
    ordinals=("supply_level",),
)
YIELD = ModelSpec(
    "actual_yield", ("planting_date", "sale_date"), ("crop_name", "farm_location", "region_type"),
    ("area_size", "fertilizer_used", "water_used", "temperature", "humidity", "rainfall", "wind_speed", "pest_indicator"),
)
PRICE = ModelSpec(
    "market_price", ("sale_date",), ("crop_name", "market_location", "sufficiency_status"),
    ("sale_gap_days", "demand_score", "supply_score"),
)
DEMAND = ModelSpec(
    "demand_level", ("sale_date",), ("crop_name", "market_location", "sufficiency_status"),
    ("sale_gap_days", "supply_score", "market_price", "temperature", "humidity", "rainfall", "wind_speed"), classes=True,
)


def _ordinal(column: str) -> str:
    return f"case {column} when 'Low' then 0D when 'Medium' then 1D when 'High' then 2D end"


def prepared(df: DataFrame, spec: ModelSpec, target: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Only the model's columns: ordinals as numbers, dates as year, month and day."""
    have = dict(df.dtypes)
    made = []
    for name in spec.numbers:
        if name == "demand_level_ord" and name not in have:
            made.append(f"{_ordinal('demand_level')} as {name}")
        elif name in spec.ordinals and have[name] == "string":
            made.append(f"{_ordinal(name)} as {name}")
        else:
            made.append(f"cast({name} as double) as {name}")
    for name in spec.dates:
        prefix, day = name.split("_")[0], name if have[name] == "date" else f"try_to_date(cast({name} as string))"
        made += [f"year({day}) as {prefix}_year", f"month({day}) as {prefix}_month", f"day({day}) as {prefix}_day"]
    extra = [c for c in keep if c not in spec.categories]
    return df.selectExpr(*extra, *spec.categories, *made, *([spec.target] if target else []))


def hash_split(
    df: DataFrame, keys: Sequence[str], train_pct: int = 80, bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """80/20 split by a hash of the key (or a ``bucket`` of 0 to 99): the same rows however the table is partitioned."""
    if bucket is None:
        bucket = F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(100))
    return df.where(bucket < train_pct), df.where(bucket >= train_pct)


def random_split(df: DataFrame, train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([train, 1 - train], seed=SEED)
    return first, second


def feature_stages(spec: ModelSpec) -> list:
    """Index and encode categories (unseen ones become a zero vector), then assemble."""
    index = [f"{c}_idx" for c in spec.categories]
    encoded = [f"{c}_ohe" for c in spec.categories]
    stages = [
        StringIndexer(inputCols=list(spec.categories), outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=encoded),
        VectorAssembler(inputCols=[*spec.numeric_columns, *encoded], outputCol="features", handleInvalid="keep"),
    ]
    if spec.classes:
        stages.insert(0, StringIndexer(inputCol=spec.target, outputCol="label", handleInvalid="error"))
    return stages


def pipeline(spec: ModelSpec, estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[*feature_stages(spec), estimator])


def fitted(estimator: Pipeline, train: DataFrame) -> PipelineModel:
    """The fitted pipeline, without the summaries of its training.

    The summary of a classifier of two classes holds the session, which no task can carry once that has observed
    anything; models that are saved and loaded have none.
    """
    *before, last = estimator.getStages()
    with _encoded(estimator.copy().setStages(before), train, [last]) as (encoder, rows):
        return _reloaded(PipelineModel([*encoder.stages, _fit(last, rows)]), rows.sparkSession)


def fitted_all(spec: ModelSpec, estimators: Mapping[str, Estimator], train: DataFrame) -> tuple[PipelineModel, dict[str, PipelineModel]]:
    """The fitted feature stages, and every estimator fitted on the rows that they encoded once; for encoded rows."""
    with _encoded(Pipeline(stages=feature_stages(spec)), train, estimators.values()) as (encoder, rows):
        return encoder, {name: _reloaded(PipelineModel([_fit(e, rows)]), rows.sparkSession) for name, e in estimators.items()}


@contextmanager
def _encoded(features: Pipeline, train: DataFrame, estimators: Iterable[Estimator]) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """The fitted feature stages and the rows they encode, on the executors' disks within the block.

    Encoding costs more than reading back, and a fit goes over its rows two to four times. Trees, boosting and iterations
    keep their rows as objects, several times their size on disk, so a task takes at most about ``TASK_ROWS`` of them.
    """
    read = ("featuresCol", "labelCol", "weightCol")
    columns = dict.fromkeys(e.getOrDefault(p) for e in estimators for p in read if e.hasParam(p) and e.isDefined(p))
    with read_by(train.sparkSession, -(-train.count() // TASK_ROWS)):
        encoder = features.fit(train)
        rows = encoder.transform(train).select(*columns).persist(StorageLevel.DISK_ONLY)
        try:
            yield encoder, rows
        finally:
            rows.unpersist()


def _fit(estimator: Estimator, rows: DataFrame) -> Model:
    """Fitted on encoded rows; factorization machines on blocks of them."""
    return fitted_machine(estimator, rows) if isinstance(estimator, rg.FMRegressor) else estimator.fit(rows)


def _reloaded(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    path = scratch_path(spark, "model")
    save_model(model, path)
    return load_model(path)


def regressors(label: str, features: str = "features") -> dict[str, Estimator]:
    cols = {"featuresCol": features, "labelCol": label}
    return {
        "Linear Regression": rg.LinearRegression(**cols),
        "Decision Tree": rg.DecisionTreeRegressor(seed=SEED, **cols),
        "Random Forest": rg.RandomForestRegressor(seed=SEED, **cols),
        "GBT": rg.GBTRegressor(seed=SEED, **cols),
        "Gaussian GLM": rg.GeneralizedLinearRegression(family="gaussian", link="identity", **cols),
        "Factorization Machine": rg.FMRegressor(seed=SEED, **cols),
    }


def classifiers(label: str = "label", features: str = "features") -> dict[str, Estimator]:
    cols = {"featuresCol": features, "labelCol": label}
    return {
        "Logistic Regression": cl.LogisticRegression(maxIter=100, **cols),
        "Decision Tree": cl.DecisionTreeClassifier(seed=SEED, **cols),
        "Random Forest": cl.RandomForestClassifier(seed=SEED, **cols),
        "Naive Bayes": cl.NaiveBayes(**cols),
        "OneVsRest": cl.OneVsRest(classifier=cl.LogisticRegression(**cols), **cols),
    }


# Tuning grids by estimator class.
GRIDS: dict[str, dict[str, list]] = {
    "LinearRegression": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "LogisticRegression": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "DecisionTreeRegressor": {"maxDepth": [5, 10, 15], "maxBins": [32, 64]},
    "DecisionTreeClassifier": {"maxDepth": [5, 10, 15], "maxBins": [32, 64]},
    "RandomForestRegressor": {"numTrees": [50, 100], "maxDepth": [5, 10], "maxBins": [32, 64]},
    "RandomForestClassifier": {"numTrees": [50, 100], "maxDepth": [5, 10], "maxBins": [32, 64]},
    "GBTRegressor": {"maxDepth": [3, 5, 7], "maxIter": [20, 50], "stepSize": [0.05, 0.1]},
    "GeneralizedLinearRegression": {"regParam": [0.0, 0.01, 0.1]},
    "FMRegressor": {"stepSize": [0.01, 0.05], "maxIter": [50, 100], "factorSize": [8, 16]},
    "NaiveBayes": {"smoothing": [0.5, 1.0, 1.5]},
}


def param_grid(estimator: Estimator, grid: Mapping[str, Sequence] | None = None) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in (grid or GRIDS[type(estimator).__name__]).items():
        builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


# --- metrics as aggregates ------------------------------------------------------------


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """r2, rmse and mae in one pass."""
    error = f"({label} - {prediction})"
    return df.where(f"{label} is not null and {prediction} is not null").selectExpr(
        f"1 - try_divide(sum({error} * {error}), var_pop({label}) * count(1)) as r2",
        f"sqrt(avg({error} * {error})) as rmse",
        f"avg(abs({error})) as mae",
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and weighted f1, precision, recall from the confusion counts."""
    return _class_metrics(confusion(df, label, prediction), [])


def _class_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys`` from counts ``n`` per label and prediction; the windows hold one row per pair of classes."""
    within = ", ".join([*keys, ""])
    counts = cells.selectExpr(
        "*",
        f"sum(n) over (partition by {within}label) as support",
        f"sum(n) over (partition by {within}prediction) as predicted",
        "label = prediction as hit",
    )
    measures = {
        "accuracy": "sum(if(hit, n, 0)) / sum(n)",
        "f1": "sum(if(hit, support * (2 * (n / predicted) * (n / support) / (n / predicted + n / support)), 0D)) / sum(n)",
        "weighted_precision": "sum(if(hit, support * (n / predicted), 0D)) / sum(n)",
        "weighted_recall": "sum(if(hit, support * (n / support), 0D)) / sum(n)",
    }
    return counts.groupBy(*keys).agg(*[F.expr(value).alias(name) for name, value in measures.items()])


def measured_on(model: PipelineModel, spec: ModelSpec, df: DataFrame) -> dict[str, float]:
    scored = model.transform(df)
    found = classification_metrics(scored) if spec.classes else regression_metrics(scored, spec.target)
    return found.first().asDict()


def train_and_evaluate(
    name: str, estimator: Estimator, spec: ModelSpec, train: DataFrame, test: DataFrame
) -> tuple[PipelineModel, dict]:
    model = fitted(pipeline(spec, estimator), train)
    return model, {"model": name, **measured_on(model, spec, test)}


def evaluated(models: Mapping[str, PipelineModel], spec: ModelSpec, df: DataFrame) -> DataFrame:
    """Metrics of every model, one row each, from one scan of the rows.

    The models' predictions are columns of one row. Regression metrics are one wide aggregate; classes are
    counted per model, label and prediction. Models of encoded rows (``fitted_all``) take those.
    """
    scored, kept = df, list(df.columns)
    for i, model in enumerate(models.values()):
        added = [F.col("prediction").alias(f"_p{i}")]
        if spec.classes and i == 0:  # every pipeline indexes the target itself, and alike
            added.append(F.col("label").alias("_label"))
        scored = model.transform(scored).select(*kept, *added)
        kept = scored.columns
    names = list(models)
    if spec.classes:
        cells = ", ".join(f"struct({i} as i, _p{i} as prediction)" for i in range(len(names)))
        long = scored.selectExpr("_label as label", f"inline(array({cells}))")
        counts = long.groupBy("i", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        found = _class_metrics(counts, ["i"]).collect()
        values = [{"model": names[r["i"]], **{k: v for k, v in r.asDict().items() if k != "i"}} for r in sorted(found, key=lambda r: r["i"])]
    else:
        wide = []
        for i in range(len(names)):
            there = f"filter (where {spec.target} is not null and _p{i} is not null)"
            error = f"({spec.target} - _p{i})"
            wide += [
                f"1 - try_divide(sum({error} * {error}) {there}, (var_pop({spec.target}) {there}) * (count(1) {there})) as r2_{i}",
                f"sqrt(avg({error} * {error}) {there}) as rmse_{i}", f"avg(abs({error})) {there} as mae_{i}",
            ]
        row = scored.selectExpr(*wide).first()
        values = [{"model": name, **{m: row[f"{m}_{i}"] for m in ("r2", "rmse", "mae")}} for i, name in enumerate(names)]
    metrics = ["accuracy", "f1", "weighted_precision", "weighted_recall"] if spec.classes else ["r2", "rmse", "mae"]
    schema = "model string, " + ", ".join(f"{m} double" for m in metrics)
    return df.sparkSession.createDataFrame([tuple(r[c] for c in ("model", *metrics)) for r in values], schema)


def line_model(spec: ModelSpec, columns: Sequence[str], estimator: Estimator | None = None) -> Pipeline:
    """A pipeline of a few of the model's numeric inputs; linear without an estimator."""
    stages: list = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")]
    if spec.classes:
        stages.insert(0, StringIndexer(inputCol=spec.target, outputCol="label", handleInvalid="error"))
    return Pipeline(stages=[*stages, estimator or rg.LinearRegression(labelCol=spec.label, solver="normal")])


def evaluator(spec: ModelSpec):
    if spec.classes:
        return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    return RegressionEvaluator(labelCol=spec.target, predictionCol="prediction", metricName="r2")


def tune_and_evaluate(
    name: str,
    estimator: Estimator,
    spec: ModelSpec,
    train: DataFrame,
    test: DataFrame,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = FOLDS,
    parallelism: int = 2,
) -> tuple[CrossValidatorModel, dict]:
    """Cross-validated grid search; metrics of the best model on both parts.

    The training rows are read once per parameter set and fold, so they are stored first.
    """
    search = CrossValidator(
        estimator=pipeline(spec, estimator), estimatorParamMaps=param_grid(estimator, grid), evaluator=evaluator(spec),
        numFolds=folds, parallelism=parallelism, seed=SEED,
    )
    kept = cut_lineage(train, TASK_ROWS)
    with read_by(kept.sparkSession, -(-kept.count() // TASK_ROWS)):
        found = search.fit(kept)
    row = {"model": name}
    for part, rows in (("train", kept), ("test", test)):
        row |= {f"{part}_{k}": v for k, v in measured_on(found.bestModel, spec, rows).items()}
    return found, row


def leaderboard(spark: SparkSession, rows: Sequence[Mapping], metric: str) -> DataFrame:
    """Metric rows, best first."""
    return spark.createDataFrame([dict(r) for r in rows]).orderBy(F.desc(metric), "model")


def best_of(board: DataFrame, metric: str) -> DataFrame:
    """Name and value of the best model; the first name wins a tie."""
    return board.agg(F.min_by("model", F.struct(-F.col(metric), F.col("model"))).alias("model"), F.max(metric).alias(metric))


def compared(baseline: DataFrame, tuned: DataFrame, baseline_metric: str, tuned_metric: str) -> DataFrame:
    """Best baseline next to best tuned model."""
    first = best_of(baseline, baseline_metric).select(F.lit("untuned").alias("version"), "model", F.col(baseline_metric).alias("score"))
    second = best_of(tuned, tuned_metric).select(F.lit("tuned").alias("version"), "model", F.col(tuned_metric).alias("score"))
    return first.unionByName(second)


def with_verdict(df: DataFrame, train: str, test: str) -> DataFrame:
    return df.selectExpr(
        "*",
        f"case when {train} - {test} > {GAP_LIMIT}D then 'Overfitting'"
        f" when {test} < {SCORE_LIMIT}D then 'Underfitting' else 'Well-balanced' end as verdict",
    )


def feature_names(scored: DataFrame, column: str = "features") -> list[str]:
    attributes = scored.schema[column].metadata["ml_attr"]["attrs"]
    listed = [a for kind in attributes.values() for a in kind]
    return [a["name"] for a in sorted(listed, key=lambda a: a["idx"])]


def feature_importances(model: PipelineModel, scored: DataFrame, top: int = 20) -> DataFrame:
    """The most important features of a tree model, by name."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(feature_names(scored), weights)]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def bake_off(
    models: Mapping[str, Estimator], categories: Sequence[str], numbers: Sequence[str], target: str, df: DataFrame,
    bucket: Column | None = None,
) -> tuple[str, PipelineModel, DataFrame]:
    """Scaled-feature comparison; keeps the best r2, which must exceed 0. A ``bucket`` of 0 to 99 makes the split repeatable."""
    rows = df.dropna(subset=[*categories, *numbers, target])
    train, test = random_split(rows) if bucket is None else hash_split(rows, [], bucket=bucket)
    index = [f"{c}_index" for c in categories]
    stages = [
        StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, *index], outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled_features", withMean=True, withStd=True),
    ]
    best_name, best_model, best_r2, rows = None, None, 0.0, []
    for name, model in models.items():
        fitted = Pipeline(stages=[*stages, model]).fit(train)
        row = regression_metrics(fitted.transform(test), target).first().asDict()
        rows.append({"model": name, **row})
        if row["r2"] is not None and row["r2"] > best_r2:
            best_name, best_model, best_r2 = name, fitted, row["r2"]
    if best_model is None:
        raise ValueError(f"no model reaches r2 > 0: {rows}")
    return best_name, best_model, leaderboard(df.sparkSession, rows, "r2")


def learned_labels(model: PipelineModel, column: str) -> list[str]:
    """Labels a fitted pipeline knows for an input column."""
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            names = stage.getInputCols() if stage.isSet("inputCols") else [stage.getInputCol()]
            if column in names:
                return list(stage.labelsArray[list(names).index(column)])
    raise KeyError(column)


def readable_predictions(scored: DataFrame, model: PipelineModel, target: str) -> DataFrame:
    """Predicted label as text, from the labels the pipeline learned."""
    labels = learned_labels(model, target)
    return IndexToString(inputCol="prediction", outputCol=f"predicted_{target}", labels=labels).transform(scored)


def unseen_categories(df: DataFrame, model: PipelineModel, spec: ModelSpec) -> DataFrame:
    """Rows per category column whose value the model never saw."""
    counted = []
    for name in spec.categories:
        counted.append(F.count_if(~F.coalesce(F.col(name).isin(learned_labels(model, name)), F.lit(False))).alias(name))
    cells = ", ".join(f"'{c}', {c}" for c in spec.categories)
    return df.agg(*counted).selectExpr(f"stack({len(spec.categories)}, {cells}) as (column_name, unseen)")
