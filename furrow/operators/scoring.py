"""Prediction jobs: enriched requests through fitted pipelines, whole tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.functions.scalars import money_text, yield_text
from furrow.operators import enrich
from furrow.operators.allocation import allocate, allocate_resources
from furrow.operators.joins import lookup_join
from furrow.operators.ml import DEMAND, PRICE, PROFIT, YIELD, ModelSpec, prepared, readable_predictions
from furrow.session import cut_lineage


@dataclass(frozen=True)
class Context:
    """Tables that requests are joined with.

    ``balance``: supply and demand per crop; ``baselines``: averages per crop, which
    also hold the mean demand score; ``weather``: observations per governorate.
    """

    baselines: DataFrame
    balance: DataFrame
    weather: DataFrame
    as_of: str

    def stored(self) -> Context:
        """The same with its tables computed once, for many batches of requests."""
        values = list(fixed.WEATHER_DEFAULTS)
        newest = F.max_by(F.struct("observed_at", *values), F.struct("observed_at", *values)).alias("w")
        weather = self.weather.groupBy("governorate").agg(newest).select("governorate", "w.*")
        return Context(cut_lineage(self.baselines), cut_lineage(self.balance), cut_lineage(weather), self.as_of)


def predicted(df: DataFrame, model: PipelineModel, spec: ModelSpec, name: str) -> DataFrame:
    """Prediction next to the input columns, which travel through the pipeline unjoined."""
    inputs, columns = _beside(df, df.columns, spec)
    return model.transform(inputs).select(*columns, F.col("prediction").alias(name))


def _beside(df: DataFrame, kept: list[str], spec: ModelSpec) -> tuple[DataFrame, list[Column]]:
    """The model's inputs with copies of the ``kept`` columns, and those copies by their old names.

    Columns and no struct: those that nothing reads later are not carried along.
    """
    copies = {f"_in_{i}": F.col(f"`{c}`") for i, c in enumerate(kept)}
    inputs = prepared(df.withColumns(copies), spec, target=False, keep=list(copies))
    return inputs, [F.col(copy).alias(c) for copy, c in zip(copies, kept)]


def enriched(requests: DataFrame, context: Context, hectares: str | None = None, filled_supply: bool = False) -> DataFrame:
    """Place, weather, balance, baselines and resources of farm requests.

    ``filled_supply``: demand pressure from the supply after its fallback to the crop's
    average, as for allocations; else from the supply as it was found.
    """
    placed = enrich.with_weather(enrich.with_place(requests), context.weather)
    known = enrich.with_baselines(enrich.with_balance(placed, context.balance), context.baselines)
    if filled_supply:
        known = known.withColumns(enrich.balance_columns())
    sized = enrich.with_area(known, hectares)
    level = f"case when base_supply < {fixed.SUPPLY_CUTS[0]}D then 0D when base_supply >= {fixed.SUPPLY_CUTS[1]}D then 2D else 1D end"
    return sized.selectExpr("*", f"{level} as supply_level")


def score_table(df: DataFrame, model: PipelineModel, spec: ModelSpec, key: str = "record_id") -> DataFrame:
    """Batch predictions for a whole table of records."""
    rows = prepared(df, spec, target=False, keep=[key])
    return for_scoring(model, spec).transform(rows).select(key, "prediction")


def score_yield(requests: DataFrame, context: Context, model: PipelineModel) -> DataFrame:
    farm = enriched(requests, context)
    if "pest_indicator" not in requests.columns:
        farm = farm.withColumn("pest_indicator", F.lit(False))
    scored = predicted(farm, model, YIELD, "predicted_yield")
    return scored.withColumn("value", yield_text(F.col("predicted_yield")))


def score_profit(requests: DataFrame, context: Context, profit: PipelineModel, yields: PipelineModel) -> DataFrame:
    """Predicted yield feeds the profit model; baseline yield where there is none."""
    farm = enriched(requests, context).withColumn("pest_indicator", F.lit(False))
    grown = predicted(farm, yields, YIELD, "_yield").selectExpr(
        "* except (_yield)", "coalesce(if(isnan(_yield), null, _yield), base_yield_per_ha * area_size) as actual_yield"
    )
    scored = predicted(grown, profit, PROFIT, "predicted_profit")
    return scored.withColumn("value", money_text(F.col("predicted_profit")))


def market_context(requests: DataFrame, context: Context) -> DataFrame:
    """Inputs of the demand and price models, with the categories they were trained on."""
    known = enrich.with_baselines(enrich.with_balance(requests, context.balance), context.baselines)
    gap = enrich.with_sale_gap(known, context.as_of)
    status = "if(sufficiency_status = 'Deficit', 'Shortage', sufficiency_status)"
    return gap.selectExpr(
        "* except (sufficiency_status)", f"{status} as sufficiency_status",
        "base_supply as supply_score", "base_demand as demand_score",
    )


def score_demand(requests: DataFrame, context: Context, model: PipelineModel) -> DataFrame:
    inputs = enrich.with_weather(market_context(requests, context), context.weather)
    rows, columns = _beside(inputs, requests.columns, DEMAND)
    scored = readable_predictions(for_scoring(model, DEMAND).transform(rows), model, DEMAND.target)
    return scored.select(*columns, "prediction", F.col("predicted_demand_level").alias("value"))


def for_scoring(model: PipelineModel, spec: ModelSpec) -> PipelineModel:
    """The pipeline without the stage that indexes the target, absent from requests."""
    stages = [s for s in model.stages if not (isinstance(s, StringIndexerModel) and spec.target in _inputs(s))]
    return PipelineModel(stages)


def _inputs(stage: StringIndexerModel) -> list[str]:
    return list(stage.getInputCols()) if stage.isSet("inputCols") else [stage.getInputCol()]


def score_price(requests: DataFrame, context: Context, model: PipelineModel) -> DataFrame:
    scored = predicted(market_context(requests, context), model, PRICE, "predicted_price")
    return scored.withColumn("value", money_text(F.col("predicted_price")))


def candidate_profits(requests: DataFrame, context: Context, profit: PipelineModel) -> DataFrame:
    """Profit per hectare of every candidate crop of every request.

    Negative predictions count as 0; a request whose crops all have 0 takes the crops'
    prices instead. The best profit of a request is an aggregate and a lookup, not a window.
    """
    crops = enriched(enrich.candidate_crops(requests), context, hectares="1D", filled_supply=True)
    inputs = crops.withColumn("actual_yield", F.col("base_yield_per_ha"))
    scored = predicted(inputs, profit, PROFIT, "_profit").selectExpr(
        "request_id", "position", "crop_name", "area_donums", "market_price", "greatest(_profit, 0D) as _profit"
    )
    rows = cut_lineage(scored)
    best = rows.groupBy("request_id").agg(F.max("_profit").alias("_best"))
    known = lookup_join(rows, best, ["request_id"], null_safe=True)
    return known.selectExpr("* except (_profit, _best)", "if(_best = 0D, market_price, _profit) as profit")


def allocate_requests(
    requests: DataFrame, context: Context, profit: PipelineModel, min_share: float = fixed.MIN_SHARE, max_share: float = fixed.MAX_SHARE,
    places: int | None = 2,
) -> DataFrame:
    """Requests with crop lists to area splits, one job for all of them."""
    candidates = candidate_profits(requests, context, profit).selectExpr(
        "request_id as farm", "crop_name as crop", "position", f"area_donums * {fixed.HECTARES_PER_DONUM}D as area", "profit"
    )
    return allocate(candidates, min_share, max_share, places).selectExpr(
        "farm as request_id", "position", "crop as crop_name", "area as area_hectares", "profit as profit_per_hectare",
        "allocation", "status", "coalesce(total_profit, 0D) as expected_total_profit",
    )


def plan_requests(
    requests: DataFrame, context: Context, profit: PipelineModel, medians: DataFrame, water: str = "area * 7D", fertilizer: str = "area * 6.5D"
) -> DataFrame:
    """Requests with crop lists to splits under limits: candidate profits meet the medians of their crops.

    ``medians`` has crop_name, water_per_area and fert_per_area; ``water`` and ``fertilizer`` are the limits as
    expressions of the farm's ``area``. Amounts, prices and status are those of ``allocate_resources``.
    """
    candidates = candidate_profits(requests, context, profit).selectExpr(
        "request_id as farm", "crop_name as crop", f"area_donums * {fixed.HECTARES_PER_DONUM}D as area", "profit"
    )
    known = enrich.with_coefficients(candidates, medians)
    return allocate_resources(known.selectExpr("*", f"{water} as water_limit", f"{fertilizer} as fertilizer_limit"))
