"""Agronomic factors, demand and supply scores, levels and sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.functions import scalars as s
from furrow.operators.stats import with_group_mean, with_max_ratio, with_min_max
from furrow.sources import lookups

EPS = fixed.EPS


def with_crop_facts(df: DataFrame) -> DataFrame:
    """Category, season, yield range, base price and growing time of known crops."""
    return df.join(F.broadcast(lookups.crops(df.sparkSession)), "crop_name", "left")


def planting_months(season: Column) -> Column:
    """Array of months in which crops of a season are planted."""
    result = None
    for name, months in fixed.SEASON_PLANTING_MONTHS.items():
        listed = F.array(*[F.lit(m) for m in months])
        result = F.when(season == name, listed) if result is None else result.when(season == name, listed)
    return result


def in_planting_month(season: Column, planting: Column) -> Column:
    return F.coalesce(F.array_contains(planting_months(season), F.month(planting)), F.lit(False))


def harvest_and_sale(planting: Column, duration: Column, gap: Column) -> tuple[Column, Column]:
    harvest = F.date_add(planting, duration.cast("int"))
    return harvest, F.date_add(harvest, gap.cast("int"))


def yield_factor(region: Column) -> Column:
    return s.weighted(region, fixed.REGION_YIELD)


def water_factor(region: Column) -> Column:
    return s.weighted(region, fixed.REGION_WATER, fixed.REGION_WATER_OTHER)


def heat_stress(temperature: Column) -> Column:
    return F.when(temperature > 37, 0.85).otherwise(1.0)


def wind_stress(wind: Column) -> Column:
    return F.when(wind > 22, 0.92).otherwise(1.0)


def rain_bonus(rain: Column) -> Column:
    return F.when((rain >= 8) & (rain <= 25), 1.08).otherwise(1.0)


def pest_probability(humidity: Column, rain: Column, temperature: Column) -> Column:
    raised = (
        F.lit(0.02)
        + F.when(humidity > 60, 0.05).otherwise(0.0)
        + F.when(rain > 25, 0.04).otherwise(0.0)
        + F.when(temperature > 34, 0.03).otherwise(0.0)
    )
    return s.clipped(raised, 0.02, 0.20)


def potential_yield(area: Column, rate: Column, region: Column, rain: Column) -> Column:
    return area * rate * yield_factor(region) * rain_bonus(rain)


def composed_yield(potential: Column, temperature: Column, wind: Column, pest_loss: Column) -> Column:
    return s.at_least(potential * heat_stress(temperature) * wind_stress(wind) * pest_loss, 0.05)


def water_need(area: Column, rate: Column, region: Column) -> Column:
    return area * rate * water_factor(region)


def inventory_left(produced: Column, sold: Column) -> Column:
    return s.at_least(produced - sold, 0.0)


def sales_ratio(produced: Column, sold: Column) -> Column:
    return s.clipped(sold / s.at_least(produced, EPS), 0.0, 1.0)


def composed_price(base: Column, market: Column, customer: Column, noise: Column) -> Column:
    price = (
        base
        * s.weighted(market, fixed.MARKET_PRICE_FACTOR)
        * s.weighted(customer, fixed.CUSTOMER_PRICE_FACTOR)
        * noise
        * fixed.PRICE_SCALE
    )
    return F.when(price > fixed.PRICE_CAP, fixed.PRICE_CAP).otherwise(price)


def total_expenses(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def sale_speed(gap: Column) -> Column:
    return 1 - s.clipped((gap - 1) / 30, 0.0, 1.0)


def inventory_pressure(left: Column, produced: Column) -> Column:
    return 1 - s.clipped(left / s.at_least(produced, EPS), 0.0, 1.0)


def with_relative_price(df: DataFrame) -> DataFrame:
    """Price over the mean price of the crop (a mean of 0 counts as 1)."""
    mean = F.when(F.col("_crop_price") == 0, 1.0).otherwise(F.col("_crop_price"))
    priced = with_group_mean(df, "crop_name", "market_price", "_crop_price")
    return priced.withColumn("relative_price_index", F.col("market_price") / mean).drop("_crop_price")


def with_demand_terms(df: DataFrame) -> DataFrame:
    """The seven inputs of the demand score."""
    season = F.col("crop_season")
    terms = {
        "sales_ratio": sales_ratio(F.col("actual_yield"), F.col("quantity_sold")),
        "sale_speed_score": sale_speed(F.col("sale_gap_days")),
        "inventory_pressure": inventory_pressure(F.col("inventory_remaining"), F.col("actual_yield")),
        "customer_weight": s.weighted(F.col("customer_type"), fixed.CUSTOMER_DEMAND),
        "market_weight": s.weighted(F.col("market_location"), fixed.MARKET_DEMAND),
        "season_weight": s.weighted(season, fixed.SEASON_DEMAND),
    }
    facts = lookups.crops(df.sparkSession).select("crop_name", "crop_season")
    seasoned = df.join(F.broadcast(facts), "crop_name", "left")
    return with_relative_price(seasoned).withColumns(terms)


def with_demand_score(df: DataFrame) -> DataFrame:
    """Weighted terms scaled over the whole table, and the level they reach."""
    raw = _weighted_sum(fixed.DEMAND_WEIGHTS)
    scored = with_min_max(with_demand_terms(df).withColumn("_raw", raw), {"_raw": "demand_score"})
    level = s.level_from_score(F.col("demand_score"), fixed.DEMAND_CUTS)
    return scored.withColumn("demand_level", level).drop("_raw")


def with_efficiency_ratios(df: DataFrame) -> DataFrame:
    """Yield per area, water and fertilizer, denominators at least 1e-6."""
    return df.withColumns(
        {
            "yield_per_area": F.col("actual_yield") / s.at_least(F.col("area_size"), EPS),
            "water_efficiency": F.col("actual_yield") / s.at_least(F.col("water_used"), EPS),
            "fertilizer_efficiency": F.col("actual_yield") / s.at_least(F.col("fertilizer_used"), EPS),
        }
    )


def climate_penalty() -> Column:
    """How many of heat, wind, rain and pests are present."""
    flags = [F.col("temperature") > 37, F.col("wind_speed") > 22, F.col("rainfall") > 25, F.col("pest_indicator")]
    return total_expenses(*[f.cast("int") for f in flags])


def with_supply_score(df: DataFrame) -> DataFrame:
    """Scaled efficiency, size and climate terms, scaled again; and the level."""
    penalised = with_max_ratio(with_efficiency_ratios(df).withColumn("climate_penalty", climate_penalty()), "climate_penalty", "_penalty")
    scaled_names = ["yield_per_area", "area_size", "water_efficiency", "fertilizer_efficiency", "actual_yield"]
    scaled = with_min_max(penalised, {c: f"_{c}" for c in scaled_names}).withColumn("_climate_ease", 1 - F.col("_penalty"))
    raw = _weighted_sum({f"_{c}": w for c, w in fixed.SUPPLY_WEIGHTS.items()})
    scored = with_min_max(scaled.withColumn("_raw", raw), {"_raw": "supply_score"})
    level = s.level_from_score(F.col("supply_score"), fixed.SUPPLY_CUTS)
    helpers = [c for c in scored.columns if c.startswith("_")]
    return scored.withColumn("supply_level", level).drop(*helpers)


def with_sufficiency(df: DataFrame) -> DataFrame:
    status = s.sufficiency_by_score(F.col("supply_score"), F.col("demand_score"))
    return df.withColumn("sufficiency_status", status)


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Presentation rounding, ties to even."""
    return df.withColumns({c: F.bround(c, n) for c, n in places.items()})


def _weighted_sum(weights: dict[str, float]) -> Column:
    return total_expenses(*[F.col(c) * w for c, w in weights.items()])
