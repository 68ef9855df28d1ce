"""Requests joined with places, weather, supply, demand and crop baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.functions.scalars import demand_pressure, fallback, per_hectare, split_list, sufficiency_by_balance
from furrow.functions.scalars import hectares as in_hectares
from furrow.operators.joins import lookup_join
from furrow.operators.stats import latest_per_key
from furrow.sources import lookups


def validated(df: DataFrame) -> DataFrame:
    """Add ``reasons`` (why a request is rejected) and ``warnings``; rules without a column are skipped."""
    checks = [f"if({test}, '{reason}', null)" for test, reason in _rules(df)]
    options = ", ".join(f"'{m}'" for m in fixed.MARKET_OPTIONS)
    warning = f"if(not market_location in ({options}), 'unlisted market', null)" if "market_location" in df.columns else "null"
    return df.selectExpr(
        "*",
        f"array_compact(array({', '.join(checks)})) as reasons",
        f"array_compact(array(cast({warning} as string))) as warnings",
    )


def valid(df: DataFrame) -> DataFrame:
    """The same rows as ``accepted(validated(df))``; every rule can be checked before the joins that it does not need."""
    for test, _ in _rules(df):
        df = df.where(f"not coalesce({test}, false)")
    return df


def _rules(df: DataFrame) -> list[tuple[str, str]]:
    """Tests that reject a request, with their reasons."""
    have = set(df.columns)
    known = ", ".join("'" + row[0].replace("'", "\\'") + "'" for row in fixed.place_rows())
    day = "try_to_date(cast({} as string))"
    rules = [
        ("crop_name", "coalesce(length(crop_name), 0) not between 1 and 100", "crop_name length"),
        ("area_donums", "not coalesce(area_donums > 0 and not isnan(cast(area_donums as double)), false)", "area not positive"),
        ("governorate", f"not coalesce(governorate in ({known}), false)", "unknown governorate"),
        ("planting_date", f"{day.format('planting_date')} is null", "unreadable planting date"),
        ("sale_date", f"{day.format('sale_date')} is null", "unreadable sale date"),
    ]
    tests = [(test, reason) for column, test, reason in rules if column in have]
    if {"planting_date", "sale_date"} <= have:
        tests.append((f"{day.format('sale_date')} <= {day.format('planting_date')}", "sale not after planting"))
    return tests


def accepted(df: DataFrame) -> DataFrame:
    return df.where("size(reasons) = 0").drop("reasons", "warnings")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("size(reasons) > 0")


def with_place(df: DataFrame, as_trained: bool = True) -> DataFrame:
    """Farm location and region type of the governorate.

    Models are trained on governorate names as farm locations; ``as_trained=False``
    gives the coarse location map instead.
    """
    places = lookups.places(df.sparkSession).select("governorate", "farm_location", "region_type")
    if as_trained:
        places = places.withColumn("farm_location", F.expr("replace(governorate, '\\'', '')"))
    return df.join(F.broadcast(places), "governorate", "left")


def latest_weather(weather: DataFrame) -> DataFrame:
    """Newest observation per governorate."""
    values = list(fixed.WEATHER_DEFAULTS)
    last = F.max_by(F.struct(*values), F.struct("observed_at", *values)).alias("w")
    return weather.groupBy("governorate").agg(last).select("governorate", "w.*")


def with_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    joined = lookup_join(df, latest_weather(weather), ["governorate"])
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fixed.WEATHER_DEFAULTS.items()})


def latest_balance(crops: DataFrame, supply: DataFrame, demand: DataFrame) -> DataFrame:
    """Newest supply and demand per crop name; one aggregate each, for all crops."""
    supplied = latest_per_key(supply, "crop_id", ["supply_date", "total_estimated_tons"], "total_estimated_tons", "supply")
    demanded = latest_per_key(demand, "crop_id", ["demand_date", "demand_tons"], "demand_tons", "demand")
    return (
        crops.selectExpr("id as crop_id", "name_en as crop_name")
        .join(supplied, "crop_id", "left")
        .join(demanded, "crop_id", "left")
        .select("crop_name", "supply", "demand")
    )


def with_crop_table(df: DataFrame, crops: DataFrame) -> DataFrame:
    """``crop_id`` and ``avg_yield_per_donum`` of the crop's name; no id and a yield of 0 for an unknown crop.

    Of several rows of one name the smallest id counts.
    """
    first = F.min_by(F.struct("id", "avg_yield_per_donum"), F.struct("id", "avg_yield_per_donum")).alias("c")
    known = crops.where("name_en is not null").groupBy(F.col("name_en").alias("crop_name")).agg(first)
    joined = lookup_join(df, known.selectExpr("crop_name", "c.id as crop_id", "c.avg_yield_per_donum"), ["crop_name"])
    return joined.withColumn("avg_yield_per_donum", F.coalesce("avg_yield_per_donum", F.lit(0.0)))


def with_coefficients(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Water and fertilizer per area of the crop, from its medians; unknown crops have none."""
    needs = medians.selectExpr("crop_name as crop", "water_per_area", "fert_per_area")
    return lookup_join(df, needs, ["crop"])


def with_balance(df: DataFrame, balance: DataFrame) -> DataFrame:
    """Supply and demand tonnes (0 when unknown), pressure and sufficiency."""
    joined = lookup_join(df, balance, ["crop_name"])
    tonnes = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("supply", "demand")})
    return tonnes.withColumns(balance_columns())


def balance_columns() -> dict[str, Column]:
    """Demand pressure and sufficiency from the columns ``supply`` and ``demand``."""
    supply, demand = F.col("supply"), F.col("demand")
    return {"demand_level_ord": demand_pressure(supply, demand), "sufficiency_status": sufficiency_by_balance(supply, demand)}


def with_baselines(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """Price and per-hectare rates of the crop, with the defaults for unknown crops.

    ``supply`` of 0 falls back to the crop's average when the column is present.
    """
    renamed = baselines.withColumnsRenamed({c: f"base_{c}" for c in baselines.columns if c != "crop_name"})
    joined = lookup_join(df, renamed, ["crop_name"])
    out = {
        "market_price": F.expr(f"coalesce(base_market_price, {fixed.DEFAULT_PRICE}D)"),
        **{c: F.coalesce(c, F.lit(0.0)) for c in renamed.columns if c.startswith("base_") and c != "base_market_price"},
    }
    if "supply" in df.columns:
        out["supply"] = fallback(F.col("supply"), F.col("base_supply"), F.lit(0.0))
    return joined.withColumns(out)


def with_area(df: DataFrame, hectares: str | None = None) -> DataFrame:
    """Hectares of the request and the fertilizer and water the crop needs on them."""
    area = F.expr(hectares) if hectares else in_hectares(F.col("area_donums"))
    sized = df.withColumn("area_size", area)
    needs = {"fertilizer_used": "base_fertilizer_per_ha", "water_used": "base_water_per_ha"}
    return sized.withColumns({name: per_hectare(F.col(rate), F.col("area_size")) for name, rate in needs.items()})


def with_sale_gap(df: DataFrame, as_of: str) -> DataFrame:
    """Days from a given day to the sale, never negative."""
    return df.selectExpr("*", f"greatest(datediff(try_to_date(cast(sale_date as string)), date'{as_of}'), 0) as sale_gap_days")


def candidate_crops(df: DataFrame) -> DataFrame:
    """One row per crop of a comma-separated list, with its position; repeats count once."""
    listed = df.withColumn("_crops", F.array_distinct(split_list(F.col("crops_list"))))
    return listed.select(*df.columns, F.posexplode("_crops").alias("position", "crop_name"))
