"""Small fixed tables as DataFrames (local relations: Catalyst knows their size)."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from furrow import fixed_values as fixed


def crops(spark: SparkSession) -> DataFrame:
    names = ["crop_no", "crop_name", "crop_category", "crop_season", "yield_lo", "yield_hi", "base_price", "days_lo", "days_hi"]
    return _local(spark, names, fixed.crop_rows())


def places(spark: SparkSession) -> DataFrame:
    return _local(spark, ["governorate", "farm_location", "region_type", "lat", "lon"], fixed.place_rows())


def price_regions(spark: SparkSession, lower: bool = False) -> DataFrame:
    return mapping(spark, fixed.PRICE_REGIONS, "location", "price_region", lower)


def mapping(spark: SparkSession, pairs: Mapping[str, str], key: str, value: str, lower: bool = False) -> DataFrame:
    rows = [(k.lower(), v.lower()) if lower else (k, v) for k, v in pairs.items()]
    return _local(spark, [key, value], rows)


def _local(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}))
