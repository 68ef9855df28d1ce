"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


FARM_RECORD = _struct(
    record_id=_L, crop_name=_S, planting_date=T.DateType(), harvest_date=T.DateType(), season=_S,
    area_size=_D, quantity_sold=_D, inventory_remaining=_D, unit_price=_D, total_sales=_D,
    total_expenses=_D, fertilizer_used=_D, water_used=_D, actual_yield=_D, profit=_D,
    sale_date=T.DateType(), sale_gap_days=_I, market_location=_S, farm_location=_S, region_type=_S,
    distance_to_market=_D, transport_cost=_D, customer_type=_S, market_price=_D, temperature=_D,
    humidity=_D, rainfall=_D, wind_speed=_D, pest_indicator=T.BooleanType(), water_efficiency=_D,
    fertilizer_efficiency=_D, demand_score=_D, demand_level=_S, supply_score=_D, supply_level=_S,
    sufficiency_status=_S,
)

MONTHLY_SALES = _struct(
    record_id=_L, crop_name=_S, year=_I, month=_S, farm_location=_S, region_type=_S, area_size=_D,
    actual_yield_tons=_D, quantity_sold_kg=_D, unit_price_jod=_D, total_sales_jod=_D,
)

SEASON_SALES = _struct(
    record_id=_L, crop_name=_S, season=_S, month=_S, planting_date=T.DateType(), harvest_date=T.DateType(),
    farm_location=_S, market_location=_S, region_type=_S, area_size=_D, quantity_sold=_D, unit_price=_D,
    total_sales=_D, expense_type=_S, expense_amount=_D, total_expenses=_D, profit=_D, fertilizer_used=_D,
    water_used=_D, actual_yield=_D, expected_yield=_D, demand_level=_S, customer_type=_S, market_price=_D,
)

FARM_REQUEST = _struct(
    request_id=_L, crop_name=_S, governorate=_S, area_donums=_D, planting_date=_S, sale_date=_S,
    pest_indicator=T.BooleanType(), market_location=_S,
)

ALLOCATION_REQUEST = _struct(
    request_id=_L, area_donums=_D, governorate=_S, planting_date=_S, sale_date=_S, crops_list=_S,
)

CROP_TABLE = _struct(id=_L, name_en=_S, avg_yield_per_donum=_D)
CROP_SUPPLY = _struct(crop_id=_L, supply_date=T.DateType(), total_estimated_tons=_D)
CROP_DEMAND = _struct(crop_id=_L, demand_date=T.DateType(), demand_tons=_D)
WEATHER = _struct(
    governorate=_S, observed_at=T.TimestampType(), temperature=_D, humidity=_D, rainfall=_D, wind_speed=_D,
)
EVENTS = _struct(
    event_id=_L, ts=T.TimestampType(), user_id=_L, event_type=_S, value=_D, props=_S,
)
