import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.operators import quality
from furrow.schemas import FARM_RECORD

CLEAN = dict(
    record_id=1, crop_name="Tomato", planting_date=dt.date(2024, 3, 1), harvest_date=dt.date(2024, 6, 1), season="Spring", area_size=10.0,
    quantity_sold=27.0, inventory_remaining=3.0, unit_price=2.0, total_sales=54.0, total_expenses=30.0, fertilizer_used=5.0, water_used=100.0,
    actual_yield=30.0, profit=24.0, sale_date=dt.date(2024, 6, 11), sale_gap_days=10, market_location="Amman", farm_location="Irbid",
    region_type="Rural", distance_to_market=50.0, transport_cost=2.0, customer_type="Trader", market_price=2.1, temperature=25.0, humidity=40.0,
    rainfall=10.0, wind_speed=5.0, pest_indicator=False, water_efficiency=0.3, fertilizer_efficiency=6.0, demand_score=0.5, demand_level="Medium",
    supply_score=0.5, supply_level="High", sufficiency_status="Balanced",
)

# rule -> change to the clean record that breaks it
BROKEN = {
    "invalid_crop_name_count": dict(crop_name="Kiwi"),
    "invalid_season_count": dict(season="Autumn"),
    "invalid_market_location_count": dict(market_location=None),
    "invalid_farm_location_count": dict(farm_location="Paris"),
    "invalid_region_type_count": dict(region_type="Suburban"),
    "invalid_customer_type_count": dict(customer_type=None),
    "invalid_demand_level_count": dict(demand_level="Huge"),
    "invalid_supply_level_count": dict(supply_level="None"),
    "invalid_sufficiency_status_count": dict(sufficiency_status="Deficit"),
    "crop_season_mismatch_count": dict(season="Winter"),
    "bad_date_order_count": dict(sale_date=dt.date(2024, 6, 1)),
    "crop_duration_too_short_count": dict(harvest_date=dt.date(2024, 3, 20)),
    "crop_duration_too_long_count": dict(harvest_date=dt.date(2025, 3, 20)),
    "sale_gap_too_short_count": dict(sale_date=dt.date(2024, 6, 1)),
    "sale_gap_too_long_count": dict(sale_date=dt.date(2024, 8, 1)),
    "crop_duration_below_crop_min_count": dict(harvest_date=dt.date(2024, 5, 1)),
    "crop_duration_above_crop_max_count": dict(harvest_date=dt.date(2024, 8, 1)),
    "planting_month_out_of_season_count": dict(planting_date=dt.date(2024, 2, 25)),
    **{f"{c}_negative_count": {c: -1.0} for c in fixed.NON_NEGATIVE_COLUMNS},
    "area_size_too_large_count": dict(area_size=121.0),
    "temperature_out_of_range_count": dict(temperature=51.0),
    "humidity_out_of_range_count": dict(humidity=9.0),
    "rainfall_out_of_range_count": dict(rainfall=151.0),
    "wind_speed_out_of_range_count": dict(wind_speed=36.0),
    "demand_score_out_of_range_count": dict(demand_score=1.1),
    "supply_score_out_of_range_count": dict(supply_score=1.1),
    "quantity_sold_gt_actual_yield_count": dict(quantity_sold=31.0),
    "quantity_sold_equal_zero_count": dict(quantity_sold=0.0),
    "actual_yield_equal_zero_count": dict(actual_yield=0.0),
    "sales_ratio_gt_1_count": dict(quantity_sold=31.0),
    "sales_ratio_lt_0_75_count": dict(quantity_sold=20.0),
    "sales_ratio_gt_0_999_count": dict(quantity_sold=29.99),
    "yield_per_area_too_low_count": dict(actual_yield=9.0),
    "yield_per_area_too_high_count": dict(actual_yield=141.0),
    "yield_per_area_zero_count": dict(actual_yield=0.0),
    "unit_price_non_positive_count": dict(unit_price=0.0),
    "market_price_non_positive_count": dict(market_price=0.0),
    "unit_price_too_low_vs_base_count": dict(unit_price=0.7),
    "unit_price_too_high_vs_base_count": dict(unit_price=4.9),
    "market_price_too_far_from_unit_price_count": dict(market_price=2.4),
    "unit_price_gt_market_price_count": dict(market_price=1.89),
    "profit_formula_mismatch_count": dict(profit=26.0),
    "total_sales_formula_mismatch_count": dict(total_sales=56.0),
    "profit_margin_gt_300pct_count": dict(profit=170.0),
    "profit_margin_lt_minus90pct_count": dict(profit=-50.0),
    "expenses_gt_5x_sales_count": dict(total_expenses=280.0),
    "fertilizer_per_area_too_low_count": dict(fertilizer_used=1.0),
    "fertilizer_per_area_too_high_count": dict(fertilizer_used=11.0),
    "water_per_area_too_low_count": dict(water_used=40.0),
    "water_per_area_too_high_count": dict(water_used=260.0),
    "transport_cost_zero_with_positive_distance_count": dict(transport_cost=0.0),
    "transport_per_km_too_low_count": dict(transport_cost=0.1),
    "transport_per_km_too_high_count": dict(transport_cost=11.0),
    "sufficiency_shortage_rule_violation_count": dict(sufficiency_status="Shortage"),
    "sufficiency_balanced_rule_violation_count": dict(supply_score=0.1),
    "sufficiency_surplus_rule_violation_count": dict(sufficiency_status="Surplus"),
    "sufficiency_total_rule_violation_count": dict(supply_score=0.1),
    "invalid_pest_indicator_type_count": dict(pest_indicator=None),
}


def record(**changes):
    merged = {**CLEAN, **changes}
    return tuple(merged[f.name] for f in FARM_RECORD.fields)


@pytest.fixture(scope="module")
def measured(spark):
    """Rule values of the clean record, and of each broken one by itself."""
    found = {}
    found["clean"] = {r.rule: r.value for r in quality.rule_values(spark.createDataFrame([record()], FARM_RECORD)).collect()}
    broken = spark.createDataFrame([record(record_id=i, **c) for i, c in enumerate(BROKEN.values(), 1)], FARM_RECORD)
    counts = [r for r in quality.RULES if r.name in BROKEN]
    flags = quality.with_shared_values(quality.with_crop_facts(broken), counts).groupBy("record_id").agg(*[F.expr(r.value).alias(r.name) for r in counts])
    names = list(BROKEN)
    for row in flags.collect():
        found[names[row.record_id - 1]] = row.asDict()
    return found


def test_clean_record_breaks_no_rule(measured):
    broken = {rule for rule, value in measured["clean"].items() if rule in BROKEN and value}
    assert broken == set()


@pytest.mark.parametrize("rule", list(BROKEN))
def test_rule_sees_its_violation(measured, rule):
    assert measured[rule][rule] == 1


def test_every_counting_rule_is_tested():
    counting = {r.name for r in quality.RULES if r.value.startswith("count_if")}
    assert counting - set(BROKEN) == {"positive_profit_count", "negative_profit_count", "zero_profit_count"}


def test_report_and_warnings(spark):
    rows = [record(record_id=i, profit=24.0 + i, region_type=r, water_used=w, temperature=t) for i, (r, w, t) in
            enumerate([("Desert", 100.0, 20.0), ("Rural", 200.0, 25.0), ("Desert", 90.0, 20.0), ("Rural", 200.0, 25.0)])]
    df = spark.createDataFrame([*rows, rows[0]], FARM_RECORD)
    values = quality.report(df)
    found = {r.rule: r.value for r in values.collect()}
    assert (found["row_count"], found["duplicate_rows"], found["record_id_unique"], found["median_profit"]) == (5.0, 1.0, 0.0, 25.0)
    assert (found["desert_water_not_higher_than_rural_flag"], found["desert_not_hotter_than_rural_flag"]) == (1.0, 1.0)
    assert found["missing_required_columns_count"] == 0.0 and found["crop_max_share_pct"] == 100.0
    flags = {r.flag: r.raised for r in quality.warning_flags(values).collect()}
    assert flags["has_duplicate_rows"] and flags["desert_temp_logic_issue"] and not flags["has_missing_values"]
    assert flags["demand_level_order_issue"]  # levels without records cannot be in order


def test_missing_required_columns(spark):
    df = spark.createDataFrame([record()], FARM_RECORD).drop("profit")
    found = {r.rule: r.value for r in quality.required_columns(df).collect()}
    assert found["missing_profit"] == 1.0 and found["missing_required_columns_count"] == 1.0


def test_rules_fit_into_aggregates_that_code_is_generated_for(spark):
    parts = quality._parts(quality.RULES)
    assert [r for part in parts for r in part] == quality.RULES
    sections = [r.section for part in parts for r in {r.section: r for r in part}.values()]
    assert len(sections) == len(set(sections))
    rows = spark.createDataFrame([record()], FARM_RECORD)
    found = quality.rule_values(rows)
    assert found.count() == len(quality.RULES) + len(quality.ORDER_FLAGS)
    # each rule takes two buffers at most; from 100 fields on no code is generated
    assert max(2 * len(part) for part in parts) < 100
