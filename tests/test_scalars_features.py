import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.functions import scalars as s
from furrow.operators import features, stats
from furrow.operators.checks import cast_columns, drop_columns, drop_null_rows, missing_columns, nan_to_null, to_schema
from furrow.schemas import FARM_RECORD, SEASON_SALES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, number", [("1,234.5", 1234.5), ("n/a", 0.0), (None, 0.0), ("7", 7.0), ("NaN", 0.0), ("", 0.0)])
def test_number_or_zero(spark, text, number):
    assert one(spark, s.number_or_zero(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize("label, kind", [(" Area Harvested", "area"), ("Production (t)", "production"), ("Other ", "other"), (None, "nan")])
def test_kinds(spark, label, kind):
    assert one(spark, s.canonical_kind(s.normal_text(F.lit(label).cast("string")))) == kind


@pytest.mark.parametrize(
    "supply, demand, pressure, status",
    [(1.0, 0.0, 0, "Balanced"), (1.2, 1.0, 1, "Balanced"), (0.8, 1.0, 1, "Balanced"), (1.3, 1.0, 0, "Surplus"), (0.7, 1.0, 2, "Deficit"), (0.0, 5.0, 2, "Deficit")])
def test_balance(spark, supply, demand, pressure, status):
    a, b = F.lit(supply), F.lit(demand)
    assert one(spark, s.demand_pressure(a, b)) == pressure
    assert one(spark, s.sufficiency_by_balance(a, b)) == status


@pytest.mark.parametrize("supply, demand, status", [(0.1, 0.9, "Shortage"), (0.5, 0.5, "Balanced"), (0.9, 0.1, "Surplus"), (0.0, 0.0, "Shortage")])
def test_sufficiency_by_score(spark, supply, demand, status):
    assert one(spark, s.sufficiency_by_score(F.lit(supply), F.lit(demand))) == status


def test_list_parts_are_trimmed(spark):
    assert one(spark, s.split_list(F.lit("Tomato , Wheat,  Bell Pepper "))) == ["Tomato", "Wheat", "Bell Pepper"]


def test_small_functions(spark):
    assert one(spark, s.sale_gap(F.lit("2024-01-05").cast("date"), F.lit("2024-02-01").cast("date"))) == 0
    assert one(spark, s.hectares(F.lit(25.0))) == 2.5
    assert one(spark, s.fallback(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0))) == 3.0
    assert one(spark, s.money_text(F.lit(12.345))) == "$12.34"
    assert one(spark, s.yield_text(F.lit(1.5))) == "1.5 Tons/Units"
    assert one(spark, s.label_text(F.lit(1.0), ["High", "Low"])) == "Low"
    assert one(spark, s.never_negative(F.lit(-2.0))) == 0.0
    assert one(spark, s.in_set(F.lit(None).cast("string"), ["a"])) is False
    assert one(spark, s.clipped(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, s.per_hectare(F.lit(None).cast("double"), F.lit(2.0))) == 0.0


def test_date_parts_of_bad_dates(spark):
    df = spark.createDataFrame([("2024-03-09",), ("soon",), (None,)], "sale_date string")
    assert rows(s.date_parts(df, "sale_date").select("sale_year", "sale_month", "sale_day")) == [(None, None, None), (None, None, None), (2024, 3, 9)]


def test_levels(spark):
    for score, level in ((0.35, "Low"), (0.36, "Medium"), (0.64, "High")):
        assert one(spark, s.level_from_score(F.lit(score), fixed.DEMAND_CUTS)) == level
    assert [one(spark, s.level_ordinal(F.lit(x))) for x in ("Low", "Medium", "High", "?")] == [0, 1, 2, None]


def test_table_checks(spark):
    df = spark.createDataFrame([(1, "2.5", float("nan")), (2, "x", 1.0)], "record_id long, b string, c double")
    assert missing_columns(df, ["b", "z"]) == ["z"]
    assert rows(cast_columns(df, {"b": "double"}).select("b")) == [(None,), (2.5,)]
    assert rows(nan_to_null(df).select("c")) == [(None,), (1.0,)]
    assert drop_null_rows(nan_to_null(df)).count() == 1
    assert drop_columns(df, ["b"]).columns == ["record_id", "c"]
    shaped = to_schema(df, SEASON_SALES)
    assert shaped.columns == SEASON_SALES.fieldNames() and shaped.first().profit is None
    assert len(FARM_RECORD.fieldNames()) == 36 and len(fixed.crop_rows()) == 35


def test_factors(spark):
    lit = F.lit
    assert one(spark, features.pest_probability(lit(70.0), lit(30.0), lit(40.0))) == pytest.approx(0.14)
    assert one(spark, features.composed_price(lit(4.5), lit("Amman"), lit("Export"), lit(1.1))) == 6.5
    assert one(spark, features.composed_yield(lit(10.0), lit(38.0), lit(25.0), lit(0.8))) == pytest.approx(10 * 0.85 * 0.92 * 0.8)
    assert one(spark, features.water_need(lit(2.0), lit(10.0), lit("Rural"))) == 18.0
    assert one(spark, features.in_planting_month(lit("Winter"), lit("2024-01-05").cast("date"))) is True
    assert one(spark, features.in_planting_month(lit(None).cast("string"), lit("2024-01-05").cast("date"))) is False
    harvest, sale = features.harvest_and_sale(lit("2024-01-01").cast("date"), lit(10), lit(5))
    assert (one(spark, harvest), one(spark, sale)) == (dt.date(2024, 1, 11), dt.date(2024, 1, 16))


def test_scores_span_the_unit_interval(spark, data):
    from furrow.plans.catalog import AREA_INPUTS, CLIMATE, DEMAND_INPUTS
    from furrow.plans.farm_view import farm_records

    demand = features.with_demand_score(farm_records(spark, data, DEMAND_INPUTS)).selectExpr("min(demand_score)", "max(demand_score)").first()
    supply = features.with_supply_score(farm_records(spark, data, [*AREA_INPUTS, *CLIMATE])).selectExpr("min(supply_score)", "max(supply_score)").first()
    for low, high in (demand, supply):
        assert low == 0.0 and high == pytest.approx(1.0, abs=1e-4)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (2, "b", 5.0), (5, None, 7.0), (5, None, 7.0)], "record_id long, k string, x double")
    gaps = stats.id_gaps(df).first()
    assert (gaps.is_unique, gaps.duplicates, gaps.lowest, gaps.highest, gaps.missing_in_range) == (False, 2, 1, 5, 2)
    assert rows(stats.missing_ids(df)) == [(3,), (4,)]
    shape = stats.table_shape(df).first()
    assert (shape.row_count, shape.column_count, shape.missing_values_total, shape.duplicate_rows) == (5, 3, 3, 1)
    assert rows(stats.category_shares(df, "k")) == [("a", 2, pytest.approx(200 / 3)), ("b", 1, pytest.approx(100 / 3))]
    assert rows(stats.group_sums(df, "k", ["x"])) == [("a", 1.0), ("b", 5.0)]
    assert tuple(stats.group_extremes(df, "k", "x").first()) == ("a", 1.0, "b", 5.0)
    assert rows(stats.distinct_counts(df, ["k", "x"])) == [("k", 2), ("x", 3)]
    assert rows(stats.outside_domain(df, {"k": ["a"]})) == [("k", 3)]
    assert rows(stats.with_group_mean(df, "k", "x", "m").select("k", "m").distinct()) == [(None, None), ("a", 1.0), ("b", 5.0)]
    assert [r.x for r in stats.top_rows(df.where("x is not null"), [F.desc("x")], 2).collect()] == [7.0, 7.0]


def test_first_key_wins_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "k string, x double")
    found = stats.group_extremes(df, "k", "x").first()
    assert (found.lowest, found.highest) == ("a", "a")


def test_baselines_and_latest(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 10.0, 5.0, 5.0, 0.0, 0.5), ("a", 4.0, 10.0, 0.0, 5.0, 5.0, None)],
        "crop_name string, market_price double, actual_yield double, area_size double, water_used double, fertilizer_used double, supply_score double")
    assert rows(stats.crop_baselines(df)) == [("a", 3.0, 2.0, 0.0, 1.0, 0.5)]
    dated = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-02-01", 1.0), (1, "2024-02-01", 9.0)], "k int, d string, v double")
    assert rows(stats.latest_per_key(dated, "k", ["d", "v"], "v")) == [(1, 9.0)]
