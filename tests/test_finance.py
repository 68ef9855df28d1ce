import pytest
from conftest import rows

from furrow.operators import finance
from furrow.operators.checks import require_columns

SCHEMA = "crop_name string, quantity_sold double, unit_price double, total_expenses double, transport_cost double, actual_yield double, water_used double"


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("Wheat", 100.0, 5.0, 300.0, 50.0, 1000.0, 500.0), ("Corn", 200.0, 4.0, 500.0, 100.0, 2500.0, 1000.0),
         ("Wheat", 150.0, 5.0, 400.0, 50.0, 1600.0, 800.0)], SCHEMA)


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_missing_column_is_an_error(sales):
    with pytest.raises(ValueError, match="Missing columns"):
        require_columns(sales, ["non_existent_column"])


def test_revenue(sales):
    assert column(finance.with_revenue(sales), "revenue") == [500.0, 750.0, 800.0]


def test_cost_with_and_without_transport(sales):
    assert column(finance.with_cost(sales), "cost") == [350.0, 450.0, 600.0]
    assert column(finance.with_cost(sales, include_transport=False), "cost") == [300.0, 400.0, 500.0]


def test_profit_and_margin(sales):
    row = finance.finance_metrics(sales).where("quantity_sold = 100").first()
    assert (row.profit_calc, row.profit_margin_pct) == (150.0, 30.0)


def test_all_columns_are_made(sales):
    made = finance.finance_metrics(sales).columns
    assert {"revenue", "cost", "profit_calc", "profit_margin_pct", "water_efficiency"} <= set(made)
    assert "fertilizer_efficiency" not in made


def test_summary(sales):
    wheat = finance.summary_by_crop(finance.finance_metrics(sales)).where("crop_name = 'Wheat'").first()
    assert (wheat.revenue, wheat.cost, wheat.profit_calc, wheat.quantity_sold) == (1250.0, 800.0, 450.0, 250.0)


def test_reported_sales_win_and_zero_revenue_has_no_margin(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 9.0, 1.0, None, 0.0, 4.0), ("b", 1.0, 2.0, None, 1.0, 1.0, 2.0, 4.0), ("c", 0.0, 2.0, None, 1.0, 1.0, 2.0, 4.0)],
        "crop_name string, quantity_sold double, unit_price double, total_sales double, total_expenses double, transport_cost double, water_used double, actual_yield double")
    made = rows(finance.finance_metrics(df).select("crop_name", "revenue", "cost", "profit_margin_pct", "water_efficiency"), "crop_name")
    assert made == [("a", 9.0, None, None, None), ("b", 2.0, 2.0, 0.0, 2.0), ("c", 0.0, 2.0, None, 2.0)]


def test_summary_skips_missing_crops_and_sums_nothing_to_zero(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 1.0, 0.0, 1.0), ("x", None, None, None, None)],
        "crop_name string, revenue double, cost double, profit_calc double, quantity_sold double")
    assert rows(finance.summary_by_crop(df)) == [("x", 0.0, 0.0, 0.0, 0.0, None)]


def test_profit_difference(spark):
    df = spark.createDataFrame([(10.0, 4.0, 7.0)], "revenue double, cost double, profit double")
    assert finance.with_profit(df).first().profit_diff == 1.0
