import pytest
from conftest import rows

from furrow.operators.reshape import pivot_first, to_season_months
from furrow.plans import etl
from furrow.sources import government, lookups, tables
from furrow.schemas import FARM_REQUEST

PRODUCTION = """Area and production of crops
Second line of the title

"Area & Production";"KIND";"Crop";"Level";"2020";"2021";"2022";"2023";"2024";
" Area ";"Summer";" Tomatoes ";"Amman";"1,000";2;3;4;5;
"Production";"Summer";"Tomatoes";"Amman";"2,400.0";x;24;36;48;
"Area";"Winter";"Cucumber";"Atlantis";10;10;10;10;10;
"""
PRICES = """Prices
"Marketing Costs / Prices";"Level";"Crop";"Month";"2020";"2021";"2022";"2023";"2024"
"Farm-Gate Price";"Up-Land";"Tomatoes";"January";100;200;300;400;500
"Farm-Gate Price";"Kingdom";"Tomatoes";"February";10;20;30;40;50
"Central Market Prices ";"Up-Land";"Tomatoes";"January";111;222;333;444;555
"Packs";"Up-Land";"Tomatoes";"March";7;7;7;7;7
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "production.csv").write_text("﻿" + PRODUCTION, encoding="utf-8")
    (tmp_path / "prices.csv").write_text(PRICES, encoding="utf-8")
    return str(tmp_path / "production.csv"), str(tmp_path / "prices.csv")


def test_untidy_file_is_read(spark, files):
    read = government.read_table(spark, files[0], government.PRODUCTION_FIELDS)
    assert read.count() == 3
    made = etl.clean_production(read, government.YEARS)
    tomato = {r.year: (r.area_size, r.total_yield) for r in made.where("crop = 'tomatoes'").collect()}
    assert tomato == {2020: (1000.0, 2400.0), 2021: (2.0, 0.0), 2022: (3.0, 24.0), 2023: (4.0, 36.0), 2024: (5.0, 48.0)}
    # a kind without rows stays missing
    assert {r.total_yield for r in made.where("crop = 'cucumber'").collect()} == {None}


def test_file_without_data_lines_is_an_error(spark, tmp_path):
    (tmp_path / "short.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError, match="no line with 9 fields"):
        government.read_table(spark, str(tmp_path / "short.csv"), government.PRODUCTION_FIELDS)


def test_latin_file_is_decoded_whole(spark, tmp_path):
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "a.csv").write_bytes('"Area";"Summer";"Caf\xe9";"Amman";1\n"Area";"Summer";"\xc3\xa9";"Amman";2\n'.encode("latin-1"))
    (tmp_path / "latin" / "b.csv").write_text('"Area";"Summer";"Café";"Balqa";3\n', encoding="utf-8")
    read = government.read_table(spark, str(tmp_path / "latin"), government.SEASON_PRODUCTION_FIELDS)
    assert rows(read.select("crop", "location", "value_2024")) == [("Café", "Amman", "1"), ("Café", "Balqa", "3"), ("Ã©", "Amman", "2")]


def test_multi_year_run(spark, files, tmp_path):
    out = str(tmp_path / "made" / "sales")
    table = etl.run_years(spark, *files, output=out)
    assert table.columns == ["record_id", "crop_name", "year", "month", "farm_location", "region_type", "area_size",
                             "actual_yield_tons", "quantity_sold_kg", "unit_price_jod", "total_sales_jod"]
    assert sorted(r.record_id for r in table.collect()) == list(range(1, 121))
    by = {(r.crop_name, r.year, r.month): r for r in table.collect()}
    regional = by["tomatoes", 2020, "January"]
    assert (regional.region_type, regional.quantity_sold_kg, regional.unit_price_jod, regional.total_sales_jod) == ("up-land", 200_000.0, 0.1, 20_000.0)
    assert by["tomatoes", 2020, "February"].unit_price_jod == 0.01  # national price
    assert by["tomatoes", 2020, "March"].unit_price_jod is None  # no price: zero, then unknown
    assert by["tomatoes", 2021, "January"].actual_yield_tons is None
    assert by["cucumber", 2020, "May"].region_type == "kingdom"
    assert spark.read.option("header", True).csv(out).count() == 120


def test_price_metrics_fan_out_on_request(spark, files):
    read = government.read_table(spark, files[1], government.PRICE_FIELDS)
    assert etl.clean_prices(read, government.YEARS).count() == 10
    assert etl.clean_prices(read, government.YEARS, faithful=True).count() == 15
    packs = read.where("metric = 'Packs'")
    assert etl.price_rows(packs).count() == 1  # no price at all: everything is kept
    with pytest.raises(ValueError, match="no rows of kind area"):
        etl.require_kinds(read.withColumnsRenamed({"metric": "kind"}))


def test_season_run(spark, tmp_path):
    title = '"Title, with commas"\n\n'
    (tmp_path / "p.csv").write_text(
        title + '"Area & Production";"KIND";"Crop";"Level";"2024"\n"Area";"Summer";"Tomatoes";"Amman";10\n"Production";"Summer";"Tomatoes";"Amman";60\n'
        '"Production";"Summer";"Tomatoes";"Amman";99\n"Area";"Spring";"Tomatoes";"Nowhere";5\n')
    (tmp_path / "q.csv").write_text(
        title + '"Marketing Costs / Prices";"Level";"Crop";"Month";"2024"\n"Farm-Gate Price";"Up-Land";"Tomatoes";"May";200\n'
        '"Farm-Gate Price";"Kingdom";"Tomatoes";"June";100\n"Central Market Prices ";"Up-Land";"Tomatoes";"July";1\n')
    table = etl.run_season(spark, str(tmp_path / "p.csv"), str(tmp_path / "q.csv"))
    assert len(table.columns) == 24
    found = {(r.season, r.month): r for r in table.collect()}
    assert len(found) == 7 and found["Spring", None].region_type == "Kingdom"
    may = found["Summer", "May"]
    assert (may.quantity_sold, may.unit_price, may.total_sales, may.actual_yield) == (10_000.0, 0.2, 2000.0, 60.0)
    assert may.market_price == pytest.approx(0.23) and may.profit is None
    assert found["Summer", "June"].unit_price == 0.1 and found["Summer", "July"].unit_price is None


def test_first_value_and_unknown_season(spark):
    df = spark.createDataFrame([("Summer", "Area", None, 1), ("Summer", "Area", 7.0, 2), ("Summer", "Area", 8.0, 3)], "season string, metric string, v double, n int")
    assert rows(pivot_first(df, ["season"], "metric", "v", "n", {"Area": "area_size", "Production": "total_yield"})) == [("Summer", 7.0, None)]
    months = to_season_months(spark.createDataFrame([("Winter", 12.0), ("Monsoon", 6.0)], "season string, total_yield double"))
    assert rows(months.groupBy("season").count()) == [("Monsoon", 1), ("Winter", 6)]


def test_typed_csv_and_rows(spark, tmp_path):
    (tmp_path / "r.csv").write_text("record_id,planting_date,pest_indicator,profit\n1,2024-01-02,1,3.5\n2,2024-01-03,false,NaN\n")
    from furrow.schemas import FARM_RECORD
    from pyspark.sql.types import StructType

    schema = StructType([FARM_RECORD[c] for c in ("record_id", "planting_date", "pest_indicator", "profit")])
    read = tables.read_farm_records(spark, str(tmp_path / "r.csv"), schema)
    assert [(r.record_id, str(r.planting_date), r.pest_indicator, r.profit) for r in read.orderBy("record_id").collect()] == [
        (1, "2024-01-02", True, 3.5), (2, "2024-01-03", False, None)]
    assert tables.load_sample(spark, str(tmp_path / "r.csv"), 1).count() == 1
    with pytest.raises(ValueError):
        tables.load_sample(spark, None)
    made = tables.rows_to_table(spark, [{"crop_name": "Tomato", "area_donums": 5.0}], FARM_REQUEST)
    assert made.first().crop_name == "Tomato" and made.first().sale_date is None
    assert lookups.price_regions(spark, lower=True).where("location = 'amman'").first().price_region == "up-land"
