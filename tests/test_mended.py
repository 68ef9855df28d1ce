"""Answers that earlier versions had wrong, each on the smallest case."""

import pytest
from conftest import rows

from furrow.functions import scalars as s
from furrow.operators import allocation, enrich, joins, stats
from furrow.sources import government
from pyspark.sql import functions as F

COLUMNS = "farm long, crop string, area double, profit double, water_per_area double, fert_per_area double, water_limit double, fertilizer_limit double"


@pytest.mark.parametrize("profit", [5e8, 1e9, 1e12])
def test_a_limit_beside_a_huge_profit_is_reached(spark, profit):
    crops = [(1, "a", 10.0, profit, 9.0, 1.0, 30.0, 100.0)] + [(1, c, 10.0, 1.0, 1.0, 1.0, 30.0, 100.0) for c in "bcd"]
    made = allocation.allocate_resources(spark.createDataFrame(crops, COLUMNS)).collect()
    assert {r["status"] for r in made} == {"optimized"}
    assert abs(sum(r["allocation"] for r in made) - 10) < 1e-4
    assert sum(r["allocation"] * (9 if r["crop"] == "a" else 1) for r in made) <= 30 + 1e-3


def test_a_missing_profit_earns_nothing(spark):
    crops = [(1, "a", 10.0, None), (1, "b", 10.0, 2.0), (1, "c", 10.0, float("nan")), (1, "d", 10.0, 1.0)]
    frame = spark.createDataFrame(crops, "farm long, crop string, area double, profit double")
    for made in (allocation.allocate_smooth(frame), allocation.allocate(frame, 0.05, 0.4)):
        found = {r["crop"]: r["allocation"] for r in made.collect()}
        assert abs(sum(found.values()) - 10) < 1e-6
        assert found["b"] >= found["a"]


def test_white_space_and_number_text(spark):
    frame = spark.createDataFrame([("\t Area \u00a0\n", "12d"), (None, "1e3f"), ("x", " 1,234.5 "), ("x", "-.5e2"), ("x", "nan"), ("x", "0x1A")], "a string, b string")
    made = frame.select(s.normal_text(F.col("a")).alias("a"), s.number_or_zero(F.col("b")).alias("b")).collect()
    assert [r["a"] for r in made] == ["area", "nan", "x", "x", "x", "x"]
    assert [r["b"] for r in made] == [0.0, 0.0, 1234.5, -50.0, 0.0, 0.0]


def test_an_area_that_is_no_number_is_rejected(spark):
    made = enrich.validated(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "area_donums double")).collect()
    assert [bool(r["reasons"]) for r in made] == [True, False, True]


def test_short_lines_and_a_crop_named_crop_stay(spark, tmp_path):
    text = 'Title;x\n\n"Area";"KIND";"Crop";"Level";"2020";"2021";"2022";"2023";"2024"\nProduction;Summer;Tomato;Amman;1;2\nArea;Summer;crop;Amman;1;2;3;4;5;\n  \nArea;Winter\n'
    (tmp_path / "f.csv").write_text(text)
    path = str(tmp_path / "f.csv")
    made = government.read_table(spark, path, government.PRODUCTION_FIELDS).drop("line_no")
    assert rows(made) == rows(spark.createDataFrame([
        ("Production", "Summer", "Tomato", "Amman", "1", "2", None, None, None),
        ("Area", "Summer", "crop", "Amman", "1", "2", "3", "4", "5"),
        ("Area", "Winter", None, None, None, None, None, None, None),
    ], made.schema))
    assert [r["lines"] for r in government.skipped_lines(spark, path, government.PRODUCTION_FIELDS).collect()] == [1]


def test_pressure_before_or_after_the_fallback(spark):
    frame = spark.createDataFrame([("a", 0.0, 5.0)], "crop_name string, supply double, demand double")
    assert frame.withColumns(enrich.balance_columns()).first()["demand_level_ord"] == 2
    filled = frame.withColumn("supply", F.lit(100.0)).withColumns(enrich.balance_columns())
    assert filled.first()["demand_level_ord"] == 0


def test_sparse_ids_cost_no_range(spark):
    frame = spark.createDataFrame([(1,), (10**15,), (3,), (3,), (None,)], "record_id long")
    assert rows(stats.missing_ranges(frame)) == [(2, 2), (4, 10**15 - 1)]
    near = spark.createDataFrame([(i,) for i in range(0, 50, 7)], "record_id long")
    assert rows(stats.missing_ids(near)) == [(i,) for i in range(50) if i % 7 and i < 49]
    assert stats.missing_ids(frame.limit(0)).count() == 0


def test_equal_rows_are_told_by_all_columns(spark):
    frame = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("a", "a")], "x string, y string")
    row = stats.table_shape(frame).first()
    assert (row["row_count"], row["missing_values_total"], row["duplicate_rows"]) == (4, 3, 1)


def test_only_hot_keys_get_sub_keys(spark):
    facts = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    lookup = spark.range(9000).selectExpr("id as k", "id * 2 as v")
    made = joins.salted_join(facts, lookup, ["k"], salts=8)
    assert made.count() == 9000 and made.where("v <> k * 2").count() == 0
    assert joins.salted_join(facts, lookup.where("k > 5"), ["k"], salts=8).where("v is null").count() == facts.where("k <= 5").count()
