import datetime as dt

import pytest
from conftest import rows

from furrow.operators import enrich, ml, scoring, stats
from furrow.schemas import CROP_DEMAND, CROP_SUPPLY, CROP_TABLE, FARM_REQUEST, WEATHER
from furrow.sources.tables import rows_to_table

GOOD = dict(request_id=1, crop_name="Tomato", governorate="Ma'an", area_donums=20.0, planting_date="2024-01-01", sale_date="2024-05-01",
            pest_indicator=False, market_location="Amman")


def requests(spark, *changes):
    return rows_to_table(spark, [{**GOOD, "request_id": i, **c} for i, c in enumerate(changes, 1)], FARM_REQUEST)


@pytest.mark.parametrize(
    "change, reason",
    [({}, ""), ({"crop_name": ""}, "crop_name length"), ({"crop_name": "x" * 101}, "crop_name length"), ({"crop_name": None}, "crop_name length"),
     ({"area_donums": 0.0}, "area not positive"), ({"area_donums": None}, "area not positive"), ({"governorate": "Paris"}, "unknown governorate"),
     ({"sale_date": "soon"}, "unreadable sale date"), ({"planting_date": None}, "unreadable planting date"),
     ({"sale_date": "2024-01-01"}, "sale not after planting")])
def test_validation(spark, change, reason):
    row = enrich.validated(requests(spark, change)).first()
    assert "; ".join(row.reasons) == reason and row.warnings == []


def test_unlisted_market_only_warns(spark):
    checked = enrich.validated(requests(spark, {"market_location": "Karak"}, {"area_donums": -1.0}))
    assert checked.where("request_id = 1").first().warnings == ["unlisted market"]
    assert [r.request_id for r in enrich.accepted(checked).collect()] == [1]
    assert [r.request_id for r in enrich.rejected(checked).collect()] == [2]


@pytest.fixture
def context(spark):
    day = dt.date
    crops = rows_to_table(spark, [dict(id=1, name_en="Tomato"), dict(id=2, name_en="Wheat"), dict(id=3, name_en="Rice")], CROP_TABLE)
    supply = rows_to_table(spark, [dict(crop_id=1, supply_date=day(2024, 1, 1), total_estimated_tons=99.0),
                                   dict(crop_id=1, supply_date=day(2024, 2, 1), total_estimated_tons=5.0),
                                   dict(crop_id=1, supply_date=day(2024, 2, 1), total_estimated_tons=6.0)], CROP_SUPPLY)
    demand = rows_to_table(spark, [dict(crop_id=1, demand_date=day(2024, 1, 1), demand_tons=10.0),
                                   dict(crop_id=2, demand_date=day(2024, 1, 1), demand_tons=0.0)], CROP_DEMAND)
    seen = rows_to_table(spark, [dict(governorate="Ma'an", observed_at=dt.datetime(2024, 1, h), temperature=float(h), humidity=1.0, rainfall=2.0, wind_speed=3.0)
                                 for h in (1, 3, 2)], WEATHER)
    baselines = spark.createDataFrame([("Tomato", 2.0, 30.0, 0.5, 10.0, 0.6, 0.4)],
                                      "crop_name string, market_price double, yield_per_ha double, fertilizer_per_ha double, water_per_ha double, supply double, demand double")
    return scoring.Context(baselines, enrich.latest_balance(crops, supply, demand), seen, "2024-04-01")


def test_enrichment(spark, context):
    made = scoring.enriched(requests(spark, {}, {"crop_name": "Wheat", "governorate": "Amman"}, {"crop_name": "Kiwi"}), context)
    tomato, wheat, kiwi = made.orderBy("request_id").collect()
    assert (tomato.supply, tomato.demand, tomato.demand_level_ord, tomato.sufficiency_status) == (6.0, 10.0, 2, "Deficit")
    assert (tomato.market_price, tomato.area_size, tomato.fertilizer_used, tomato.water_used) == (2.0, 2.0, 1.0, 20.0)
    assert (tomato.farm_location, tomato.region_type, tomato.temperature) == ("Maan", "Rural", 3.0)
    assert (wheat.supply, wheat.demand, wheat.sufficiency_status, wheat.temperature, wheat.humidity) == (0.0, 0.0, "Balanced", 20.0, 50.0)
    assert (kiwi.market_price, kiwi.fertilizer_used, kiwi.demand_level_ord) == (100.0, 0.0, 0)
    coarse = enrich.with_place(requests(spark, {}), as_trained=False).first()
    assert coarse.farm_location == "Southern"


def test_market_context(spark, context):
    row = scoring.market_context(requests(spark, {}), context).first()
    assert (row.sufficiency_status, row.sale_gap_days, row.supply_score, row.demand_score) == ("Shortage", 30, 0.6, 0.4)


def test_candidates_keep_their_position(spark):
    df = spark.createDataFrame([(1, " Tomato,Wheat , Tomato")], "request_id long, crops_list string")
    assert rows(enrich.candidate_crops(df).select("position", "crop_name")) == [(0, "Tomato"), (1, "Wheat")]


@pytest.fixture(scope="module")
def records(spark, data):
    from furrow.plans.farm_view import farm_records

    return farm_records(spark, data).dropna(subset=["customer_type"]).limit(2000).persist()


@pytest.fixture(scope="module")
def yields(spark, records):
    tree = ml.rg.DecisionTreeRegressor(labelCol="actual_yield", seed=1, maxDepth=3)
    return ml.pipeline(ml.YIELD, tree).fit(ml.prepared(records, ml.YIELD))


@pytest.fixture(scope="module")
def profits(spark, records):
    tree = ml.rg.DecisionTreeRegressor(labelCol="profit", seed=1, maxDepth=3)
    return ml.pipeline(ml.PROFIT, tree).fit(ml.prepared(records, ml.PROFIT).dropna())


def test_scores(spark, context, yields, profits, records):
    asked = requests(spark, {}, {"crop_name": "Kiwi"})
    grown = scoring.score_yield(asked, context, yields).collect()
    assert len(grown) == 2 and all(r.value == f"{round(r.predicted_yield, 2)} Tons/Units" for r in grown)
    gained = scoring.score_profit(asked, context, profits, yields).orderBy("request_id").collect()
    assert [r.actual_yield for r in gained] == [r.predicted_yield for r in sorted(grown, key=lambda r: r.request_id)]
    assert all(r.value.startswith("$") for r in gained)
    assert scoring.score_table(records, yields, ml.YIELD).count() == records.count()


def test_price_and_demand_scores(spark, context, records):
    tree = ml.rg.DecisionTreeRegressor(labelCol="market_price", seed=1, maxDepth=3)
    price = ml.pipeline(ml.PRICE, tree).fit(ml.prepared(records, ml.PRICE))
    assert scoring.score_price(requests(spark, {}), context, price).first().predicted_price > 0
    known = records.where("demand_level in ('Low', 'Medium', 'High')")
    model = ml.pipeline(ml.DEMAND, ml.cl.DecisionTreeClassifier(labelCol="label", seed=1, maxDepth=3)).fit(ml.prepared(known, ml.DEMAND))
    assert scoring.score_demand(requests(spark, {}), context, model).first().value in ("Low", "Medium", "High")


def test_requests_to_allocation(spark, context, profits):
    df = spark.createDataFrame([(1, 100.0, "Amman", "2024-01-01", "2024-05-01", "Tomato, Wheat,Rice , Kiwi"), (2, 50.0, "Irbid", "2024-01-01", "2024-05-01", "Wheat, Rice")],
                               "request_id long, area_donums double, governorate string, planting_date string, sale_date string, crops_list string")
    made = scoring.allocate_requests(df, context, profits).toPandas()
    first, second = made[made.request_id == 1], made[made.request_id == 2]
    assert first.allocation.sum() == pytest.approx(10.0) and set(first.status) == {"optimized"}
    assert list(first.sort_values("position").crop_name) == ["Tomato", "Wheat", "Rice", "Kiwi"]
    assert set(second.status) == {"fallback"} and set(second.expected_total_profit) == {0.0}


def test_all_zero_profits_take_prices(spark, context, profits, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(scoring, "predicted", lambda df, model, spec, name: df.withColumn(name, F.lit(-3.0)))
    df = spark.createDataFrame([(1, 100.0, "Amman", "2024-01-01", "2024-05-01", "Tomato,Kiwi,Rice")],
                               "request_id long, area_donums double, governorate string, planting_date string, sale_date string, crops_list string")
    assert rows(scoring.candidate_profits(df, context, profits).select("crop_name", "profit")) == [("Kiwi", 100.0), ("Rice", 100.0), ("Tomato", 2.0)]


def test_group_statistics_feed_the_context(records):
    assert {"market_price", "supply"} <= set(stats.crop_baselines(records).columns)
