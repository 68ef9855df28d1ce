"""Requests to splits under limits, and the crop table, on small tables."""

import pytest

from furrow.operators import allocation, enrich


def test_crop_table_lookup(spark):
    crops = spark.createDataFrame([(7, "Tomato", 2.5), (3, "Tomato", 1.5), (4, "Rice", None), (5, None, 9.0)], "id long, name_en string, avg_yield_per_donum double")
    asked = spark.createDataFrame([("Tomato",), ("Rice",), ("Kale",), (None,)], "crop_name string")
    found = {r.crop_name: (r.crop_id, r.avg_yield_per_donum) for r in enrich.with_crop_table(asked, crops).collect()}
    assert found == {"Tomato": (3, 1.5), "Rice": (4, 0.0), "Kale": (None, 0.0), None: (None, 0.0)}


def test_candidates_meet_the_needs_of_their_crops(spark):
    medians = spark.createDataFrame([("a", 2.0, 1.0), ("b", 8.0, 3.0)], "crop_name string, water_per_area double, fert_per_area double")
    rows = [(1, c, 10.0, p, w, 60.0) for c, p, w in (("a", 5.0, 50.0), ("b", 9.0, 50.0), ("c", 1.0, 50.0))]
    farms = spark.createDataFrame(rows, "farm long, crop string, area double, profit double, water_limit double, fertilizer_limit double")
    known = enrich.with_coefficients(farms, medians)
    assert {r.crop: (r.water_per_area, r.fert_per_area) for r in known.collect()} == {"a": (2.0, 1.0), "b": (8.0, 3.0), "c": (None, None)}
    split = {r.crop: r for r in allocation.allocate_resources(known).collect()}
    used = 2 * split["a"].allocation + 8 * split["b"].allocation
    assert used <= 50.0 * (1 + 1e-9) and sum(r.allocation for r in split.values()) == pytest.approx(10.0)
    proof = allocation.proven(allocation.allocate_resources(known)).first()
    assert proof.status == "optimized" and proof.as_priced and proof.slackness and proof.within_limits
