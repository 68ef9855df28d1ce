import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from furrow.operators import ordering
from furrow.operators.joins import lookup_join, salted_join
from furrow.session import measured


@pytest.fixture
def facts(spark):
    # one key holds most rows, one is null, one is unknown to the lookup
    return spark.range(300).selectExpr("id", "case when id % 10 < 7 then 'hot' when id % 10 = 7 then null when id % 10 = 8 then 'odd' else 'cold' end as k")


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3), ("cold", 4)], "k string, v int")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_broadcast_and_salted_joins_agree(facts, lookup, how, null_safe):
    small = lookup_join(facts, lookup, ["k"], how, null_safe)
    large = lookup_join(facts, lookup, ["k"], how, null_safe, max_bytes=-1, salts=4)
    assert sorted(small.columns) == sorted(large.columns) == ["id", "k", "v"]
    order = ["id", "k", "v"]
    assert rows(small.select(order), *order) == rows(large.select(order), *order)
    expected = 300 + 30 if how == "left" else 270 + (30 if null_safe else 0)
    assert small.count() == expected


def test_salting_spreads_a_hot_key_and_copies(spark):
    copies = spark.range(2000, numPartitions=8).selectExpr("'hot' as k")
    found = salted_join(copies, spark.createDataFrame([("hot", 1)], "k string, v int"), ["k"], salts=8)
    assert found.count() == 2000
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), "k"), F.lit(8))
    assert copies.select(salt).distinct().count() > 1


def test_measured_counts_bytes(spark):
    stored, size = measured(spark.createDataFrame([("abc", 1), (None, 2)], "a string, b long"))
    assert (stored.count(), size) == (2, 2 * (16 + 8) + 3)


def test_sequential_ids_follow_the_order(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("(id * 37) % 1000 as x", "'a' as y")
    numbered = ordering.sequential_ids(df, ["x"], partitions=5)
    assert [tuple(r) for r in numbered.orderBy("record_id").collect()] == [(i + 1, i, "a") for i in range(1000)]


def test_sequential_ids_of_copies_and_descending(spark):
    df = spark.range(500, numPartitions=4).selectExpr("1 as x").unionAll(spark.range(3).selectExpr("id + 5 as x"))
    found = ordering.sequential_ids(df, [F.desc("x")], partitions=6).orderBy("record_id").collect()
    assert [r.record_id for r in found] == list(range(1, 504))
    assert [r.x for r in found][:4] == [7, 6, 5, 1]


@pytest.fixture
def groups(spark):
    rng = np.random.default_rng(3)
    made = {
        "even": rng.normal(size=400).round(3).tolist(),
        "ties": [1.0] * 300 + [2.0] * 5,
        "one": [4.5],
        "two": [1.0, 2.0],
        "wide": (rng.pareto(1.0, 350) * 100).tolist(),
    }
    pairs = [(k, v) for k, values in made.items() for v in values] + [("even", None), ("even", float("nan"))]
    return made, spark.createDataFrame(pairs, "k string, x double").repartition(3)


@pytest.mark.parametrize("small, slack", [(10_000, 5e-4), (0, 0.02), (0, 0.0)])
def test_quantiles_are_exact(groups, monkeypatch, small, slack):
    """Kept whole, bracketed, and with brackets so narrow that they miss."""
    made, df = groups
    monkeypatch.setattr(ordering, "SMALL_GROUP", small)
    monkeypatch.setattr(ordering, "SLACK", slack)
    probs = [0.25, 0.5, 0.9]
    found = {r.k: r for r in ordering.exact_quantiles(df, ["x"], probs, keys=["k"], partitions=4).collect()}
    for key, values in made.items():
        assert [found[key][f"q{i}"] for i in range(3)] == pytest.approx(np.quantile(values, probs).tolist(), abs=1e-12)


def test_quantiles_of_several_columns(spark):
    df = spark.range(101).selectExpr("cast(id as double) as a", "cast(id * id as double) as b", "cast(null as double) as c")
    found = {r.measure: (r.q0, r.q1) for r in ordering.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.75]).collect()}
    assert found == {"a": (0.0, 75.0), "b": (0.0, 5625.0)}
