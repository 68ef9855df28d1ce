"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(driver.oracle_sql())


def normal(value):
    if value is None:
        return (0, "")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return (1, float(value) + 0.0)
    return (2, str(value))


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, data, sql, name):
    made = driver.queries()[name](spark, data)
    found = sql.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(made.columns)
    order = sorted(columns)
    expected = sorted(tuple(normal(row[columns.index(c)]) for c in order) for row in found.fetchall())
    assert sorted(tuple(normal(row[c]) for c in order) for row in made.collect()) == expected
    assert expected


def test_entry(spark, data):
    assert driver.entry(spark).count() == 25


def test_oracles_belong_to_queries():
    from furrow.plans.oracles import ORACLES

    assert set(ORACLES) <= set(driver.queries())
