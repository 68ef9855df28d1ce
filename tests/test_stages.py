"""Stages: small tables are stored once, changed files count as new, the shared folder is left clean."""

import os
import subprocess
import sys
from pathlib import Path

from furrow import session
from furrow.files import Store
from furrow.operators.joins import lookup_join
from furrow.plans.catalog import QUERIES

REPO = Path(__file__).resolve().parents[1]


def stages(spark):
    folder = session._SCRATCH.folder(spark)
    return Store(spark, folder).names()


def test_the_same_plan_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "prices")
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double").write.parquet(path)
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")

    def joined():
        return sorted(lookup_join(facts, spark.read.parquet(path).groupBy("k").sum("v"), ["k"]).collect(), key=str)

    first = joined()
    before = stages(spark)
    assert joined() == first and stages(spark) == before
    # another name for the same values is another table
    renamed = spark.read.parquet(path).withColumnRenamed("v", "w")
    assert session.measured(renamed)[0].columns == ["k", "w"] and session.measured(spark.read.parquet(path))[0].columns == ["k", "v"]


def test_changed_files_are_read_again(spark, tmp_path):
    path = str(tmp_path / "prices")
    for value in (1.0, 2.0):
        spark.createDataFrame([("a", value)], "k string, v double").coalesce(1).write.mode("overwrite").parquet(path)
        assert session.measured(spark.read.parquet(path))[0].first()["v"] == value
    spark.createDataFrame([("b", 3.0)], "k string, v double").write.mode("append").parquet(path)
    assert session.measured(spark.read.parquet(path))[0].count() == 2


def test_a_query_stores_each_lookup_once(spark, data):
    QUERIES["request_enrichment"](spark, data).count()
    before = len(stages(spark))
    QUERIES["request_enrichment"](spark, data).count()
    assert len(stages(spark)) == before


def test_the_shared_folder_is_empty_after_the_application(tmp_path):
    shared = tmp_path / "shared"
    code = (
        "from furrow.session import build_session, cut_lineage\n"
        f"spark = build_session('one', 'local[1]', spark__checkpoint__dir={str(shared)!r})\n"
        "assert cut_lineage(spark.range(5)).count() == 5\n"
        "spark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO, env={**os.environ, "PYTHONPATH": str(REPO)}, timeout=120)
    left = [p for p in shared.rglob("*") if p.is_file()]
    assert left == [] and not list(shared.rglob("stages-*"))
