"""The pipeline's stages, one by one, and the registered queries of the subpackage."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from furrow.llm import line_dedup  # noqa: E402
from furrow.llm.queries import ORACLES, QUERIES  # noqa: E402

from .test_documents import brute_fingerprint, brute_groups, brute_lines  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    sql = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        sql.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = sql.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    made = QUERIES[name](spark, data).select(*columns).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, found.fetchall()))


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, data)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    before, after = kept["language"]
    assert 0 < after.count() <= before.count()
    before, after = kept["quality"]
    assert 0.7 * before.count() < after.count() < before.count()
    before, after = kept["lines"]
    texts = [r["text"] or "" for r in before.collect()]
    made = line_dedup.digest_columns(line_dedup.drop_lines(before, carry=["doc_id"]))
    assert brute_lines(texts, 10) == __import__("collections").Counter(tuple(r)[1:] for r in made.collect())
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = kept["near_duplicates"]
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before.collect()}
    group = brute_groups(set(prints.values()), 4)
    stay = {}
    for key in sorted(prints):
        stay.setdefault(group[prints[key]], key)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(stay.values())
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_stages_take_odd_rows(spark, corpus, no_rows, data, tmp_path):
    for docs, label in ((corpus, "odd"), (no_rows, "none")):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, data).write.parquet(str(tmp_path / label / name))
            made = spark.read.parquet(str(tmp_path / label / name))
            if name != "packing":
                assert made.columns == docs.columns


def test_run_is_registered(spark, data):
    import __spark_entry__ as driver

    assert driver.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
