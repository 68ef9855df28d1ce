"""Model jobs on large tables: what is read, joined and encoded once, with the rows of the plain way."""

import pytest
from pyspark.sql import functions as F

from furrow import session
from furrow.operators import enrich, ml, scoring, stats
from furrow.plans import catalog, inputs
from furrow.plans.farm_view import farm_records, table
from tests.conftest import rows

KINDS = ml.ModelSpec("y", (), ("kind",), ("x",))
LEVELS = ml.ModelSpec("level", (), ("kind",), ("x",), classes=True)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def counted(spark):
    """2000 rows, and how often their input ``x`` was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(i):
        seen.add(1)
        return float(i % 50)

    known = spark.range(2000).select(
        x("id").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 50 * 2.0).alias("y"),
        F.element_at(F.array(F.lit("Low"), F.lit("High")), (F.col("id") % 2 + 1).cast("int")).alias("level"),
    )
    return known, seen


def test_a_fit_encodes_its_rows_once(counted):
    train, seen = counted
    kept = set(train.sparkSession.sparkContext._jsc.getPersistentRDDs())
    model = ml.fitted(ml.pipeline(KINDS, ml.rg.DecisionTreeRegressor(labelCol="y", seed=1)), train)
    assert seen.value == 2000
    plain = ml.pipeline(KINDS, ml.rg.DecisionTreeRegressor(labelCol="y", seed=1)).fit(train)
    assert model.stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]
    assert ml.learned_labels(model, "kind") == ["b", "a"]
    assert set(train.sparkSession.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_a_board_encodes_its_rows_once_for_all_models(spark, counted, monkeypatch):
    train, seen = counted
    test = train.localCheckpoint()
    seen.value = 0
    monkeypatch.setattr(catalog, "_training", lambda *_: (train, test))
    line = ml.cl.LogisticRegression(labelCol="label", maxIter=3)
    chosen = {"each": ml.cl.OneVsRest(classifier=line, labelCol="label"), "tree": ml.cl.DecisionTreeClassifier(labelCol="label", seed=1), "bayes": ml.cl.NaiveBayes()}
    board = catalog._trained_board(spark, "", LEVELS, chosen)
    assert seen.value == 2000
    found = {r.model: r.asDict() for r in board.collect()}
    for name, estimator in chosen.items():
        model = ml.fitted(ml.pipeline(LEVELS, estimator), test)
        assert {"model": name, **ml.measured_on(model, LEVELS, test)} == pytest.approx(found[name])


def test_records_are_joined_once_for_several_models(spark, data, monkeypatch):
    stored = []
    monkeypatch.setattr(catalog, "few_tasks", lambda source: False)
    monkeypatch.setattr(catalog, "cut_lineage", lambda df, n: stored.append(df) or session.cut_lineage(df, n))
    found = catalog._trainings(spark, data, ml.PROFIT, ml.YIELD)
    assert len(stored) == 1
    for spec, parts in zip((ml.PROFIT, ml.YIELD), found):
        for part, alone in zip(parts, catalog._training(spark, data, spec)):
            assert part.columns == alone.columns and rows(part) == rows(alone)


def test_an_even_scan_is_not_dealt_anew(spark, tmp_path, monkeypatch):
    even, single = str(tmp_path / "even"), str(tmp_path / "single")
    spark.range(80_000).repartition(8).write.parquet(even)
    spark.range(80_000).coalesce(1).write.parquet(single)
    even, single, none = spark.read.parquet(even), spark.read.parquet(single), spark.read.parquet(single).where("id < 0")
    assert session.few_tasks(even) and session.few_tasks(single)
    monkeypatch.setattr(session, "SPLIT_BYTES", 1)
    assert not session.few_tasks(even) and session.few_tasks(single) and session.few_tasks(none)
    assert "Repartition" not in plan(session.spread(even, even)) and "Repartition" in plan(session.spread(single, single))
    monkeypatch.setattr(session, "TASK_BYTES", 1)
    assert not session.few_tasks(single)


def test_baselines_and_demand_come_from_one_join(spark, data):
    context = catalog._context(spark, data)
    assert plan(context.baselines).count("l_orderkey") == plan(table(spark, data, "lineitem")).count("l_orderkey")
    records = farm_records(spark, data, ["crop_name", "market_price", *catalog.AREA_INPUTS, "supply_score", "demand_score"])
    scores = records.groupBy("crop_name").agg(F.avg("demand_score").alias("demand"))
    expected = stats.crop_baselines(records).join(scores, "crop_name")
    assert context.baselines.columns == expected.columns
    for got, want in zip(rows(context.baselines), rows(expected), strict=True):
        assert got == pytest.approx(want)


def test_rules_are_checked_one_by_one_with_the_same_rows(spark, data):
    asked = spark.createDataFrame(
        [
            (1, "Rice", "Amman", 4.0, "2020-01-01", "2020-05-01"), (2, None, "Amman", 4.0, "2020-01-01", "2020-05-01"),
            (3, "Rice", None, 4.0, "2020-01-01", "2020-05-01"), (4, "Rice", "Amman", None, "2020-01-01", "2020-05-01"),
            (5, "Rice", "Amman", float("nan"), "2020-01-01", "2020-05-01"), (6, "Rice", "Amman", 4.0, None, "2020-05-01"),
            (7, "Rice", "Amman", 4.0, "2020-01-01", "soon"), (8, "Rice", "Amman", 4.0, "2020-05-01", "2020-05-01"),
            (9, "", "Amman", 4.0, "2020-01-01", "2020-05-01"), (10, "Rice", "Nowhere", 4.0, "2020-01-01", "2020-05-01"),
            (1, "Rice", "Amman", 4.0, "2020-01-01", "2020-05-01"), (None, "Rice", "Ma'an", 1.0, "2020-01-01", "2020-05-01"),
        ],
        "request_id int, crop_name string, governorate string, area_donums double, planting_date string, sale_date string",
    )
    for requests in (asked, asked.drop("sale_date"), asked.drop("governorate", "area_donums")):
        assert rows(enrich.valid(requests)) == rows(enrich.accepted(enrich.validated(requests)))
    assert [r.request_id for r in enrich.valid(asked).collect()] == [1, 1, None]
    valid = catalog._valid_requests(spark, data)
    assert rows(valid) == rows(enrich.accepted(enrich.validated(inputs.farm_requests(spark, data))))
    # the rule on places stands below the join with the order lines, next to the customers' nations
    text = plan(valid)
    assert "unknown governorate" not in text and "Amman" in text[text.index("l_orderkey#", text.index("Relation")):]


def test_dates_are_not_read_from_text_again(spark):
    days = spark.sql("select * from values (date'2020-02-29', 'a', 1D, 2D), (null, 'b', 1D, 3D), (date'0012-12-31', 'a', 1D, 3D) t(sale_date, kind, x, y)")
    spec = ml.ModelSpec("y", ("sale_date",), ("kind",), ("x",))
    made, text = ml.prepared(days, spec), ml.prepared(days.withColumn("sale_date", F.col("sale_date").cast("string")), spec)
    assert rows(made) == rows(text) and made.schema == text.schema
    assert "as string" not in plan(made)


def test_columns_that_nothing_reads_are_not_carried_through_a_model(spark, counted):
    train, _ = counted
    model = ml.pipeline(KINDS, ml.rg.DecisionTreeRegressor(labelCol="y", seed=1)).fit(train)
    asked = train.select("x", "kind", F.col("y").alias("my note"), F.lit(1).alias("unread"))
    scored = scoring.predicted(asked, model, KINDS, "found")
    assert scored.columns == ["x", "kind", "my note", "unread", "found"]
    assert "my note" in plan(scored) and "my note" not in plan(scored.select("kind", "found"))
    assert rows(scored.drop("unread")) == rows(model.transform(train).select("x", "kind", F.col("y").alias("my note"), "prediction"))


def test_customers_are_joined_with_orders_before_the_lines(spark, data):
    made = farm_records(spark, data, ["record_id", "customer_type", "market_location"])
    text = plan(made)
    assert text.index(" = o_orderkey#") < text.index(" = c_custkey#")
    lines, orders, customer, nation = (table(spark, data, t) for t in ("lineitem", "orders", "customer", "nation"))
    kept = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    kept = kept.join(nation, customer.c_nationkey == nation.n_nationkey)
    assert rows(made.select("record_id")) == rows(kept.selectExpr("l_orderkey * 10 + l_linenumber as record_id"))
