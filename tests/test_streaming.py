import random

import pytest
from conftest import rows

from furrow.files import Store
from furrow.operators.joins import lookup_join
from furrow.operators.stats import latest_per_key
from furrow.schemas import EVENTS
from furrow.session import scratch_path
from furrow.streaming import latest, scoring
from furrow.schemas import FARM_REQUEST
from furrow.streaming.levels import LeveledTable


def test_running_latest_equals_the_batch(spark, data):
    events = spark.read.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(data)
    folder = scratch_path(spark, "test-events")
    events.repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    order = ["ts", "event_id"]
    assert rows(latest.latest_of_stream(stream, "user_id", order, "value")) == rows(latest_per_key(events, "user_id", order, "value"))


def test_a_late_old_row_changes_nothing(spark):
    folder, table, state = (scratch_path(spark, n) for n in ("late-in", "late-out", "late-state"))
    schema = "k int, d int, v double"
    for batch in ([(1, 10, 1.0)], [(1, 5, 2.0), (2, 1, 3.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        latest.start_latest(stream, "k", ["d"], "v", table, state).awaitTermination()
    assert rows(latest.published(spark, table, "k")) == [(1, 1.0), (2, 3.0)]


GOOD = (1, "Tomato", "Amman", 10.0, "2024-01-01", "2024-03-01", False, "Amman")
BAD = (2, "Tomato", "Nowhere", 10.0, "2024-01-01", "2024-03-01", False, "Amman")


@pytest.mark.parametrize("start", [scoring.start_scoring, scoring.start_allocating])
def test_requests_are_validated_and_scored_once(spark, start):
    folder, out, state = (scratch_path(spark, n) for n in ("req-in", "req-out", "req-state"))
    for batch in ([GOOD, BAD], [(3, *GOOD[1:])]):
        spark.createDataFrame(batch, FARM_REQUEST).coalesce(1).write.mode("append").json(folder)
        stream = scoring.read_requests(spark, folder, FARM_REQUEST)
        started = start(stream, lambda df: df.selectExpr("request_id", "area_donums * 2 as score"), out, state)
        for query in started if isinstance(started, list) else [started]:
            query.awaitTermination()
    assert rows(spark.read.parquet(f"{out}/scored").select("request_id", "score")) == [(1, 20.0), (3, 20.0)]
    assert rows(spark.read.parquet(f"{out}/rejected").selectExpr("request_id", "reasons[0]")) == [(2, "unknown governorate")]


def test_the_scored_stream_is_one_plan(spark):
    folder, out, state = (scratch_path(spark, n) for n in ("req-in", "req-out", "req-state"))
    spark.createDataFrame([GOOD, BAD], FARM_REQUEST).write.json(folder)
    prices = spark.createDataFrame([("Tomato", 2.0)], "crop_name string, price double")
    stream = scoring.read_requests(spark, folder, FARM_REQUEST)
    started = scoring.start_scoring(stream, lambda df: lookup_join(df, prices, ["crop_name"]).select("request_id", "price"), out, state)
    for query in started:
        query.awaitTermination()
        sink = query.lastProgress["sink"]["description"]
        assert "FileSink" in sink and "ForeachBatch" not in sink
    plan = started[0]._jsq.explainInternal(False) if hasattr(started[0], "_jsq") else ""
    assert "BroadcastHashJoin" in plan
    assert rows(spark.read.parquet(f"{out}/scored")) == [(1, 2.0)]


def changes(number):
    """Keys that a batch changes, with their new values."""
    draw = random.Random(number)
    return {draw.randrange(40): f"v{number}-{i}" for i in range(6)} | ({None: f"none{number}"} if number % 9 == 0 else {})


def batch_rows(spark, number):
    return spark.createDataFrame(list(changes(number).items()), "k int, latest string").coalesce(1)


def expected(numbers):
    known = {}
    for number in numbers:
        known |= changes(number)
    return sorted(known.items(), key=str)


def current(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_fifty_batches_leave_two_levels(spark):
    table = LeveledTable(spark, scratch_path(spark, "levels"), "k", fanout=8)
    most = 0
    for number in range(50):
        table.append(batch_rows(spark, number), number)
        most = max(most, len(table.manifest().runs))
    runs = table.manifest().runs
    assert {run.level for run in runs} == {0, 1} and len(runs) == 6 + 2 and most < 16
    assert current(table) == expected(range(50))
    assert len(table.store.names("manifests")) == 2
    # runs of the manifest before may stay for its readers, older ones are gone
    assert len(table.store.names("runs")) <= len(runs) + 8


def test_merges_climb_levels(spark):
    table = LeveledTable(spark, scratch_path(spark, "levels"), "k", fanout=2)
    for number in range(11):
        table.append(batch_rows(spark, number), number)
    assert sorted((run.level, run.first, run.last) for run in table.manifest().runs) == [(0, 10, 10), (1, 8, 9), (3, 0, 7)]
    assert current(table) == expected(range(11))


def test_a_crash_before_the_switch_loses_nothing(spark, monkeypatch):
    table = LeveledTable(spark, scratch_path(spark, "levels"), "k", fanout=3)
    for number in range(2):
        table.append(batch_rows(spark, number), number)

    def crash(state):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_switch", crash)
        with pytest.raises(RuntimeError):
            table.append(batch_rows(spark, 2), 2)  # writes its run and the merge of three
    assert current(table) == expected(range(2)) and len(table.store.names("runs")) == 4
    again = LeveledTable(spark, table.path, "k", fanout=3)
    again.append(batch_rows(spark, 2), 2)
    assert current(again) == expected(range(3))
    again.append(batch_rows(spark, 3), 3)
    again.append(batch_rows(spark, 4), 4)
    named = {run.name for run in again.manifest().runs}
    assert current(again) == expected(range(5)) and named <= set(again.store.names("runs"))
    assert len(again.store.names("runs")) == 3


def test_a_batch_tried_again_changes_nothing(spark):
    table = LeveledTable(spark, scratch_path(spark, "levels"), "k", fanout=2)
    for number in (0, 1, 1, 0, 2, 2):
        table.append(batch_rows(spark, number), number)
    assert current(table) == expected(range(3)) and table.manifest().last == 2


def test_a_second_writer_fails_and_readers_keep_their_runs(spark):
    path = scratch_path(spark, "levels")
    one, two = (LeveledTable(spark, path, "k", fanout=2) for _ in range(2))
    one.append(batch_rows(spark, 0), 0)
    stale = two.manifest()
    held = one.read()
    one.append(batch_rows(spark, 1), 1)
    with pytest.raises(FileExistsError):
        two._switch(type(stale)(stale.version + 1, stale.runs, stale.schema))
    assert sorted((tuple(r) for r in held.collect()), key=str) == expected(range(1))
    with pytest.raises(FileNotFoundError):
        LeveledTable(spark, scratch_path(spark, "levels"), "k").read()


def test_store_files(spark):
    store = Store(spark, scratch_path(spark, "store"))
    assert store.names() == [] and store.size() == 0
    store.create("a/b.txt", "text é")
    assert store.read("a/b.txt") == "text é" and store.names("a") == ["b.txt"] and store.size("a") > 6
    with pytest.raises(FileExistsError):
        store.create("a/b.txt", "other")
    assert store.read("a/b.txt") == "text é"
    store.delete("a")
    assert store.names("a") == []


def test_running_latest_over_many_batches(spark, data):
    events = spark.read.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(data)
    folder = scratch_path(spark, "test-events")
    events.repartition(7).write.parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    order = ["ts", "event_id"]
    found = latest.latest_of_stream(stream, "user_id", order, "value", fanout=2)
    assert rows(found) == rows(latest_per_key(events, "user_id", order, "value"))
