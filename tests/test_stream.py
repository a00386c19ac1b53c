import datetime
import os

import pytest
from pyspark.sql import functions as F

from strandlake.streaming.incremental import WindowState, windowed_events
from strandlake.streaming.state import SummedTables

TABLES = {"t": (["k"], ["n"])}


def _rows(spark, *rows):
    return {"t": spark.createDataFrame(list(rows), "k string, n long")}


def _sums(state):
    return {r["k"]: r["n"] for r in state.table("t").collect()}


def test_segments_are_merged_in_levels(spark, tmp_path):
    state = SummedTables(spark, str(tmp_path / "s"), TABLES, fan=2)
    with pytest.raises(ValueError):
        state.table("t")
    most = 0
    for b in range(9):
        state.add(b, _rows(spark, ("a", 1), ("a", b), ("gone", 1 if b % 2 else -1)))
        most = max(most, len(os.listdir(tmp_path / "s")))
        assert _sums(state).get("a") == sum(1 + x for x in range(b + 1))
    assert state.cover() == [(0, 7), (8, 8)] and most <= 7  # not one a batch
    assert _sums(state)["gone"] == -1
    state.add(9, _rows(spark, ("gone", 1)))
    assert "gone" not in _sums(state) and state.cover() == [(0, 7), (8, 9)]


def test_batches_that_are_run_again(spark, tmp_path):
    state = SummedTables(spark, str(tmp_path / "s"), TABLES, fan=2)
    for b in range(4):
        state.add(b, _rows(spark, ("a", 1)))
    for b in (3, 0):  # after the merge that took them in
        state.add(b, _rows(spark, ("a", 1)))
    assert _sums(state) == {"a": 4}
    # A run that was lost after it had written its table, without a marker, is replaced.
    _rows(spark, ("a", 50))["t"].write.parquet(str(tmp_path / "s" / "segment-4-4" / "t"))
    assert _sums(state) == {"a": 4}
    state.add(4, _rows(spark, ("a", 1)))
    # So is a merge that was lost.
    _rows(spark, ("a", 50))["t"].write.parquet(str(tmp_path / "s" / "segment-4-5" / "t"))
    state.add(5, _rows(spark, ("a", 1)))
    assert _sums(state) == {"a": 6} and state.cover() == [(0, 3), (4, 5)]
    # A reader that began before a merge ends after it.
    before = state.table("t")
    for b in (6, 7):
        state.add(b, _rows(spark, ("b", 1)))
    assert before.collect()[0]["n"] == 6 and _sums(state) == {"a": 6, "b": 2}


def _event(minute, kind="x", value=1.5):
    return (None if minute is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute), kind, value)


def test_windows_of_late_events(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[_event(1), _event(61)], [_event(2), _event(None)], [], [_event(3, value=None), _event(4, None)]]
    state = WindowState(spark, str(tmp_path / "s"), "1 hour", fan=2)
    for b, rows in enumerate(batches):
        state.add(spark.createDataFrame(rows, schema), b)
    got = {(r["start"].hour, r["event_type"]): (r["n"], float(r["total"])) for r in state.windows().collect()}
    assert got == {(0, "x"): (3, 3.0), (1, "x"): (1, 1.5), (0, None): (1, 1.5)}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="another stream"):
        state.start(stream, str(tmp_path / "none"))


def test_watermark_drops_what_is_too_late(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    (tmp_path / "in").mkdir()
    seen = []
    for b, rows in enumerate([[_event(1), _event(200)], [_event(2), _event(195)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windowed_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes", "5 minutes")
        out = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.select(F.minute("window.start").alias("m"), "n").collect()))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, seen)) == [(0, 1), (15, 1), (20, 1)]  # the event of minute 2 came after 190


def test_what_is_dealt_out_is_added_up_after_that(spark, tmp_path):
    """Segments whose keys differ are not added up within the tasks that read them, which would take memory for each row; and a reader that adds up itself gets them as they are."""
    tables, path = {"t": (["k", "p"], ["n"])}, str(tmp_path / "s")
    state = SummedTables(spark, path, tables, fan=8, dealt={"t": ["k"]})
    for b in range(2):
        state.add(b, {"t": spark.createDataFrame([("a", 1, 1), ("a", 1, b), ("a", 2, 1 - 2 * b)], "k string, p long, n long")})
    plan = state.table("t")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan.split("Exchange", 1)[1] and plan.count("Exchange") == 1
    assert [tuple(r) for r in state.table("t").collect()] == [("a", 1, 3)]
    assert sorted(map(tuple, state.parts("t").collect())) == [("a", 1, 1), ("a", 1, 2), ("a", 2, -1), ("a", 2, 1)]
