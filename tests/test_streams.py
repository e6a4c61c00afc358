"""Streams that answer while they run: several batches, late rows, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partwright.bindings import all_queries
from partwright.plans import review
from partwright.streaming import reviews, runs, zones

READING = "zone_id long, ts timestamp, reading_id long, status string, load double"


@pytest.fixture(scope="module")
def batches():
    """Readings of three batches; later ones hold readings of earlier windows, and nulls."""
    r = random.Random(1)
    begin = datetime(2024, 5, 1)
    rows = []
    for k in range(240):
        status = r.choice(["online", "offline", "offline", "warning"])
        rows.append((r.choice([1, 1, 1, 2, 3]), begin + timedelta(milliseconds=r.randint(0, 90_000)), k, status, r.choice([None, 10.0, 55.5, 70.25, 200.0])))
    rows.sort(key=lambda x: x[1])
    late = rows[5:60:6]
    first = [x for x in rows[:120] if x not in late]
    return [first, rows[120:180] + late[:5] + rows[10:12], rows[180:] + late[5:]]


def in_batches(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))
        for f in (folder / f"part{k}").glob("*.parquet"):
            f.rename(folder / f"{k}.parquet")


def batch_form(spark, rows):
    return sorted(map(str, zones.hold_last(zones.window_loads(spark.createDataFrame(rows, READING))).collect()))


def test_loads_after_each_batch_and_a_restart(spark, tmp_path, batches):
    source, base, seen = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    for k, rows in enumerate(batches):
        seen += rows
        spark.createDataFrame(rows, READING).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(source / f"{k}.parquet")
        # Each turn is a new query that goes on from the checkpoint of the one before.
        stream = runs.source(spark, str(source), "?.parquet", spark.createDataFrame([], READING).schema, files_per_batch=1)
        got = zones.load_stream(stream, base).select("zone_id", "window_ms", "status", "load")
        assert sorted(map(str, got.collect())) == batch_form(spark, seen)


def test_loads_of_one_run_and_of_no_rows(spark, tmp_path, batches):
    in_batches(spark, tmp_path, batches)
    schema = spark.createDataFrame([], READING).schema
    stream = runs.source(spark, str(tmp_path), "?.parquet", schema, files_per_batch=1)
    want = batch_form(spark, [x for rows in batches for x in rows])
    assert sorted(map(str, zones.load_stream(stream).select("zone_id", "window_ms", "status", "load").collect())) == want
    assert zones.load_stream(runs.source(spark, str(tmp_path), "none", schema)).count() == 0


def test_windows_behind_the_watermark_are_closed(spark, tmp_path, batches):
    rows = sorted((x for part in batches for x in part), key=lambda x: x[1])
    in_batches(spark, tmp_path, [rows[:80], rows[80:160], rows[160:]])
    stream = runs.source(spark, str(tmp_path), "?.parquet", spark.createDataFrame([], READING).schema, files_per_batch=1)
    base = str(tmp_path / "out")
    got = zones.load_stream(stream, base, late="1 second").select("zone_id", "window_ms", "status", "load")
    assert sorted(map(str, got.collect())) == batch_form(spark, rows)
    state = spark.read.format("statestore").option("stateVarName", "windows").load(base + "/state")
    assert state.count() < len({(x[0], x[1].timestamp() // 3.5) for x in rows}) / 2


def test_findings_appear_per_batch_and_once(spark, tmp_path):
    all_queries()
    from partwright.bindings import stream_queries as sq

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(90)
    source, base, seen = tmp_path / "in", str(tmp_path / "out"), None
    source.mkdir()
    parts = ["event_id % 3 = 0", "event_id % 3 = 1 or event_id % 9 = 0", "event_id % 3 = 0"]
    for k, part in enumerate(parts):
        events.where(part).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(source / f"{k}.parquet")
        stream = runs.source(spark, str(source), "?.parquet", events.schema, files_per_batch=1)
        found = reviews.review_stream(spark, sq.as_submissions(stream), base)
        seen = part if seen is None else f"({seen}) or ({part})"
        want = review.drawing_findings(spark, sq.as_submissions(events.where(seen)))
        assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    given = runs.reader(spark, base)("findings", want.schema)
    assert {r.batch for r in given.select("batch").distinct().collect()} == {0, 1}
    assert given.groupBy(*want.columns).agg(F.count("*").alias("n")).where("n > 1").count() == want.groupBy(*want.columns).agg(F.count("*").alias("n")).where("n > 1").count()


def test_a_span_is_what_a_task_holds_and_loads_go_on_across_spans(spark, tmp_path):
    begin, span = datetime(2024, 5, 1), timedelta(milliseconds=zones.SPAN_MS)
    at = lambda k, seconds: begin + k * span + timedelta(seconds=seconds)
    # One zone: a load, spans that are only offline, a late load in between, and windows that straddle the spans' borders.
    first = [(1, at(0, 1), 1, "online", 50.0), (1, at(0, 9), 2, "offline", 60.0), (1, at(1, 0), 3, "offline", 60.0), (1, at(3, 0), 4, "warning", None), (1, at(5, 1), 5, "online", 70.0)]
    second = [(1, at(1, 30), 6, "online", 80.0), (1, at(3, -1), 7, "offline", None), (1, at(5, 0), 8, "offline", None), (1, None, 9, "online", 90.0)]
    source = tmp_path / "in"
    source.mkdir()
    in_batches(spark, source, [first, second])
    schema = spark.createDataFrame([], READING).schema
    for late in (None, "4 days"):
        base = str(tmp_path / f"out{late is None}")
        got = zones.load_stream(runs.source(spark, str(source), "?.parquet", schema, files_per_batch=1), base, late)
        assert sorted(map(str, got.select("zone_id", "window_ms", "status", "load").collect())) == batch_form(spark, first + second)
        state = spark.read.format("statestore").option("stateVarName", "windows").load(base + "/state")
        assert state.groupBy("key").count().count() >= 4


def test_closed_spans_leave_the_state(spark, tmp_path):
    rows = [(1, datetime(2024, 5, 1) + timedelta(hours=h), h, "online" if h % 5 else "offline", 40.0 + h) for h in range(48)]
    in_batches(spark, tmp_path, [rows[:16], rows[16:32], rows[32:]])
    base = str(tmp_path / "out")
    got = zones.load_stream(runs.source(spark, str(tmp_path), "?.parquet", spark.createDataFrame([], READING).schema, files_per_batch=1), base, "1 hour")
    assert sorted(map(str, got.select("zone_id", "window_ms", "status", "load").collect())) == batch_form(spark, rows)
    for name in ("windows", "closed"):
        assert spark.read.format("statestore").option("stateVarName", name).load(base + "/state").select("key").distinct().count() <= 2
