"""Streams against their batch equivalents."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from liftspark.operators import features as FT
from liftspark.plans import hourly, marts
from liftspark.sources import tables
from liftspark.streaming import cooldown, ingest, sinks, windows

START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def activity(spark, bench, folder):
    """The events as four files in order of time."""
    events = bench.raw.table("events").select(
        F.format_string("vid_%06d", "user_id").alias("video_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
    )
    for i in range(4):
        low, high = START + dt.timedelta(days=8 * i), START + dt.timedelta(days=8 * i + 8)
        part = events.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return events


@pytest.mark.parametrize(
    "job, read", [(windows.stream_hourly, windows.read_hourly), (windows.stream_velocity, windows.read_velocity)]
)
def test_windows_equal_batch(spark, activity, folder, job, read):
    table, progress = f"{folder}/out", f"{folder}/progress"
    stream = sinks.file_stream(spark, f"{folder}/in", activity.schema, files_per_batch=1)
    result = job(stream, "3 days")
    want = job(activity)

    def is_right():
        got = read(spark, table, progress, result)
        return got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0

    assert read(spark, table, progress, result).count() == 0
    assert sinks.write_final(result, table, progress) == 0
    assert is_right()
    closed = sinks.read_final(spark, table, result.schema)
    assert 0 < closed.count() < want.count()
    # Reading ranks nothing and reads each window once.
    assert "Window" not in read(spark, table, progress, result)._jdf.queryExecution().executedPlan().toString()
    # A batch whose rows were stored but whose end was not noted runs again.
    commits = sorted(pathlib.Path(progress, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    sinks.write_final(result, table, progress)
    assert is_right()


def test_late_rows_are_counted(spark, folder):
    schema = "video_id string, ts timestamp, event_type string, value double"
    hour = lambda h: ("v", START + dt.timedelta(hours=h), "view", 1.0)
    # A batch is measured against the watermark of the batch before.
    for rows in ([hour(0), hour(200)], [hour(201)], [hour(202), hour(1), hour(2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = sinks.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    late = sinks.write_final(windows.stream_hourly(stream), f"{folder}/out", f"{folder}/progress")
    assert late == 2


def test_velocity_by_clock_equals_rows_without_gaps(spark):
    rows = [("v", START + dt.timedelta(hours=h), "view", float(h)) for h in range(30)]
    activity = spark.createDataFrame(
        rows, "video_id string, ts timestamp, event_type string, value double"
    )
    hourly = windows.stream_hourly(activity).select(
        "video_id",
        "hour",
        F.expr("timestampdiff(HOUR, timestamp'2024-01-01', hour)").cast("int").alias(
            "hours_since_post"
        ),
        F.col("views").alias("views_delta_1h"),
        F.col("saves").alias("saves_delta_1h"),
        F.col("shares").alias("shares_delta_1h"),
    )
    by_rows = hourly.withColumns(FT.velocity_columns()).select("hour", "views_velocity_3h")
    by_clock = windows.stream_velocity(activity).select("hour", "views_velocity_3h")
    assert by_rows.exceptAll(by_clock).count() == 0


def test_ingest_is_idempotent_and_keeps_late_rows(spark, bench, folder):
    events = tables.stage(bench.raw.events, "events")
    late = F.col("hours_since_post") < 50
    for part in (events.filter(~late), events.filter(late), events.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    root = f"{folder}/root"
    ingest.stream_ingest(spark, f"{folder}/in", root, f"{folder}/p1", files_per_batch=1, horizon=720)
    stored = hourly.read(spark, root, "engagement_events")
    assert stored.count() == events.count()
    ingest.stream_ingest(spark, f"{folder}/in", root, f"{folder}/p2", horizon=720)  # everything again
    stored = hourly.read(spark, root, "engagement_events")
    assert stored.exceptAll(events).count() == 0 and events.exceptAll(stored).count() == 0


def test_refresh_equals_full_rebuild(spark, bench, folder):
    events = tables.stage(bench.raw.events, "events")
    root = f"{folder}/root"
    hourly.store(spark, root, "video_sku_bridge", bench.raw.bridge)
    hourly.store(spark, root, "sku_catalog", bench.raw.skus)
    late = F.col("hours_since_post").between(100, 300)
    for part in (events.filter(~late), events.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ingest.stream_refresh(
        spark, f"{folder}/in", root, f"{folder}/progress", bench.as_of, files_per_batch=1, horizon=720
    )
    got = hourly.read(spark, root, "mart_videos").drop(hourly.DAY)
    want = bench.videos.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    rows = hourly.read(spark, root, "engagement_features").drop(hourly.DAY)
    assert rows.exceptAll(bench.features.select(*rows.columns)).count() == 0
    assert rows.count() == events.count()


def test_cooldown_against_brute_force(spark, folder):
    """Greedy thinning per SKU over all hourly cycles, in several batches."""
    rng = random.Random(5)
    skus = ["hot"] * 8 + ["a", "b", "c"]
    schema = "sku_id string, created_at timestamp, p90_demand_lift double"
    everything = []
    for part in range(3):
        # A batch reaches two hours back into the one before.
        rows = [
            (
                rng.choice(skus),
                START + dt.timedelta(minutes=part * 1440 + rng.randrange(-120, 1440)),
                float(rng.randrange(10)),
            )
            for _ in range(120)
        ]
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = sinks.file_stream(
        spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1
    )
    late = cooldown.run_cooldown(stream, f"{folder}/out", f"{folder}/home", hours=4, lateness="3 hours")
    closed = [tuple(r) for r in cooldown.read_alerts(spark, f"{folder}/out").collect()]
    due = [tuple(r) for r in cooldown.read_due(spark, f"{folder}/out", f"{folder}/home", hours=4).collect()]
    got = set(closed + due)
    assert late == 0 and closed and due and len(got) == len(closed) + len(due)
    best = {}
    for sku, t, lift in everything:
        key = (sku, t.replace(minute=0))
        best[key] = max(best.get(key, lift), lift)
    last, want = {}, set()
    for (sku, cycle), lift in sorted(best.items(), key=lambda x: x[0][1]):
        if sku not in last or cycle - last[sku] >= dt.timedelta(hours=4):
            last[sku] = cycle
            want.add((sku, cycle, lift))
    assert got == want


def test_cooldown_goes_on_and_counts_late_rows(spark, folder):
    schema = "sku_id string, created_at timestamp, p90_demand_lift double"
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [[("a", at(0), 1.0), ("a", at(1), 1.0)], [("a", at(9), 2.0)], [("a", at(2), 9.0), ("a", at(12), 3.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = sinks.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        late = cooldown.run_cooldown(stream, f"{folder}/out", f"{folder}/home", hours=4)
    assert late == 1
    got = sorted(tuple(r) for r in cooldown.read_alerts(spark, f"{folder}/out").collect())
    assert got == [("a", at(0), 1.0), ("a", at(9), 2.0)]  # hour 12 is still open


def test_cooldown_forgets_skus_whose_pause_is_over(spark, folder):
    """Rows without SKU or time are left out, a missing lift is the least, old SKUs leave the state."""
    schema = "sku_id string, created_at timestamp, p90_demand_lift double"
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [("a", at(0), None), ("b", at(0), None), ("b", at(0), 2.0), (None, at(0), 5.0), ("c", None, 5.0)],
        [("b", at(30), 1.0), ("b", at(30), 1.0)],
        [("a", at(31), 4.0), ("b", at(33), 9.0), ("c", at(40), 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = sinks.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        assert cooldown.run_cooldown(stream, f"{folder}/out", f"{folder}/home", hours=4) == 0
    closed = {tuple(r) for r in cooldown.read_alerts(spark, f"{folder}/out").collect()}
    assert closed == {("a", at(0), None), ("b", at(0), 2.0), ("b", at(30), 1.0), ("a", at(31), 4.0)}
    due = cooldown.read_due(spark, f"{folder}/out", f"{folder}/home", hours=4)
    assert [tuple(r) for r in due.collect()] == [("c", at(40), 1.0)]
    held = sinks.open_state(spark, f"{folder}/out", f"{folder}/home", "transformWithStateInPySparkExec", "last")
    assert held.count() == 0  # the watermark, hour 39, is past all pauses
    assert cooldown.read_alerts(spark, f"{folder}/none").count() == 0
    assert cooldown.read_due(spark, f"{folder}/none", f"{folder}/home2").count() == 0


def test_late_marts_do_not_need_streams(bench):
    """The batch mart and the mart of latest feature rows agree."""
    a = marts.scored_videos(FT.latest_snapshot(bench.features), bench.as_of)
    b = bench.videos.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _arrivals(spark, bench, folder, *batches):
    """Event files from (id, hours after the start, hours since the post); one file a batch."""
    names = bench.raw.events.columns
    for i, rows in enumerate(batches):
        given = spark.createDataFrame(
            [(k, None if h is None else START + dt.timedelta(hours=h), since) for k, h, since in rows],
            "event_id string, snapshot_at timestamp, hours_since_post int",
        ).withColumns({"video_id": F.lit("v"), "posted_at": F.lit(START).cast("timestamp")})
        types = {f.name: f.dataType for f in ingest.schemas.ENGAGEMENT_EVENTS.fields}
        full = given.select(*[F.col(c) if c in given.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
        full.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _stored_and_apart(spark, root):
    stored = sorted(r.event_id for r in hourly.read(spark, root, "engagement_events").collect())
    path = hourly._path(root, "quarantined_events")
    if not tables.path_exists(spark, path):
        return stored, []
    apart = hourly.read(spark, root, "quarantined_events").collect()
    return stored, sorted((r.event_id or "", r.reason) for r in apart)


def test_repeated_events_are_stored_once_and_late_ones_set_apart(spark, bench, folder):
    batches = [
        [("a", 0, 0), ("a", 0, 0), ("b", 1, 1), ("far", 2, 9999), (None, 3, 3), ("untimed", None, 3)],
        [("a", 0, 0), ("c", 300, 9), ("far", 2, 9999), (None, 3, 3)],
        [("d", 301, 10), ("c", 300, 9)],
        [("a", 0, 0), ("late", 5, 5), ("late", 5, 5), ("e", 302, 11), ("far", 2, 9999)],
    ]
    for batch in batches:
        _arrivals(spark, bench, folder, batch)
        ingest.stream_distinct(spark, f"{folder}/in", folder, f"{folder}/progress", "1 day")
    want = (
        ["a", "b", "c", "d", "e"],
        [("", "no_key"), ("far", "beyond_horizon"), ("late", "late"), ("untimed", "no_time")],
    )
    assert _stored_and_apart(spark, folder) == want
    # The last batch runs again after its rows were stored.
    commits = sorted(pathlib.Path(folder, "progress", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for last in commits[-2:]:
        for file in (last, last.with_name(f".{last.name}.crc")):
            file.unlink(missing_ok=True)
    ingest.stream_distinct(spark, f"{folder}/in", folder, f"{folder}/progress", "1 day")
    assert _stored_and_apart(spark, folder) == want


def test_one_batch_with_repeats(spark, bench, folder):
    _arrivals(spark, bench, folder, [(f"k{i % 7}", i % 7, i % 7) for i in range(50)])
    ingest.stream_distinct(spark, f"{folder}/in", folder, f"{folder}/progress")
    assert _stored_and_apart(spark, folder) == ([f"k{i}" for i in range(7)], [])
