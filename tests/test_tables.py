"""Upsert, ingestion, review, throttling, quality and the hourly run."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark import schemas
from liftspark.operators import alerts as A
from liftspark.operators import ingest, maintenance, quality, scoring, serving
from liftspark.plans import hourly, marts
from liftspark.sources import stored, tables, upsert

NOW = dt.datetime(2024, 2, 1)


def at(hours: float) -> dt.datetime:
    return NOW + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], base.schema)
    got = upsert.upsert(base, new, ["k"], [F.col("t").desc()])
    assert rows_of(got) == [("a", 1, 0), ("b", 4, 2), ("c", 5, 1)]


KVD = "k string, v int, day date"
D1, D2, D3 = (dt.date(2024, 1, i) for i in (1, 2, 3))


def kvd(spark, *rows):
    return spark.createDataFrame(list(rows), KVD)


def put(spark, path, *rows):
    stored.upsert(spark, path, kvd(spark, *rows), ["k"], [F.col("v").desc()], "day")


def read_kvd(spark, path, **days):
    return stored.read(spark, path, kvd(spark).schema, "day", **days)


def test_stored_upsert_writes_touched_days_only(spark, folder):
    path = f"{folder}/t"
    put(spark, path, ("a", 1, D1), ("b", 2, D2), ("c", 3, D2))
    untouched = stored.live(spark, path)[str(D1)]
    for _ in range(2):  # the second time changes nothing
        put(spark, path, ("b", 8, D2), ("b", 9, D2), ("e", 5, D3))
        want = [("a", 1, D1), ("b", 9, D2), ("c", 3, D2), ("e", 5, D3)]
        assert rows_of(read_kvd(spark, path)) == want
    assert stored.live(spark, path)[str(D1)] == untouched
    assert rows_of(read_kvd(spark, path, days=[D1, D3])) == [("a", 1, D1), ("e", 5, D3)]
    assert rows_of(read_kvd(spark, path, between=(D2, D3)).select("k")) == [("b",), ("c",), ("e",)]


def test_empty_batches_and_absent_tables(spark, folder):
    path = f"{folder}/t"
    assert not stored.exists(spark, path) and read_kvd(spark, path).count() == 0
    put(spark, path)
    put(spark, path, ("a", 1, D1))
    put(spark, path)
    assert rows_of(read_kvd(spark, path)) == [("a", 1, D1)]


def test_a_write_that_breaks_off_loses_nothing(spark, folder):
    path = f"{folder}/t"
    put(spark, path, *[(f"k{i}", i, D1) for i in range(100)])
    broken = kvd(spark, ("x", 1, D1)).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        stored.publish(spark, path, broken, "day", [D1])
    # Data without a log entry, and a log entry that was not given its name.
    kvd(spark, ("y", 1, D1)).write.partitionBy("day").parquet(f"{path}/data/stored_version=half")
    pathlib.Path(path, "_log", ".unfinished").write_text("{")
    assert read_kvd(spark, path).count() == 100
    put(spark, path, *[(f"n{i}", i, D1) for i in range(5)])
    assert read_kvd(spark, path).count() == 105


def test_a_second_writer_fails_and_changes_nothing(spark, folder):
    path = f"{folder}/t"
    number = stored.next_number(spark, path)
    put(spark, path, ("a", 1, D1))
    with pytest.raises(stored.Conflict, match="is there already"):
        stored.publish(spark, path, kvd(spark, ("b", 1, D1)), "day", number=number)
    assert rows_of(read_kvd(spark, path)) == [("a", 1, D1)]


def test_read_errors_are_not_absence(spark, folder):
    path = f"{folder}/t"
    put(spark, path, ("a", 1, D1))
    for file in pathlib.Path(path, "_log").iterdir():
        file.write_bytes(b"broken")
    with pytest.raises(Exception):
        put(spark, path, ("b", 1, D1))


def test_vacuum_keeps_what_is_needed(spark, folder):
    path = f"{folder}/t"
    for i in range(5):
        put(spark, path, ("a", i, D1), (f"k{i}", 0, dt.date(2024, 2, 1 + i)))
    before = rows_of(read_kvd(spark, path))
    assert stored.vacuum(spark, path, keep=2) > 0
    assert len(stored.entries(spark, path)) == 2 and rows_of(read_kvd(spark, path)) == before
    assert stored.vacuum(spark, path, keep=2) == 0


def test_scratch_is_removed(spark):
    with tables.scratch(spark):
        path = tables.stage(spark.range(3), "gone").inputFiles()[0]
        assert tables.path_exists(spark, path)
    assert not tables.path_exists(spark, path)


def test_next_hour(spark):
    videos = spark.createDataFrame([("new",), ("run",), ("done",)], "video_id string")
    events = spark.createDataFrame(
        [("run", 0), ("run", 5), ("done", 47)], "video_id string, hours_since_post int"
    )
    assert rows_of(ingest.next_hour(videos, events)) == [("new", 0), ("run", 6)]


def test_bridge_skips_malformed(spark):
    videos = spark.createDataFrame(
        [("v1", '["A","B"]', "tiktok", NOW), ("v2", "nope", "tiktok", NOW)],
        "video_id string, sku_ids_json string, platform string, posted_at timestamp",
    )
    assert [(r.video_id, r.sku_id) for r in ingest.explode_bridge(videos).collect()] == [
        ("v1", "A"),
        ("v1", "B"),
    ]


def alert_rows(spark, rows):
    df = spark.createDataFrame(rows, "alert_id string, sku_id string, risk_tier string")
    return tables.with_alert_defaults(df, F.lit(NOW))


def test_review_states(spark):
    alerts = alert_rows(spark, [("a1", "s", "CRITICAL"), ("a2", "s", "WARNING"), ("a3", "t", "WATCH")])
    decisions = spark.createDataFrame(
        [
            ("d1", "a1", "approve", "kim", at(1)),
            ("d2", "a1", "approve", "lee", at(2)),
            ("d3", "a2", "dismiss", "kim", at(1)),
            ("d4", "zz", "approve", "kim", at(1)),
        ],
        "decision_id string, alert_id string, decision string, approved_by string,"
        " decided_at timestamp",
    )
    outcomes = {r.decision_id: r.outcome for r in A.decision_outcomes(alerts, decisions).collect()}
    assert outcomes == {
        "d1": "success",
        "d2": "not_pending",
        "d3": "success",
        "d4": "not_found",
    }
    after = {r.alert_id: r for r in A.apply_decisions(alerts, decisions).collect()}
    assert (after["a1"].status, after["a1"].approved_by) == ("APPROVED", "kim")
    assert after["a1"].approved_at == after["a1"].updated_at == at(1)
    assert (after["a2"].status, after["a2"].approved_by) == ("DISMISSED", None)
    assert after["a3"].status == "PENDING" and after["a3"].updated_at == NOW
    counts = A.alert_counts(A.apply_decisions(alerts, decisions)).first()
    assert (counts.pending, counts.approved) == (1, 1)
    again = A.decision_outcomes(A.apply_decisions(alerts, decisions), decisions)
    assert {r.outcome for r in again.collect()} == {"not_pending", "not_found"}


DECISIONS = (
    "decision_id string, alert_id string, decision string, approved_by string, decided_at timestamp"
)


def test_stored_review(spark, folder):
    stored.append(spark, f"{folder}/agent_alerts", alert_rows(spark, [("a1", "s", "CRITICAL"), ("a2", "s", "WARNING")]))
    decisions = spark.createDataFrame([("d1", "a1", "approve", "kim", at(1))], DECISIONS)
    assert [r.outcome for r in hourly.review(spark, folder, decisions).collect()] == ["success"]
    # Alerts raised meanwhile stay, and a later decision with an earlier time changes nothing.
    stored.append(spark, f"{folder}/agent_alerts", alert_rows(spark, [("a3", "t", "WARNING")]))
    late = spark.createDataFrame([("d0", "a1", "dismiss", "lee", at(0)), ("d2", "a3", "dismiss", "lee", at(2))], DECISIONS)
    outcomes = {r.decision_id: r.outcome for r in hourly.review(spark, folder, late).collect()}
    assert outcomes == {"d0": "not_pending", "d2": "success"}
    assert [r.outcome for r in hourly.review(spark, folder, decisions).collect()] == ["not_pending"]
    states = {r.alert_id: r.status for r in hourly.read_alerts(spark, folder).collect()}
    assert states == {"a1": "APPROVED", "a2": "PENDING", "a3": "DISMISSED"}


def test_cap_counts_stored_alerts(spark):
    df = tables.with_alert_defaults(
        spark.createDataFrame([(f"a{i}", f"s{i}", "CRITICAL", float(i)) for i in range(6)],
                              "alert_id string, sku_id string, risk_tier string, p90_demand_lift double"),
        F.lit(NOW),
    )
    stored_alerts = df.limit(2)
    new = df.join(stored_alerts.select("alert_id"), "alert_id", "left_anti")
    got = {r.alert_id: r.status for r in A.suppress_beyond_cap(new, stored_alerts, 4).collect()}
    assert len(got) == 4 and sorted(got.values()) == ["PENDING"] * 2 + ["SUPPRESSED"] * 2
    assert A.suppress_beyond_cap(new, stored_alerts, 1).filter("status = 'PENDING'").count() == 0


def test_cooldown_against_brute_force(spark):
    rng = random.Random(3)
    skus = ["hot"] * 6 + [f"s{i}" for i in range(8)]

    def times(n):
        return [(rng.choice(skus), at(rng.randrange(0, 60 * 4) / 4)) for _ in range(n)]

    cands, past = times(150), times(80)
    schema = "sku_id string, created_at timestamp"
    got = A.cooldown(
        spark.createDataFrame(cands, schema), spark.createDataFrame(past, schema), hours=4
    )
    want = [
        (s, t)
        for s, t in cands
        if not any(s == x and u <= t and (t - u).total_seconds() < 4 * 3600 for x, u in past)
    ]
    assert 0 < len(want) < len(cands)
    assert rows_of(got) == sorted(want)


def test_cap_per_hour(spark):
    rows = [(f"s{i:03d}", "WARNING" if i % 2 else "CRITICAL", float(i % 5), at(i % 2)) for i in range(90)]
    df = spark.createDataFrame(
        rows, "sku_id string, risk_tier string, p90_demand_lift double, created_at timestamp"
    )
    got = A.cap_per_hour(df, 20).collect()
    for hour in (0, 1):
        pool = [r for r in rows if r[3] == at(hour)]
        pool.sort(key=lambda r: (r[1] != "CRITICAL", -r[2], r[0]))
        assert {r.sku_id for r in got if r.created_at == at(hour)} == {r[0] for r in pool[:20]}


def test_deplete_and_drift(spark):
    df = spark.createDataFrame(
        [("a", 5, 7.4), ("b", 10, 2.5), ("c", 10, 3.5)],
        "sku_id string, current_stock int, baseline_daily_demand double",
    )
    assert [r.current_stock for r in maintenance.deplete(df).collect()] == [0, 8, 6]
    once = maintenance.drift(df, 1).collect()
    assert once == maintenance.drift(df.repartition(3), 1).orderBy("sku_id").collect()
    for before, after in zip(df.collect(), once):
        change = after.baseline_daily_demand / before.baseline_daily_demand
        assert 0.93 <= change <= 1.07


GOOD_SKU = ("SKU-0001", "x", "beauty", 29.99, 50.0, 300, 14, 200, 2.5, NOW)


@pytest.mark.parametrize(
    "column, value",
    [("unit_price_usd", -1.0), ("baseline_daily_demand", 0.0), ("viral_sensitivity", 10.0)],
)
def test_sku_rules(spark, column, value):
    df = spark.createDataFrame([GOOD_SKU], schemas.SKU_CATALOG)
    good, bad = quality.validate(df, quality.sku_rules())
    assert good.count() == 1 and bad.count() == 0
    _, bad = quality.validate(df.withColumn(column, F.lit(value)), quality.sku_rules())
    assert bad.first().reasons == [column]


def test_video_without_sku(spark):
    df = spark.createDataFrame(
        [("v", "tiktok", "c", "nano", NOW, 30, True, "[]", "[]", False)], schemas.VIDEO_METADATA
    )
    _, bad = quality.validate(df, quality.video_rules())
    assert bad.first().reasons == ["sku_ids"]


@pytest.mark.parametrize(
    "column, value, reasons",
    [
        ("snapshot_at", at(-9999), ["snapshot_after_post"]),
        ("save_rate", 1.5, ["save_rate"]),
        ("view_count", -1, ["view_count"]),
        ("demand_lift_24h", None, None),
        ("trending_rank", None, None),
        ("trending_rank", 5, None),
    ],
)
def test_event_rules(spark, column, value, reasons):
    event = dict.fromkeys(schemas.ENGAGEMENT_EVENTS.names, 0)
    event.update({c: 0.1 for c in event if c.endswith(("_rate", "_velocity"))})
    event.update({c: True for c in ("has_link_in_bio", "is_on_foryou", "is_viral")})
    event.update(
        event_id="e", video_id="v", creator_id="c", platform="tiktok", creator_tier="micro"
    )
    event.update(posted_at=NOW, snapshot_at=at(3), hours_since_post=3, demand_lift_24h=4.2)
    event.update(sku_ids_json='["SKU-0042","SKU-0119"]', region_codes_json="[]")
    df = spark.createDataFrame([event], schemas.ENGAGEMENT_EVENTS)
    df = df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))
    _, bad = quality.validate(df, quality.event_rules())
    assert [r.reasons for r in bad.collect()] == ([reasons] if reasons else [])


def test_quarantine_splits_the_whole(bench):
    good, bad = quality.validate(bench.raw.events, quality.event_rules())
    assert good.count() + bad.count() == bench.raw.events.count()


def test_report_severity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y")], "k string, v string")
    report = quality.report(
        {
            "t": [
                quality.check_unique(df, "k"),
                quality.check_not_null(df, ["k"]),
                quality.check_accepted(df, {"v": ["x"]}),
            ]
        }
    )
    got = {(r.check, r.failures, r.severity, r.status) for r in report.collect()}
    assert got == {
        ("unique", 1, "error", "error"),
        ("not_null", 1, "error", "error"),
        ("accepted_values", 1, "warn", "warn"),
    }


@pytest.mark.parametrize("age, status", [(1, "pass"), (25, "warn"), (73, "error")])
def test_freshness(spark, age, status):
    df = spark.createDataFrame([(at(0),), (at(-50),)], "snapshot_at timestamp")
    assert quality.check_freshness(df, F.lit(at(age))).first().status == status


def test_serving_filters(spark):
    queue = spark.createDataFrame(
        [("a", "PENDING", "CRITICAL"), ("b", "APPROVED", "CRITICAL"), ("c", "PENDING", "WARNING")],
        "alert_id string, status string, alert_risk_tier string",
    )
    assert serving.list_alerts(queue).count() == 3
    assert [r.alert_id for r in serving.list_alerts(queue, "pending", "critical").collect()] == ["a"]
    response = serving.to_response(alert_rows(spark, [("a1", "s", "WATCH")])).first()
    assert response.created_at == "2024-02-01T00:00:00Z"
    assert response.approved_at == "" and response.approved_by is None


def test_unscored_is_a_difference(spark):
    videos = spark.createDataFrame(
        [("v1", "e2"), ("v2", "e5")], "video_id string, latest_event_id string"
    )
    known = spark.createDataFrame([("v1", "e1"), ("v2", "e5")], videos.schema)
    assert [r.video_id for r in scoring.unscored(videos, known).collect()] == ["v1"]


def test_alert_state_in_risk_mart(spark, bench):
    from liftspark.plans import catalog

    rows = catalog.sku_risk_alerted(bench).filter("latest_alert_id IS NOT NULL").collect()
    assert rows and {r.alert_status for r in rows} <= set(C.ALERT_STATUSES)


def test_ingestion_keeps_every_hour(spark, bench, folder):
    """Several hours at once, a gap, a late hour, a correction, hours beyond the horizon."""
    video = bench.raw.events.orderBy("video_id").first().video_id
    one = bench.raw.events.filter(F.col("video_id") == video).limit(1)

    def snapshots(*hours, views=1):
        rows = one.crossJoin(spark.createDataFrame([(h,) for h in hours], "h int"))
        return rows.withColumns(
            {
                "hours_since_post": F.col("h"),
                "event_id": F.format_string("e%03d", "h"),
                "snapshot_at": F.col("posted_at") + F.make_dt_interval(hours=F.col("h")),
                "view_count": F.lit(views).cast("long"),
            }
        ).drop("h")

    for batch in (snapshots(0, 1, 2), snapshots(1, views=7), snapshots(5, 6, 47, 48, -1), snapshots(3)):
        hourly.ingest_batch(spark, folder, batch)
    kept = hourly.read(spark, folder, "engagement_events")
    assert {(r.hours_since_post, r.view_count) for r in kept.collect()} == {
        (0, 1), (1, 7), (2, 1), (3, 1), (5, 1), (6, 1), (47, 1)
    }
    apart = hourly.read(spark, folder, "quarantined_events").select("hours_since_post", "reason")
    assert rows_of(apart) == [(-1, "before_post"), (48, "beyond_horizon")]
    state = hourly.progress(spark, folder).first()
    assert (state.max_hour, state.stored_hours, state.missing_hours, state.is_finished) == (47, 7, 41, True)


def test_hourly_run(spark, bench, folder):
    """Hourly runs from an empty event table: the history, the newest hours, a repetition."""
    for name, df in (
        ("video_metadata", bench.raw.videos),
        ("video_sku_bridge", bench.raw.bridge),
        ("sku_catalog", bench.raw.skus),
    ):
        hourly.store(spark, folder, name, df)
    events = tables.stage(bench.raw.events, "events")
    newest = Window.partitionBy("video_id").orderBy(F.col("hours_since_post").desc())
    ranked = events.withColumn("n", F.row_number().over(newest))
    late = (F.col("n") == 4) & (F.abs(F.hash("video_id")) % 3 == 0)
    parts = [ranked.filter((F.col("n") > 1) & ~late), ranked.filter("n = 1"), ranked.filter(late), ranked.filter(late)]
    videos, total = bench.raw.videos.count(), 0
    for hour, part in enumerate(parts):
        part = part.drop("n")
        new = hourly.run_hourly(spark, folder, part, F.lit(at(hour)), throttle=hour > 0, horizon=720)
        total += new.count()
        stored_alerts = hourly.read_alerts(spark, folder)
        assert stored_alerts.count() == stored_alerts.select("alert_id").distinct().count()
    kept = hourly.read(spark, folder, "engagement_events")
    assert kept.exceptAll(events).count() == 0 and events.exceptAll(kept).count() == 0
    rows = hourly.read(spark, folder, "engagement_features").drop(hourly.DAY)
    assert rows.exceptAll(bench.features.select(*rows.columns)).count() == 0 and rows.count() == events.count()
    mart = tables.stage(hourly.read(spark, folder, "mart_videos").drop(hourly.DAY, "mart_refreshed_at"), "mart")
    assert mart.exceptAll(bench.videos.select(*mart.columns)).count() == 0 and mart.count() == videos
    predictions = hourly.read(spark, folder, "video_predictions")
    assert predictions.count() == videos  # the newest of each
    assert hourly.read(spark, folder, "prediction_history").count() > videos
    assert hourly.read_videos(spark, folder).filter("p90_demand_lift IS NULL").count() == 0
    risk = hourly.read(spark, folder, "mart_sku_risk")
    assert risk.count() == bench.raw.skus.count()
    expected = marts.risk_from_videos(bench.staged_skus, bench.raw.bridge, hourly.read_videos(spark, folder))
    same = ("sku_id", *C.LIFT_COLUMNS, "ml_risk_tier", "projected_stockout_days", "urgency_score")
    assert risk.select(*same).exceptAll(expected.select(*same)).count() == 0
    assert total > 0
    # The same run again raises nothing twice.
    before = hourly.read_alerts(spark, folder).count()
    again = hourly.raise_alerts(spark, folder, F.lit(at(0)))
    assert hourly.read_alerts(spark, folder).count() >= before and again.count() > 0
    ids = hourly.read_alerts(spark, folder).select("alert_id")
    assert ids.count() == ids.distinct().count()
    hourly.rebuild_videos(spark, folder, F.lit(at(2)))
    rebuilt = hourly.read(spark, folder, "mart_videos").select(*mart.columns)
    assert rebuilt.exceptAll(mart).count() == 0 and rebuilt.count() == videos
    assert hourly.rescore(spark, folder, F.lit(at(3))) == 0
    stock = bench.raw.skus.agg(F.sum("current_stock")).first()[0]
    hourly.refresh_catalog(spark, folder, seed=1)
    after = hourly.read(spark, folder, "sku_catalog")
    assert after.count() == bench.raw.skus.count()
    assert after.agg(F.sum("current_stock")).first()[0] < stock
    hourly.clean_up(spark, folder, keep=1)
    assert hourly.read(spark, folder, "engagement_events").count() == events.count()


def test_views_lists_and_counts(spark, folder):
    df = spark.createDataFrame([("v", ["A", "B"]), ("w", None)], "video_id string, sku_ids array<string>")
    coded = tables.encode_lists(df)
    assert rows_of(coded) == [("v", '["A","B"]'), ("w", "[]")]
    tables.as_view(coded, "coded")
    assert spark.table("coded").count() == 2
    counts = tables.row_counts({"a": df, "b": df.limit(1)})
    assert rows_of(counts) == [("a", 2), ("b", 1)]
    assert hourly.read_alerts(spark, folder).count() == 0
    assert hourly.read_alerts(spark, folder).columns == schemas.AGENT_ALERTS.names


def test_zero_view_first_rows_are_optional(spark):
    from liftspark.operators import staging

    df = spark.createDataFrame(
        [(0, 0, 1, 0, 1), (0, 5, 1, 0, 1), (1, 0, 1, 0, 1)],
        "hours_since_post int, view_count int, has_link_in_bio int, is_on_foryou int, is_viral int",
    )
    assert staging.stg_events(df, F.lit(NOW)).count() == 3
    kept = staging.stg_events(df, F.lit(NOW), drop_zero_hour0=True)
    assert kept.count() == 2 and kept.first().is_viral is True
