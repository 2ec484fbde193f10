"""SKU signal kept by changes against the signal over all videos; commits, appends, compaction."""

import datetime as dt
import pathlib
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from liftspark import schemas
from liftspark.operators import incremental as INC
from liftspark.operators import inventory, ranking
from liftspark.plans import hourly
from liftspark.sources import stored, tables

VIDEO = (
    "video_id string, posted_at timestamp, latest_event_id string, hours_since_post int, view_count int,"
    " engagement_score double, sku_viral_sensitivity double, is_viral boolean, sku_ids_json string,"
    " p10_demand_lift double, p50_demand_lift double, p90_demand_lift double, risk_tier_predicted string"
)
BRIDGE = "video_id string, sku_id string, platform string, posted_at timestamp"
NOW = dt.datetime(2024, 2, 1)


def day(i):
    return dt.datetime(2024, 1, 1 + i % 9, 5)


def row(draw, i, top):
    value = draw.choice((None, *range(top)))
    lifts = [None if draw.random() < 0.2 else draw.randrange(top) / 4 for _ in range(3)]
    score, viral = draw.choice((None, 0.25, 0.5, top / 8)), draw.choice((True, False, None))
    return (f"v{i}", day(i), f"e{draw.random()}", 1, value, score, 1.5, viral, "[]", *lifts, "x")


def tags_of(n):
    """One SKU that most videos tag, some that few do; videos without tags."""
    return [(f"v{i}", s, "tiktok", day(i)) for i in range(n) for s in {"hot", f"s{i % 5}", f"s{i % 3}"} if i % 7]


def expected(spark, videos, bridge):
    signal = inventory.sku_signal(bridge, videos, lifts=True)
    tagged = bridge.groupBy("video_id").agg(F.to_json(F.collect_set("sku_id")).alias("sku_ids_json"))
    best = ranking.top_videos(videos.drop("sku_ids_json").join(tagged, "video_id"))
    return signal_rows(signal), compared(best)


def compared(df):
    columns = sorted(df.columns)
    return sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())


def signal_rows(df):
    return compared(df.withColumn("has_viral_video", F.coalesce("has_viral_video", F.lit(False))))


@pytest.mark.parametrize("spare, seed", [(0, 1), (1, 2), (8, 3)])
def test_changes_give_the_signal_of_all_videos(spark, spare, seed):
    draw = random.Random(seed)
    bridge = spark.createDataFrame(tags_of(40), BRIDGE)
    state = spark.createDataFrame([], INC.STATE)
    applied, current, looked_up = spark.createDataFrame([], INC.CHANGES), {}, 0
    for batch in range(4):
        # Values fall from batch to batch, so the best videos leave their places.
        chosen = range(40) if batch == 0 else draw.sample(range(45), 12)
        new = {i: row(draw, i, 20 - 4 * batch) for i in chosen}
        current |= new
        changed = spark.createDataFrame(list(new.values()), VIDEO)
        now = INC.contributions(changed, bridge)
        rows = tables.stage(INC.changes(now, applied, batch, batch - 1), "rows")
        kept = applied.join(rows.select("video_id"), "video_id", "left_anti")
        applied = tables.stage(kept.unionByName(rows.select(*kept.columns)), "applied")
        moved = tables.stage(INC.advance(state, rows, spare), "moved")
        short = moved.filter("short").select("sku_id")
        looked_up += short.count()
        moved = INC.with_looked_up(moved, INC.looked_up(short, applied, spare))
        kept = state.join(moved.select("sku_id"), "sku_id", "left_anti")
        state = tables.stage(kept.unionByName(moved.select(*kept.columns)), "state")
        videos = spark.createDataFrame(list(current.values()), VIDEO)
        signal, best = expected(spark, videos, bridge)
        assert signal_rows(INC.signal(state)) == signal, batch
        assert compared(INC.top_videos(state)) == best, batch
        longest = max(k for _, k in INC.MEASURES) + spare
        assert state.filter(F.size("tops") > len(INC.MEASURES) * longest).count() == 0
    assert looked_up > 0 or spare == 8


def a_root(spark, folder, n=30):
    draw = random.Random(5)
    hourly.store(spark, folder, "video_sku_bridge", spark.createDataFrame(tags_of(n), BRIDGE))
    put_videos(spark, folder, [row(draw, i, 20) for i in range(n)])
    hourly.note_changes(spark, folder)
    hourly.refresh_skus(spark, folder)
    return draw


def put_videos(spark, folder, rows):
    df = spark.createDataFrame(rows, VIDEO)
    hourly.store(spark, folder, "mart_videos", df, ["video_id"], "latest_event_id")
    # The lifts come as predictions for the rows.
    names = [c.split()[0] for c in hourly.PREDICTION.split(", ")]
    hourly.store(spark, folder, "video_predictions", df.select(*names), ["video_id"], "latest_event_id")
    return df.select("video_id", "posted_at")


def state_is_right(spark, folder):
    videos, bridge = hourly.read_videos(spark, folder), hourly.read(spark, folder, "video_sku_bridge")
    signal = INC.signal(hourly._state_of(spark, folder))
    return signal_rows(signal) == signal_rows(inventory.sku_signal(bridge, videos, lifts=True))


def test_a_run_that_breaks_off_is_made_up_for(spark, folder):
    draw = a_root(spark, folder)
    assert state_is_right(spark, folder)
    # Noted twice without the state taking it in, one video in both; then a third time.
    for ids in ((1, 2, 3), (3, 4), (4, 5)):
        changed = put_videos(spark, folder, [row(draw, i, 30) for i in ids])
        hourly.note_changes(spark, folder, changed)
        assert ids == (4, 5) or not state_is_right(spark, folder)
    hourly.refresh_skus(spark, folder)
    assert state_is_right(spark, folder)
    version = stored.entries(spark, f"{folder}/sku_state")
    hourly.refresh_skus(spark, folder)  # nothing is left to do
    assert stored.entries(spark, f"{folder}/sku_state") == version
    # Without the log entry the state started from, all changes are gone through.
    changed = put_videos(spark, folder, [row(draw, i, 30) for i in (1, 9)])
    hourly.note_changes(spark, folder, changed)
    stored.vacuum(spark, f"{folder}/sku_changes", keep=1)
    hourly.refresh_skus(spark, folder)
    assert state_is_right(spark, folder)


def test_untouched_days_and_skus_are_not_read(spark, folder):
    draw = a_root(spark, folder)
    changed = put_videos(spark, folder, [row(draw, i, 30) for i in (8, 17)])  # of one day
    for name in ("mart_videos", "video_predictions", "video_sku_bridge", "sku_changes"):
        for file in pathlib.Path(folder, name, "data").rglob("*.parquet"):
            if "day=2024-01-09" not in str(file):
                file.write_bytes(b"not to be read")
    touched = {r[0] for r in hourly.read(spark, folder, "video_sku_bridge", days=[dt.date(2024, 1, 9)]).filter("video_id IN ('v8', 'v17')").select(INC.bucket()).collect()}
    before = stored.live(spark, f"{folder}/sku_state")
    hourly.note_changes(spark, folder, changed)
    hourly.refresh_skus(spark, folder)
    after = stored.live(spark, f"{folder}/sku_state")
    assert {int(k) for k in after if after[k] != before.get(k)} == touched and len(touched) < len(after)


KV = "k string, v int"


def test_of_two_writers_that_start_together_one_wins(spark, folder, monkeypatch):
    """Both have read the same version before either commits."""
    path, ready = f"{folder}/t", threading.Barrier(2)
    stored.publish(spark, path, spark.createDataFrame([("a", 0)], KV))
    write = stored._write

    def slow(*args):
        made = write(*args)
        ready.wait(60)
        return made

    monkeypatch.setattr(stored, "_write", slow)
    outcomes = []

    def publish(v):
        try:
            stored.publish(spark, path, spark.createDataFrame([("a", v)], KV), number="000000000001")
            outcomes.append(v)
        except stored.Conflict:
            outcomes.append(None)

    threads = [threading.Thread(target=publish, args=(v,)) for v in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(o is None for o in outcomes) == [False, True]
    won = next(o for o in outcomes if o)
    assert stored.read(spark, path, spark.createDataFrame([], KV).schema).collect() == [("a", won)]


def test_upserts_that_meet_lose_nothing(spark, folder):
    path, order = f"{folder}/t", [F.col("v").desc()]
    stored.upsert(spark, path, spark.createDataFrame([("a", 0)], KV), ["k"], order)

    def write(k):
        stored.upsert(spark, path, spark.createDataFrame([(k, 1)], KV), ["k"], order)

    threads = [threading.Thread(target=write, args=(k,)) for k in "bcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = stored.read(spark, path, spark.createDataFrame([], KV).schema).collect()
    assert sorted(r.k for r in rows) == ["a", "b", "c", "d"]


def test_many_appends_stay_few_folders(spark, folder):
    path, schema = f"{folder}/t", spark.createDataFrame([], KV).schema
    for i in range(40):
        stored.append(spark, path, spark.createDataFrame([(f"k{i}", i)], KV))
        stored.compact(spark, path, schema, many=5)
        assert len(stored.live(spark, path)[""]) <= 5
    assert sorted(r.v for r in stored.read(spark, path, schema).collect()) == list(range(40))
    before = len(list(pathlib.Path(path, "data").iterdir()))
    stored.vacuum(spark, path, keep=1)
    assert len(list(pathlib.Path(path, "data").iterdir())) < before
    assert stored.read(spark, path, schema).count() == 40


def test_large_folders_are_not_rewritten(spark, folder):
    path, schema = f"{folder}/t", spark.createDataFrame([], "k string, v int, day date").schema
    days = [dt.date(2024, 1, 1), None]
    big = spark.range(5000).selectExpr("uuid() AS k", "CAST(id AS INT) AS v", "DATE '2024-01-01' AS day")
    stored.append(spark, path, big, "day")
    large = stored.live(spark, path)["2024-01-01"]
    for i in range(4):
        stored.append(spark, path, spark.createDataFrame([(f"k{i}{d}", i, d) for d in days], schema), "day")
    assert stored.compact(spark, path, schema, "day", many=3, small=20_000) == 8
    live = stored.live(spark, path)
    assert live["2024-01-01"][0] == large[0] and [len(v) for v in live.values()] == [2, 1]
    assert stored.read(spark, path, schema, "day").count() == 5008
    assert stored.compact(spark, path, schema, "day", many=3, small=20_000) == 0


def test_rows_of_unknown_days_are_kept(spark, folder):
    path, kvd = f"{folder}/t", "k string, v int, day date"
    schema, order = spark.createDataFrame([], kvd).schema, [F.col("v").desc()]

    def put(*rows):
        stored.upsert(spark, path, spark.createDataFrame(list(rows), kvd), ["k"], order, "day")

    put(("a", 1, None), ("b", 1, None), ("c", 1, dt.date(2024, 1, 1)))
    put(("d", 1, None), ("b", 2, None))
    rows = sorted((r.k, r.v) for r in stored.read(spark, path, schema, "day").collect())
    assert rows == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert stored.read(spark, path, schema, "day", days=[None]).count() == 3
    assert stored.read(spark, path, schema, "day", between=(dt.date(2023, 1, 1), dt.date(2025, 1, 1))).count() == 1
    with pytest.raises(ValueError, match="NULL in k"):
        put((None, 1, None))


def test_broken_snapshots_are_all_kept_apart(spark, folder):
    # As Parquet files are read: all columns may be NULL.
    schema = StructType([StructField(f.name, f.dataType) for f in schemas.ENGAGEMENT_EVENTS.fields])

    def event(**given):
        values = {"event_id": None, "video_id": "v", "hours_since_post": 1, "view_count": 1} | given
        return tuple(values.get(name) for name in schema.names)

    for batch in ([event(), event(view_count=2)], [event(), event(event_id="e1", hours_since_post=None)]):
        hourly.ingest_batch(spark, folder, spark.createDataFrame(batch, schema))
    apart = hourly.read(spark, folder, "quarantined_events").collect()
    assert sorted((str(r.event_id), r.view_count, r.reason) for r in apart) == [
        ("None", 1, "no_key"),
        ("None", 2, "no_key"),
        ("e1", 1, "no_hour"),
    ]
    assert hourly.read(spark, folder, "engagement_events").count() == 0
