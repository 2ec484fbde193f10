"""Windows, cleaning, latest rows and ranking."""

import json
import random

import pytest
from pyspark.sql import functions as F

from liftspark.operators import features as FT
from liftspark.operators import ranking, scoring
from liftspark.plans import marts


def deltas(spark, rows):
    schema = (
        "video_id string, hours_since_post int, views_delta_1h int, saves_delta_1h int,"
        " shares_delta_1h int, save_rate double, share_rate double, click_rate double"
    )
    return spark.createDataFrame(
        [(v, h, d, d, d, 0.0838, 0.0313, 0.0401) for v, h, d in rows], schema
    )


def test_velocity_and_acceleration(spark):
    df = deltas(spark, [("a", h, (h + 1) * 10) for h in range(4)])
    rows = FT.velocity(df).orderBy("hours_since_post").collect()
    assert [r.views_velocity_3h for r in rows] == [10, 30, 60, 90]
    assert [r.views_acceleration for r in rows] == [10, 10, 10, 10]
    assert {r.engagement_score for r in rows} == {0.462}
    zero = FT.velocity(df, first="zero").orderBy("hours_since_post").collect()
    assert [r.views_acceleration for r in zero] == [0, 10, 10, 10]


def test_velocity_counts_rows_not_hours(spark):
    df = deltas(spark, [("a", 0, 1), ("a", 7, 2), ("a", 30, 4), ("a", 31, 8)])
    rows = FT.velocity(df).orderBy("hours_since_post").collect()
    assert [r.saves_velocity_3h for r in rows] == [1, 3, 7, 14]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="click_rate"):
        FT.velocity(deltas(spark, [("a", 0, 1)]).drop("click_rate"))
    with pytest.raises(ValueError, match="view_count"):
        FT.clean_rates(spark.createDataFrame([(1,)], "like_count int"))


def counts(spark, rows):
    names = "view_count like_count save_count share_count click_to_product add_to_cart".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def test_clean_rates(spark):
    row = FT.clean_rates(counts(spark, [(28400, 3100, 2380, 890, 1140, 290)])).first()
    assert (row.save_rate, row.share_rate, row.click_rate, row.cart_rate, row.like_rate) == (
        0.083803,
        0.031338,
        0.040141,
        0.010211,
        0.109155,
    )
    zero, over = FT.clean_rates(counts(spark, [(0, 5, 5, 5, 5, 5), (2, 5, 5, 5, 5, 1)])).collect()
    assert zero.save_rate == 0.0 and over.save_rate == 1.0 and over.cart_rate == 0.5


def test_hourly_deltas_never_negative(spark):
    df = spark.createDataFrame(
        [("a", 0, 10, 1, 0), ("a", 1, 30, 6, 2), ("a", 2, 25, 7, 1)],
        "video_id string, hours_since_post int, view_count int, save_count int, share_count int",
    )
    rows = FT.hourly_deltas(df).orderBy("hours_since_post").collect()
    assert [r.views_delta_1h for r in rows] == [10, 20, 0]
    assert [r.shares_delta_1h for r in rows] == [0, 2, 0]
    assert [r.save_velocity for r in rows] == [0.1, 0.25, 0.0]


def test_latest_features_equal_features_of_latest(bench):
    full = FT.latest_snapshot(bench.features)
    tail = FT.latest_features(bench.events, bench.raw.bridge, bench.raw.skus)
    assert sorted(full.columns) == sorted(tail.columns)
    tail = tail.select(*full.columns)
    assert full.exceptAll(tail).count() == 0 and tail.exceptAll(full).count() == 0


def test_features_against_plain_python(spark, bench):
    """Rolling sums recomputed row by row from the raw rows."""
    raw = bench.events.select("video_id", "hours_since_post", "views_delta_1h").collect()
    series = {}
    for r in sorted(raw, key=lambda r: (r.video_id, r.hours_since_post)):
        series.setdefault(r.video_id, []).append((r.hours_since_post, r.views_delta_1h))
    want = {}
    for video, rows in series.items():
        for i, (hour, views) in enumerate(rows):
            window = sum(v for _, v in rows[max(0, i - 2) : i + 1])
            want[video, hour] = (window, views - (rows[i - 1][1] if i else 0))
    got = {
        (r.video_id, r.hours_since_post): (r.views_velocity_3h, r.views_acceleration)
        for r in bench.features.collect()
    }
    assert got == want


def test_rates_and_tiers_are_total(bench):
    bad = bench.features.filter(
        "save_rate NOT BETWEEN 0 AND 1 OR creator_tier_encoded NOT BETWEEN 0 AND 4"
        " OR platform_encoded NOT BETWEEN 0 AND 2 OR sku_viral_sensitivity IS NULL"
    )
    assert bad.count() == 0


def test_label_in_events_is_the_operator_label(bench):
    from liftspark.plans import catalog

    inline = bench.raw.events.select("video_id", "demand_lift_24h").distinct()
    assert inline.exceptAll(catalog.lift_label(bench)).count() == 0


def test_trending_rank_and_limit(bench):
    top = ranking.trending(bench.scored, k=7).collect()
    assert sorted(r["rank"] for r in top) == list(range(1, 8))
    best = [r.engagement_score for r in sorted(top, key=lambda r: r["rank"])]
    assert best == sorted(best, reverse=True)
    with pytest.raises(ValueError):
        ranking.trending_page(bench.videos, 101)


def test_top_videos_with_one_hot_sku(spark):
    """One SKU tagged by most videos: still the exact best five, ties by id."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        skus = ["HOT"] if i % 3 else [f"SKU-{i % 17:02d}", "HOT"]
        rows.append((f"v{i:04d}", json.dumps(skus), round(rng.random(), 2)))
    rows.append(("broken", "not json", 9.0))
    df = spark.createDataFrame(rows, "video_id string, sku_ids_json string, p90_demand_lift double")
    want = {}
    for video, text, p90 in rows[:-1]:
        for sku in json.loads(text):
            want.setdefault(sku, []).append((-p90, video))
    want = {s: [v for _, v in sorted(x)[:5]] for s, x in want.items()}
    got = {r.sku_id: r.top_video_ids for r in ranking.top_videos(df.repartition(6)).collect()}
    assert got == want


def test_sku_lift_from_lists_equals_single_pass(bench):
    """The tag lists of the videos and the bridge give the same mart."""
    lists = scoring.sku_lift(bench.scored)
    from liftspark.operators import inventory

    rows = inventory.sku_inventory(
        bench.staged_skus, bench.raw.bridge, bench.videos, bench.as_of
    )
    a = marts.sku_risk_mart(rows, lists)
    b = bench.risk_mart(bench.scored)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_signal_against_plain_python(bench):
    videos = {r.video_id: r for r in bench.videos.collect()}
    want = {}
    for r in bench.raw.bridge.collect():
        want.setdefault(r.sku_id, []).append(videos[r.video_id])
    from liftspark.operators import inventory

    for r in inventory.sku_signal(bench.raw.bridge, bench.videos).collect():
        rows = want.pop(r.sku_id)
        assert r.active_video_count == len({v.video_id for v in rows})
        assert r.max_view_count == max(v.view_count for v in rows)
        mean = sum(v.engagement_score for v in rows) / len(rows)
        assert abs(r.avg_engagement_score - mean) < 1e-9
        assert r.has_viral_video == any(v.is_viral for v in rows)
    assert not want


def test_no_tag_means_neutral_sensitivity(spark, bench):
    empty = bench.raw.bridge.filter(F.lit(False))
    row = FT.latest_features(bench.events, empty, bench.raw.skus).first()
    assert row.sku_viral_sensitivity == 1.0 and row.sku_viral_sensitivity_max == 1.0
