"""Declared checks of stored tables, kept by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from liftspark import schemas
from liftspark.operators import quality
from liftspark.plans import checks, hourly
from liftspark.sources import stored

NAME = "engagement_events"
COLUMNS = ("event_id", "video_id", "snapshot_at", "hours_since_post", "platform", "creator_tier", "view_count")
SHORT = "event_id string, video_id string, snapshot_at timestamp, hours_since_post int, platform string, creator_tier string, view_count bigint"


def noon(day):
    return None if day is None else dt.datetime(2024, 1, day, 12)


def events(spark, rows):
    """Event rows from (id, day, platform, views); the other columns are NULL."""
    full = [(i, "v", noon(day), 1, platform, "nano", views) for i, day, platform, views in rows]
    df = spark.createDataFrame(full, SHORT)
    types = {f.name: f.dataType for f in schemas.RAW[NAME].fields}
    return df.select(*[F.col(c) if c in COLUMNS else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def rows_of(df):
    return sorted(tuple(r) for r in df.select("check", "column_name", "failures", "status").collect())


def whole(spark, root):
    """The checks of all rows at once."""
    declared = quality.check_declared(hourly.read(spark, root, NAME), *quality.DECLARED[NAME])
    return rows_of(quality.report({NAME: declared}))


def test_results_equal_those_of_the_whole_table(spark, folder):
    rng = random.Random(4)
    for _ in range(5):
        # Few ids over few days, so that ids come again on the same and on other days.
        rows = [
            (f"e{rng.randrange(12)}", rng.choice([1, 2, 3, None]), rng.choice(["tiktok", "fax", None]), rng.choice([1, None]))
            for _ in range(8)
        ]
        hourly.store(spark, folder, NAME, events(spark, rows))
        checks.refresh(spark, folder, NAME)
        assert rows_of(checks.report(spark, folder, [NAME])) == whole(spark, folder)


@pytest.fixture()
def two_days(spark, folder):
    hourly.store(spark, folder, NAME, events(spark, [("a", 1, "fax", None), ("b", 2, "tiktok", 5), ("c", 2, "tiktok", 5)]))
    return folder


def test_only_written_days_are_checked(spark, two_days):
    assert checks.refresh(spark, two_days, NAME) == ["2024-01-01", "2024-01-02"]
    assert checks.refresh(spark, two_days, NAME) == []
    hourly.store(spark, two_days, NAME, events(spark, [("b", 2, "tiktok", None), ("d", 3, "tiktok", 1)]))
    kept = {k: stored.live(spark, f"{hourly._path(two_days, NAME)}_check_{k}")["2024-01-01"] for k in ("counts", "values")}
    # The rows of the first day are gone from the disk: nothing may read them.
    first = stored.live(spark, hourly._path(two_days, NAME))["2024-01-01"][0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{hourly._path(two_days, NAME)}/data/{first}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    assert checks.refresh(spark, two_days, NAME) == ["2024-01-02", "2024-01-03"]
    for kind, folders in kept.items():
        assert stored.live(spark, f"{hourly._path(two_days, NAME)}_check_{kind}")["2024-01-01"] == folders
    found = {(c, n): f for c, n, f, _ in rows_of(checks.report(spark, two_days, [NAME]))}
    assert found["not_null", "view_count"] == 2 and found["accepted_values", "platform"] == 1
    assert found["unique", "event_id"] == 0


def test_a_run_that_broke_off_is_made_up_for(spark, two_days, monkeypatch):
    checks.refresh(spark, two_days, NAME)
    hourly.store(spark, two_days, NAME, events(spark, [("a", 2, "fax", 1)]))  # stored under two days now
    with monkeypatch.context() as patch:
        patch.setattr(quality, "count_parts", lambda *_: 1 / 0)  # after the values, before the counts
        with pytest.raises(ZeroDivisionError):
            checks.refresh(spark, two_days, NAME)
    assert checks.refresh(spark, two_days, NAME) == ["2024-01-02"]
    assert rows_of(checks.report(spark, two_days, [NAME])) == whole(spark, two_days)
    found = {(c, n): f for c, n, f, _ in rows_of(checks.report(spark, two_days, [NAME]))}
    assert found["unique", "event_id"] == 1


def test_results_outlive_old_versions(spark, two_days):
    checks.refresh(spark, two_days, NAME)
    for views in range(5):
        hourly.store(spark, two_days, NAME, events(spark, [("b", 2, "tiktok", views)]))
    hourly.clean_up(spark, two_days, keep=1)
    assert checks.refresh(spark, two_days, NAME) == ["2024-01-02"]
    assert rows_of(checks.report(spark, two_days, [NAME])) == whole(spark, two_days)


def test_tables_without_rows_or_days(spark, folder, bench):
    hourly.store(spark, folder, NAME, events(spark, []))
    hourly.store(spark, folder, "sku_catalog", bench.raw.skus)
    for name in (NAME, "sku_catalog"):
        checks.refresh(spark, folder, name)
    hourly.store(spark, folder, "sku_catalog", bench.raw.skus.limit(1))
    assert checks.refresh(spark, folder, "sku_catalog") == [""]
    report = checks.report(spark, folder, [NAME, "sku_catalog"])
    assert report.filter("failures <> 0").count() == 0
    assert report.count() == sum(len(u) + len(n) + len(a) for u, n, a in map(quality.DECLARED.get, (NAME, "sku_catalog")))
