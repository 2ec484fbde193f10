"""Work of the stored-table runs: dealt by what rows hold, and no more rows moved than a batch changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from liftspark.operators import incremental
from liftspark.plans import catalog
from liftspark.sources import stored
from tests.conftest import SF

KEYED = "id string, day date, v int"
ONE, TWO = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def _upsert(spark, path, rows):
    stored.upsert(spark, path, spark.createDataFrame(rows, KEYED), ["id"], [F.desc("v")], "day")


def _rows(spark, path):
    schema = spark.createDataFrame([], KEYED).schema
    return sorted(map(tuple, stored.read(spark, path, schema, "day").collect()))


def test_change_rows_are_dealt_by_their_tags(spark, monkeypatch):
    monkeypatch.setattr(incremental, "TAGS", 10)
    share = (["a", "b", "c"], 0, 0, 0, [1.0] * 6)
    rows = [(f"v{i}", None, 0, share if i % 2 else None, share) for i in range(20)]
    df = spark.createDataFrame(rows, incremental.CHANGES).coalesce(1)
    out = incremental.dealt(df)
    assert out.rdd.getNumPartitions() == 1 + 90 // 10
    assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
    assert incremental.dealt(df.limit(0)).count() == 0


def test_new_keys_are_added_beside_stored_rows(spark, folder):
    path = f"{folder}/t"
    _upsert(spark, path, [("a", ONE, 1), ("b", TWO, 1)])
    before = stored.live(spark, path)
    _upsert(spark, path, [("c", ONE, 1), ("b", TWO, 2), ("d", TWO, 1), ("d", TWO, 3)])
    after = stored.live(spark, path)
    assert after["2024-01-01"][:1] == before["2024-01-01"] and len(after["2024-01-01"]) == 2
    assert before["2024-01-02"][0] not in after["2024-01-02"]
    assert _rows(spark, path) == [("a", ONE, 1), ("b", TWO, 2), ("c", ONE, 1), ("d", TWO, 3)]


def test_a_key_that_moves_within_the_days_of_the_batch_is_replaced(spark, folder):
    path = f"{folder}/t"
    _upsert(spark, path, [("a", ONE, 1)])
    _upsert(spark, path, [("a", TWO, 2), ("b", ONE, 1)])
    assert _rows(spark, path) == [("a", TWO, 2), ("b", ONE, 1)]
    _upsert(spark, path, [("c", None, 1), ("d", ONE, 1)])
    _upsert(spark, path, [("c", None, 2)])
    assert [r for r in _rows(spark, path) if r[0] in "cd"] == [("c", None, 2), ("d", ONE, 1)]


def test_many_added_folders_are_put_together(spark, folder):
    path = f"{folder}/t"
    for i in range(stored.MANY_FOLDERS):
        _upsert(spark, path, [(f"k{i}", ONE, i)])
    assert len(stored.live(spark, path)["2024-01-01"]) == 1
    assert len(_rows(spark, path)) == stored.MANY_FOLDERS


def test_checks_derive_the_events_once(spark):
    w = catalog.Workbench(spark, SF)
    catalog.dq_suite(w)
    assert all("/events-" in f for f in w.raw.events.inputFiles())
    assert all("/videos-" in f for f in w.raw.videos.inputFiles())
