"""Properties of the physical plans."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from liftspark.operators import features as FT
from liftspark.operators import ranking, serving
from liftspark.plans import catalog, marts
from liftspark.sources import tables


def plan(df) -> str:
    for key in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        df.sparkSession.conf.set(key, "100000")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, bench):
    """Raw and mart tables as files, the way the stored-table runs read them."""
    return {
        "events": tables.stage(bench.events, "events"),
        "bridge": tables.stage(bench.raw.bridge, "bridge"),
        "skus": tables.stage(bench.raw.skus, "skus"),
        "videos": tables.stage(bench.scored, "videos"),
        "risk": tables.stage(bench.risk_mart(bench.scored), "risk"),
    }


@pytest.fixture()
def no_broadcast(spark):
    """As for sides too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(serving.sku_risk(stored["risk"], "beauty", "critical").select("sku_id"))
    assert "EqualTo(category,beauty)" in text and "EqualTo(ml_risk_tier,CRITICAL)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"sku_id", "category", "ml_risk_tier"}


def test_features_shuffle_events_once(stored, no_broadcast):
    text = plan(FT.features(stored["events"], stored["bridge"], stored["skus"]))
    scans_of_events = text.count("views_delta_1h:bigint")
    assert scans_of_events == 1
    # events, tags with SKUs on sku_id (two sides), sums by video
    assert text.count("Exchange hashpartitioning") == 4


def test_latest_rows_are_cut_before_the_shuffle(stored):
    text = plan(FT.latest_features(stored["events"], stored["bridge"], stored["skus"]))
    assert re.search(r"WindowGroupLimit .* 3, Partial", text)
    assert text.count("views_delta_1h:bigint") == 1


def test_top_k_plans(stored):
    text = plan(ranking.trending(stored["videos"]))
    assert "TakeOrderedAndProject(limit=50" in text
    text = plan(ranking.top_videos(stored["videos"]))
    assert re.search(r"WindowGroupLimit .* 5, Partial", text)


def test_risk_mart_reads_videos_once(bench, stored, no_broadcast):
    staged = bench.staged_skus
    text = plan(marts.risk_from_videos(staged, stored["bridge"], stored["videos"]))
    assert text.count("demand_lift_24h") == 0  # pruned
    assert text.count("p90_demand_lift:double") == 1


@pytest.mark.parametrize(
    "query",
    [
        catalog.features,
        catalog.sku_risk_mart,
        catalog.at_risk,
        catalog.cooldown,
        catalog.cap_per_hour,
        catalog.decision_outcomes,
        catalog.due_snapshots,
        catalog.upserted,
        catalog.dq_report,
        catalog.lift_label,
    ],
)
def test_no_pair_products_and_no_python(spark, query, no_broadcast):
    text = plan(query(catalog.Workbench(spark, "/root/testdata/sf0.001")))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_upsert_of_a_small_batch_does_not_shuffle_the_base(spark, stored):
    from liftspark.sources import upsert

    base = stored["risk"].select("sku_id", "current_stock")
    new = base.filter(F.col("current_stock") > 140)
    text = plan(upsert.upsert(base, new, ["sku_id"], [F.col("current_stock")]))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 1  # the ranking of the new rows


def test_only_folders_of_the_asked_days_are_opened(spark, folder):
    import datetime as dt

    from liftspark.sources import stored

    days = [dt.date(2024, 1, i) for i in range(1, 9)]
    df = spark.createDataFrame([(f"k{i}", i, d) for i, d in enumerate(days)], "k string, v int, day date")
    stored.publish(spark, f"{folder}/t", df, "day")
    for chosen in ({"days": days[2:4]}, {"between": (days[2], days[3])}):
        part = stored.read(spark, f"{folder}/t", df.schema, "day", **chosen)
        found = {re.search(r"day=([^/]*)/", f).group(1) for f in part.inputFiles()}
        assert found == {"2024-01-03", "2024-01-04"}  # no other folder is listed
        assert part.count() == 2


def test_many_trees_are_one_step(spark, bench):
    import random
    import time

    from liftspark import config as C
    from liftspark.operators import quantile as Q

    rng = random.Random(1)

    def tree():
        t = Q.Tree([], [], [], [], [])

        def grow(depth):
            at = len(t.feature)
            for column in (t.feature, t.threshold, t.low, t.high, t.value):
                column.append(-1)
            if depth:
                t.feature[at], t.threshold[at], t.value[at] = rng.randrange(15), rng.random(), 0.0
                t.low[at], t.high[at] = grow(depth - 1), grow(depth - 1)
            else:
                t.threshold[at], t.low[at], t.high[at], t.value[at] = 0.0, at, at, rng.random()
            return at

        grow(5)
        return t

    models = {q: Q.QuantileModel(a, 0.5, [tree() for _ in range(500)]) for q, a in C.QUANTILES.items()}
    start = time.time()
    df = Q.predict(bench.videos, models)
    assert time.time() - start < 10
    assert plan(df).count("ArrowEvalPython") == 1
