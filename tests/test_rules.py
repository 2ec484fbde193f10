"""Column rules against worked examples."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode, scores, tiers
from liftspark.operators import alerts as A
from liftspark.operators import evaluate as E
from liftspark.operators import scoring, staging


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    "stock, demand, lead, cover, tier",
    [
        (300, 50.0, 14, 6.0, "CRITICAL"),
        (700, 50.0, 14, 14.0, "WARNING"),
        (1400, 50.0, 10, 28.0, "WATCH"),
        (1500, 50.0, 10, 30.0, "NORMAL"),
        (10, 0.0, 10, None, "NORMAL"),
    ],
)
def test_inventory_tier(spark, stock, demand, lead, cover, tier):
    raw = spark.sql(
        f"SELECT 'SKU-0001' sku_id, 'x' name, 'beauty' category, 29.99D unit_price_usd,"
        f" {demand}D baseline_daily_demand, {stock} current_stock, {lead} supplier_lead_time_days,"
        f" 200 reorder_point, 2.5D viral_sensitivity, timestamp'2024-01-01' created_at"
    )
    row = staging.stg_skus(raw).first()
    assert (row.days_of_cover, row.inventory_risk_tier) == (cover, tier)
    assert row.is_below_reorder == (stock <= 200)


def test_tier_uses_unrounded_cover(spark):
    raw = spark.sql(
        "SELECT 's' sku_id, 'x' name, 'beauty' category, 1D unit_price_usd, 1.0001D"
        " baseline_daily_demand, 10 current_stock, 10 supplier_lead_time_days, 0 reorder_point,"
        " 1D viral_sensitivity, timestamp'2024-01-01' created_at"
    )
    row = staging.stg_skus(raw).first()
    assert (row.days_of_cover, row.inventory_risk_tier) == (10.0, "CRITICAL")


TIER_CASES = [
    (3.5, 5, 10, "CRITICAL"),
    (4.0, 8, 10, "CRITICAL"),
    (2.5, 12, 15, "WARNING"),
    (2.1, 15, 14, "WARNING"),
    (1.8, 25, 10, "WATCH"),
    (1.2, 20, 5, "NORMAL"),
    (5.0, 40, 10, "NORMAL"),
]


@pytest.mark.parametrize("p90, cover, lead, tier", TIER_CASES)
def test_sku_tier(spark, p90, cover, lead, tier):
    df = spark.createDataFrame([(p90, float(cover), lead)], "p double, c double, l int")
    got = df.select(tiers.sku_tier(F.col("p"), F.col("c"), F.col("l"), C.RiskConfig()).alias("t"))
    assert got.first().t == tier


def test_zero_demand_is_normal(spark):
    df = spark.sql(
        "SELECT 5.0D p90_demand_lift, 10 current_stock, 0.0D baseline_daily_demand,"
        " 10 supplier_lead_time_days"
    )
    row = scoring.ml_risk(df).first()
    assert (row.projected_stockout_days, row.ml_risk_tier) == (None, "NORMAL")


TRIAGE = (
    "sku_id string, current_stock int, baseline_daily_demand double, supplier_lead_time_days int,"
    " unit_price_usd double, p10_demand_lift double, p50_demand_lift double,"
    " p90_demand_lift double, sku_name string, active_video_count bigint,"
    " max_engagement_score double"
)
TRIAGE_CASES = [
    ("SKU-0001", 50, 20.0, 7, 24.99, 2.0, 3.5, 5.0, 0.5, "CRITICAL", "draft_purchase_order"),
    ("SKU-0042", 200, 30.0, 5, 12.50, 1.5, 2.2, 2.8, 2.38, "WARNING", "draft_alert"),
    ("SKU-0099", 200, 10.0, 3, 8.99, 1.0, 1.3, 1.6, 12.5, "WATCH", "log_and_recheck"),
    ("SKU-0200", 1000, 5.0, 4, 3.99, 0.8, 1.0, 1.2, 166.67, "NORMAL", "none"),
    ("SKU-HIGH-STOCK", 100000, 10.0, 3, 0.0, 2.0, 3.0, 4.0, 2500.0, "WATCH", "log_and_recheck"),
    ("SKU-IDLE", 5, 0.0, 3, 1.0, 2.0, 3.0, 4.0, 9999.0, "WATCH", "log_and_recheck"),
]


@pytest.fixture(scope="module")
def triaged(spark):
    rows = [(*c[:8], f"Name {c[0]}", 3, 0.25) for c in TRIAGE_CASES]
    return A.triage(spark.createDataFrame(rows, TRIAGE)).cache()


def test_triage(triaged):
    got = {r.sku_id: r for r in triaged.collect()}
    for case in TRIAGE_CASES:
        row = got[case[0]]
        assert round(row.days_of_cover, 2) == case[8]
        assert (row.risk_tier, row.action_type) == case[9:]
        assert row.should_continue == (case[9] in ("CRITICAL", "WARNING"))
    assert got["SKU-0001"].reasoning == (
        "P90 lift 5.00x exceeds 3.0x threshold. Days of cover (0.5) < 7 days "
        "or < lead time (7d). Immediate PO required."
    )
    assert got["SKU-HIGH-STOCK"].reasoning == (
        "P90 lift 4.00x is elevated but inventory (2500.0 days) is comfortable."
    )


def test_summary_counts(triaged):
    row = A.triage_summary(triaged).first()
    assert (row.total_skus, row.critical, row.warning) == (6, 1, 1)


def test_purchase_order(triaged):
    row = A.draft(triaged.filter("sku_id = 'SKU-0001'")).first()
    assert row.recommended_quantity == 950
    assert math.isclose(row.estimated_cost_usd, 23740.50)
    assert "Quantity: 950 units | Est. Cost: $23,740.50" in row.action_draft
    assert row.urgency_note.startswith("IMMEDIATE")
    assert "extreme predicted demand lift of 5.0x baseline" in row.investigation_summary
    assert len(row.key_factors) == 5
    warning = A.draft(triaged.filter("sku_id = 'SKU-0042'")).first()
    assert warning.recommended_quantity is None
    assert warning.action_draft.startswith("🟠 WARNING — Elevated Demand Risk: SKU-0042")


def test_order_quantity_is_at_least_one(triaged):
    row = A.order_plan(triaged.filter("sku_id = 'SKU-HIGH-STOCK'")).first()
    assert row.recommended_quantity == 1


def test_alert_rows(spark, triaged):
    from liftspark import schemas

    at = F.lit("2024-02-01 10:20:30").cast("timestamp")
    alerts = A.build_alerts(A.escalated(triaged), at)
    assert alerts.columns == schemas.AGENT_ALERTS.names
    rows = alerts.collect()
    assert {r.sku_id for r in rows} == {"SKU-0001", "SKU-0042"}
    assert {r.status for r in rows} == {"PENDING"}
    assert all(r.alert_id.startswith("alert_20240201_102030_") for r in rows)
    assert sorted(r.alert_id for r in rows) == sorted(r.alert_id for r in alerts.collect())


def test_age_label(spark):
    hours = [0, 5, 24, 36, 47, 60, 84]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    assert values(df.select(encode.age_label(F.col("h")).alias("a")), "a") == [
        "< 1 hour",
        "5 hours",
        "1 days",
        "2 days",
        "2 days",
        "2 days",
        "4 days",
    ]


def test_ordinals_and_weekday(spark):
    df = spark.createDataFrame([("nano",), ("mega",), ("other",), (None,)], "t string")
    coded = df.select(encode.encode_ordinal(F.col("t"), C.CREATOR_TIER_CODES, 1).alias("c"))
    assert values(coded, "c") == [0, 4, 1, 1]
    sunday = spark.sql("SELECT timestamp'2024-01-07 05:00:00' t")
    assert sunday.select(encode.weekday(F.col("t")).alias("d")).first().d == 0


def test_event_key_keeps_long_hours(spark):
    df = spark.sql("SELECT timestamp'2024-01-07 05:00:00' p, 'vid_001' v")
    for hour, end in ((3, "h03"), (123, "h123")):
        key = df.select(encode.event_key(F.col("p"), F.col("v"), F.lit(hour)).alias("k"))
        assert key.first().k == f"evt_20240107_vid_001_{end}"


def test_rule_lift(spark):
    df = spark.sql("SELECT 0.30D engagement_score, 2.5D sku_viral_sensitivity, 1 is_on_foryou")
    got = scoring.rule_based_lift(df).first()
    want = (3.2, 8.0, 17.6)
    for name, value in zip(C.LIFT_COLUMNS, want):
        assert math.isclose(got[name], value)
    parity = scoring.rule_based_lift(df, parity=True).first()
    for name, value in zip(C.LIFT_COLUMNS, (0.2, 0.5, 1.1)):
        assert math.isclose(parity[name], value)


def test_urgency_and_badges(spark):
    df = spark.sql("SELECT 'CRITICAL' t, 0.5D p")
    assert df.select(scores.urgency(F.col("t"), F.col("p")).alias("u")).first().u == 6.0
    steps = [0.2, 0.19, 0.1, 0.05, 0.01]
    df = spark.createDataFrame([(s,) for s in steps], "s double")
    assert values(df.select(tiers.engagement_tier(F.col("s")).alias("b")), "b") == [
        "MEGA",
        "HIGH",
        "HIGH",
        "MODERATE",
        "LOW",
    ]


def test_evaluation_examples(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, q double")
    y, q = F.col("y"), F.col("q")
    row = df.agg(
        E.pinball(y, q, 0.9).alias("pinball"), E.coverage(y, q).alias("cov"), E.mae(y, q).alias("m")
    ).first()
    assert math.isclose(row.pinball, 0.5) and row.cov == 0.5 and row.m == 1.0
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "y double, q double")
    assert df.agg(E.mape(y, q).alias("m")).first().m == 0.5
    zeros = spark.createDataFrame([(0.0, 1.0)], "y double, q double")
    assert zeros.agg(E.mape(y, q).alias("m")).first().m == 0.0


def test_evaluate_without_predictions(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "demand_lift_24h double")
    row = E.evaluate(df).first()
    assert row.p50_mae == 2.0 and row.p90_coverage == 0.0 and row.median_interval_width == 0.0


@pytest.mark.parametrize("n, spread", [(1, 5), (2, 5), (999, 7), (1000, 7), (5000, 10**6)])
def test_exact_median(spark, n, spread):
    rng = random.Random(n)
    data = [rng.randrange(spread) / 4 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in data], "v double").repartition(5)
    assert E.exact_median(df, F.col("v")) == statistics.median(data)


def test_exact_median_of_nothing(spark):
    assert E.exact_median(spark.createDataFrame([], "v double"), F.col("v")) is None
