"""The marts, from raw tables to review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode, tiers
from liftspark.operators import alerts as A
from liftspark.operators import features as FT
from liftspark.operators import inventory, scoring

_VIDEO_PENDING = {
    **{c: "double" for c in C.LIFT_COLUMNS},
    "risk_tier_predicted": "string",
}
_SKU_PENDING = {
    **{c: "double" for c in C.LIFT_COLUMNS},
    "ml_risk_tier": "string",
    "projected_stockout_days": "double",
    "latest_alert_id": "string",
    "alert_status": "string",
}


def scored_videos(latest: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Video mart from latest feature rows; predictions are still NULL."""
    return latest.selectExpr(
        "video_id",
        "event_id AS latest_event_id",
        "posted_at",
        "snapshot_at AS last_snapshot_at",
        "hours_since_post",
        "hours_since_post AS hours_observed",
        "view_count",
        "platform",
        "creator_id",
        "creator_tier",
        "sku_ids_json",
        "platform_encoded",
        "creator_tier_encoded",
        "video_duration_s",
        "has_link_in_bio_int AS has_link_in_bio",
        "save_rate",
        "share_rate",
        "click_rate",
        "cart_rate",
        "like_rate",
        "views_velocity_3h",
        "saves_velocity_3h",
        "shares_velocity_3h",
        "views_acceleration",
        "views_delta_1h",
        "saves_delta_1h",
        "shares_delta_1h",
        "save_velocity",
        "engagement_score",
        "is_on_foryou_int AS is_on_foryou",
        "coalesce(trending_rank, -1) AS trending_rank",
        "sku_viral_sensitivity",
        "sku_viral_sensitivity_max",
        "posted_hour_of_day",
        "posted_day_of_week",
        "snapshot_hour_of_day",
        "snapshot_day_of_week",
        "demand_lift_24h",
        "is_viral",
        *[f"CAST(NULL AS {t}) AS {c}" for c, t in _VIDEO_PENDING.items()],
    ).withColumn("mart_refreshed_at", F.current_timestamp() if as_of is None else as_of)


def rule_scored(videos: DataFrame) -> DataFrame:
    """Video mart with the lifts and tier of the rule filled in."""
    return scoring.with_video_tier(scoring.rule_based_lift(videos)).selectExpr(*videos.columns)


def sku_risk_base(inventory_rows: DataFrame) -> DataFrame:
    """SKU mart before scoring: predictions and alert state are NULL."""
    return inventory_rows.selectExpr(
        "sku_id",
        "sku_name",
        "category",
        "unit_price_usd",
        "baseline_daily_demand",
        "current_stock",
        "supplier_lead_time_days",
        "reorder_point",
        "days_of_cover",
        "is_below_reorder",
        "inventory_risk_tier",
        "viral_sensitivity",
        "active_video_count",
        "max_view_count",
        "max_engagement_score",
        "avg_engagement_score",
        "demand_pressure_proxy",
        "has_viral_video",
        "urgency_score",
        *[f"CAST(NULL AS {t}) AS {c}" for c, t in _SKU_PENDING.items()],
        "refreshed_at",
    )


def sku_risk_mart(
    inventory_rows: DataFrame,
    lifts: DataFrame | None = None,
    alerts: DataFrame | None = None,
    cfg: C.RiskConfig = C.RiskConfig(),
) -> DataFrame:
    """SKU mart with lifts, tier, projected days and the state of the latest alert.

    Without ``lifts`` the inventory rows must carry them.
    """
    scored = scoring.attach_sku_risk(inventory_rows, lifts, cfg)
    if alerts is None:
        state = {c: encode.null_as(_SKU_PENDING[c]) for c in ("latest_alert_id", "alert_status")}
        scored = scored.withColumns(state)
    else:
        scored = scored.join(A.latest_alert(alerts), "sku_id", "left")
    return scored.selectExpr(*sku_risk_base(inventory_rows).columns)


def alert_queue(alerts: DataFrame, risk: DataFrame) -> DataFrame:
    """Alerts with SKU context, most urgent and newest first."""
    context = risk.select(
        "sku_id",
        "sku_name",
        "category",
        "unit_price_usd",
        "days_of_cover",
        "inventory_risk_tier",
        "current_stock",
        "supplier_lead_time_days",
        "active_video_count",
        "has_viral_video",
    )
    joined = alerts.join(context, "sku_id", "left").select(
        "alert_id",
        *context.columns,
        F.col("risk_tier").alias("alert_risk_tier"),
        "p90_demand_lift",
        "p50_demand_lift",
        "p10_demand_lift",
        "investigation_summary",
        "action_draft",
        "status",
        "approved_at",
        "approved_by",
        tiers.tier_order(F.col("risk_tier")).alias("sort_order"),
        "created_at",
        "updated_at",
    )
    return joined.orderBy("sort_order", F.col("created_at").desc_nulls_last(), "alert_id")


def video_mart(
    events: DataFrame, bridge: DataFrame, skus: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Video mart straight from staged events, reading only each video's newest rows."""
    return scored_videos(FT.latest_features(events, bridge, skus), as_of)


def risk_from_videos(
    staged_skus: DataFrame,
    bridge: DataFrame,
    scored: DataFrame,
    alerts: DataFrame | None = None,
    as_of: Column | None = None,
    cfg: C.RiskConfig = C.RiskConfig(),
) -> DataFrame:
    """SKU mart from the scored video mart: signal and lifts in one pass over the tags."""
    rows = inventory.sku_inventory(staged_skus, bridge, scored, as_of, lifts=True)
    return sku_risk_mart(rows, None, alerts, cfg)
