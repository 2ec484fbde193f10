"""Schemas of the raw tables; sources are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) == 3 else False) for f in fields])


_STR, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()
_LONG = T.LongType()  # counts: one hot video may pass 2^31
_BOOL, _TS = T.BooleanType(), T.TimestampType()

SKU_CATALOG = _schema(
    ("sku_id", _STR),
    ("name", _STR),
    ("category", _STR),
    ("unit_price_usd", _DBL),
    ("baseline_daily_demand", _DBL),
    ("current_stock", _INT),
    ("supplier_lead_time_days", _INT),
    ("reorder_point", _INT),
    ("viral_sensitivity", _DBL),
    ("created_at", _TS),
)

VIDEO_METADATA = _schema(
    ("video_id", _STR),
    ("platform", _STR),
    ("creator_id", _STR),
    ("creator_tier", _STR),
    ("posted_at", _TS),
    ("video_duration_s", _INT),
    ("has_link_in_bio", _BOOL),
    ("sku_ids_json", _STR),
    ("region_codes_json", _STR),
    ("is_viral", _BOOL),
)

VIDEO_SKU_BRIDGE = _schema(
    ("video_id", _STR),
    ("sku_id", _STR),
    ("platform", _STR),
    ("posted_at", _TS),
)

ENGAGEMENT_EVENTS = _schema(
    ("event_id", _STR),
    ("video_id", _STR),
    ("posted_at", _TS),
    ("snapshot_at", _TS),
    ("hours_since_post", _INT),
    ("platform", _STR),
    ("creator_id", _STR),
    ("creator_tier", _STR),
    ("sku_ids_json", _STR),
    ("video_duration_s", _INT),
    ("has_link_in_bio", _BOOL),
    ("view_count", _LONG),
    ("like_count", _LONG),
    ("comment_count", _LONG),
    ("share_count", _LONG),
    ("save_count", _LONG),
    ("click_to_product", _LONG),
    ("add_to_cart", _LONG),
    ("save_rate", _DBL),
    ("share_rate", _DBL),
    ("click_rate", _DBL),
    ("cart_rate", _DBL),
    ("like_rate", _DBL),
    ("views_delta_1h", _LONG),
    ("saves_delta_1h", _LONG),
    ("shares_delta_1h", _LONG),
    ("save_velocity", _DBL),
    ("is_on_foryou", _BOOL),
    ("trending_rank", _INT, True),
    ("region_codes_json", _STR),
    ("demand_lift_24h", _DBL, True),
    ("is_viral", _BOOL),
)

AGENT_ALERTS = _schema(
    ("alert_id", _STR),
    ("sku_id", _STR),
    ("risk_tier", _STR),
    ("p10_demand_lift", _DBL, True),
    ("p50_demand_lift", _DBL, True),
    ("p90_demand_lift", _DBL, True),
    ("investigation_summary", _STR, True),
    ("action_draft", _STR, True),
    ("status", _STR),
    ("approved_at", _TS, True),
    ("approved_by", _STR, True),
    ("created_at", _TS),
    ("updated_at", _TS),
)

RAW = {
    "sku_catalog": SKU_CATALOG,
    "video_metadata": VIDEO_METADATA,
    "video_sku_bridge": VIDEO_SKU_BRIDGE,
    "engagement_events": ENGAGEMENT_EVENTS,
    "agent_alerts": AGENT_ALERTS,
}
KEYS = {
    "sku_catalog": ["sku_id"],
    "video_metadata": ["video_id"],
    "video_sku_bridge": ["video_id", "sku_id"],
    "engagement_events": ["event_id"],
    "agent_alerts": ["alert_id"],
}
