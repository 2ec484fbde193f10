"""Typed staging of events and SKUs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftspark.functions import scores, tiers

_FLAGS = ("has_link_in_bio", "is_on_foryou", "is_viral")


def stg_events(
    raw: DataFrame, loaded_at: Column | None = None, drop_zero_hour0: bool = False
) -> DataFrame:
    """Events with boolean flags and a load time.

    ``drop_zero_hour0`` leaves out first snapshots without a view; off by default.
    """
    loaded = F.current_timestamp() if loaded_at is None else loaded_at
    typed = raw.withColumns({c: F.col(c).cast("boolean") for c in _FLAGS})
    if drop_zero_hour0:
        typed = typed.filter("NOT (hours_since_post = 0 AND view_count = 0)")
    return typed.withColumn("_loaded_at", loaded)


def stg_skus(raw: DataFrame) -> DataFrame:
    """SKUs with days of cover, inventory tier and reorder flag."""
    cover = scores.days_of_cover(F.col("current_stock"), F.col("baseline_daily_demand"))
    return raw.select(
        "sku_id",
        F.col("name").alias("sku_name"),
        "category",
        "unit_price_usd",
        "baseline_daily_demand",
        "current_stock",
        "supplier_lead_time_days",
        "reorder_point",
        "viral_sensitivity",
        "created_at",
        F.round(cover, 2).alias("days_of_cover"),
        tiers.inventory_tier(cover, F.col("supplier_lead_time_days")).alias("inventory_risk_tier"),
        tiers.below_reorder(F.col("current_stock"), F.col("reorder_point")).alias(
            "is_below_reorder"
        ),
    )
