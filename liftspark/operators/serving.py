"""Reads behind the review screens: filters and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftspark.functions import encode, texts


def list_alerts(
    queue: DataFrame, status: str | None = None, risk_tier: str | None = None
) -> DataFrame:
    """Alert queue, optionally by status and tier in any letter case."""
    if status:
        queue = queue.filter(F.col("status") == status.upper())
    if risk_tier:
        queue = queue.filter(F.col("alert_risk_tier") == risk_tier.upper())
    return queue


def sku_risk(
    mart: DataFrame, category: str | None = None, ml_risk_tier: str | None = None
) -> DataFrame:
    """SKU risk rows, optionally by category (as written) and tier in any letter case."""
    if category:
        mart = mart.filter(F.col("category") == category)
    if ml_risk_tier:
        mart = mart.filter(F.col("ml_risk_tier") == ml_risk_tier.upper())
    return mart


def to_response(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, empty when NULL; other NULLs stay."""
    stamps = {f.name for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")}
    return df.select(
        *[encode.iso_text(F.col(c)).alias(c) if c in stamps else F.col(c) for c in df.columns]
    )


def threat_flags(mart: DataFrame) -> DataFrame:
    """Whether stock ends before a delivery could arrive; a missing tier shows as NORMAL."""
    threatened = F.col("days_of_cover") < F.col("supplier_lead_time_days")
    return mart.withColumns(
        {
            "is_threatened": F.coalesce(threatened, F.lit(False)),
            "ml_risk_tier": F.coalesce("ml_risk_tier", F.lit("NORMAL")),
            "category": F.initcap("category"),
        }
    )


def display_video(trending: DataFrame) -> DataFrame:
    """Trending rows with upper-case platform, capitalised tier and lift texts."""

    def lift_text(name: str):
        text = F.concat(texts.fixed(F.col(name), 2), F.lit("x"))
        return F.when(F.col(name).isNull(), "N/A").otherwise(text)

    return trending.select(
        "rank",
        "video_id",
        F.upper("platform").alias("platform"),
        F.initcap("creator_tier").alias("creator"),
        "total_views",
        lift_text("p50_demand_lift").alias("p50_text"),
        lift_text("p90_demand_lift").alias("p90_text"),
        F.coalesce("risk_tier_predicted", F.lit("NORMAL")).alias("tier"),
        F.coalesce("sku_ids_json", F.lit("[]")).alias("sku_ids_json"),
    )


def viral_share(videos: DataFrame) -> DataFrame:
    """Videos, viral videos and their share in percent."""
    viral = F.col("is_viral").cast("int")
    return videos.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_viral").alias("viral"),
        F.round(F.avg(viral) * 100, 1).alias("viral_pct"),
    )
