"""Top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode, tiers


def trending(videos: DataFrame, k: int = C.TRENDING_SIZE) -> DataFrame:
    """The k videos with the highest score, ranked and dressed for display.

    The sort with limit keeps k rows per task; only the k winners meet in one partition
    to be numbered.
    """
    order = (F.col("engagement_score").desc(), F.col("video_id"))
    top = videos.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("rank", rank).select(
        "video_id",
        "platform",
        "creator_id",
        "creator_tier",
        "sku_ids_json",
        F.col("view_count").alias("total_views"),
        *[
            encode.percent(F.col(rate)).alias(f"{rate}_pct")
            for rate in ("save_rate", "share_rate", "click_rate", "cart_rate")
        ],
        F.round("engagement_score", 4).alias("engagement_score"),
        tiers.engagement_tier(F.col("engagement_score")).alias("engagement_tier"),
        "views_velocity_3h",
        "views_acceleration",
        "is_on_foryou",
        encode.age_label(F.col("hours_observed")).alias("age_label"),
        "hours_observed",
        "posted_at",
        "last_snapshot_at",
        "is_viral",
        "p50_demand_lift",
        "p90_demand_lift",
        "risk_tier_predicted",
        "rank",
        "mart_refreshed_at",
    )


def trending_page(df: DataFrame, limit: int = C.TRENDING_SIZE) -> DataFrame:
    """The first ``limit`` rows of the trending report."""
    if not 1 <= limit <= C.TRENDING_PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {C.TRENDING_PAGE_MAX}")
    return df.orderBy("rank").limit(limit)


def top_videos(videos: DataFrame, k: int = C.TOP_VIDEOS_PER_SKU) -> DataFrame:
    """Ids of the k videos with the highest P90 per SKU, best first.

    The rank filter cuts each task to k rows per SKU before the shuffle, so neither the
    exchange nor the list grows with the number of videos.
    """
    tagged = videos.filter(F.col("p90_demand_lift").isNotNull()).select(
        F.explode(encode.json_list(F.col("sku_ids_json"))).alias("sku_id"),
        "video_id",
        "p90_demand_lift",
    )
    best = Window.partitionBy("sku_id").orderBy(F.col("p90_demand_lift").desc(), "video_id")
    ranked = tagged.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_rank", "video_id")))
    return ranked.groupBy("sku_id").agg(listed["video_id"].alias("top_video_ids"))
