"""Engagement features.

All windows share one partitioning (``video_id``) and one order (``hours_since_post``),
so a feature table costs a single shuffle and a single sort. The key of the events is
(video, hour): a window partition holds at most one row per observed hour.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode, scores

RATE_COUNTS = {
    "like_rate": "like_count",
    "save_rate": "save_count",
    "share_rate": "share_count",
    "click_rate": "click_to_product",
    "cart_rate": "add_to_cart",
}
VELOCITY_DELTAS = {
    "views_velocity_3h": "views_delta_1h",
    "saves_velocity_3h": "saves_delta_1h",
    "shares_velocity_3h": "shares_delta_1h",
}


def _by_hour() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("hours_since_post")


def require(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming the columns ``df`` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def clean_rates(df: DataFrame) -> DataFrame:
    """Recompute the five rates from counts, clipped to [0, 1]."""
    require(df, ["view_count", *RATE_COUNTS.values()], "clean_rates")
    views = F.col("view_count")
    return df.withColumns(
        {rate: scores.clean_rate(F.col(count), views) for rate, count in RATE_COUNTS.items()}
    )


def hourly_deltas(df: DataFrame) -> DataFrame:
    """Hourly increments of the cumulative counts, never negative, and save velocity."""
    require(df, ["video_id", "hours_since_post", "view_count", "save_count", "share_count"])

    def delta(count: str) -> Column:
        return F.greatest(F.col(count) - F.lag(count, 1, 0).over(_by_hour()), F.lit(0))

    share = F.try_divide(F.col("saves_delta_1h").cast("double"), F.col("views_delta_1h"))
    return df.withColumns(
        {
            "views_delta_1h": delta("view_count"),
            "saves_delta_1h": delta("save_count"),
            "shares_delta_1h": delta("share_count"),
        }
    ).withColumn("save_velocity", F.round(F.coalesce(share, F.lit(0.0)), 6))


def velocity_columns(rows: int = C.VELOCITY_ROWS) -> dict[str, Column]:
    """Rolling sums over the current and the ``rows - 1`` preceding snapshots."""
    frame = _by_hour().rowsBetween(1 - rows, 0)
    return {
        name: F.coalesce(F.sum(delta).over(frame), F.lit(0))
        for name, delta in VELOCITY_DELTAS.items()
    }


def acceleration(first: str = "value") -> Column:
    """Change of the hourly views. The first row counts from zero, or is zero."""
    views = F.col("views_delta_1h")
    if first == "value":
        return F.coalesce(views - F.lag(views, 1, 0).over(_by_hour()), F.lit(0))
    if first == "zero":
        return F.coalesce(views - F.lag(views, 1).over(_by_hour()), F.lit(0))
    raise ValueError("first must be 'value' or 'zero'")


def velocity(df: DataFrame, first: str = "value", rows: int = C.VELOCITY_ROWS) -> DataFrame:
    """Add rolling velocities, acceleration and the engagement score."""
    require(
        df,
        ["video_id", "hours_since_post", *VELOCITY_DELTAS.values(), *C.SCORE_WEIGHTS],
        "velocity",
    )
    return df.withColumns(
        {
            **velocity_columns(rows),
            "views_acceleration": acceleration(first),
            "engagement_score": scores.engagement_score(),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    """Clean rates, then velocity with a first acceleration of zero."""
    return velocity(clean_rates(df), first="zero")


def enrich_summary(df: DataFrame) -> DataFrame:
    """Rows, videos and viral rows of an enrichment run."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("video_id").alias("n_videos"),
        F.count_if("is_viral").alias("viral_rows"),
    )


def sku_sensitivity(bridge: DataFrame, skus: DataFrame) -> DataFrame:
    """Average and maximum sensitivity of the SKUs a video tags."""
    return (
        bridge.select("video_id", "sku_id")
        .join(skus.select("sku_id", "viral_sensitivity"), "sku_id")
        .groupBy("video_id")
        .agg(
            F.avg("viral_sensitivity").alias("avg_sku_viral_sensitivity"),
            F.max("viral_sensitivity").alias("max_sku_viral_sensitivity"),
        )
    )


FEATURE_ROW = (
    "event_id",
    "video_id",
    "posted_at",
    "snapshot_at",
    "hours_since_post",
    "platform",
    "creator_id",
    "creator_tier",
    "sku_ids_json",
    "video_duration_s",
    "has_link_in_bio",
    "view_count",
    "like_count",
    "comment_count",
    "share_count",
    "save_count",
    "click_to_product",
    "add_to_cart",
    "save_rate",
    "share_rate",
    "click_rate",
    "cart_rate",
    "like_rate",
    "views_delta_1h",
    "saves_delta_1h",
    "shares_delta_1h",
    "save_velocity",
    "is_on_foryou",
    "trending_rank",
    "demand_lift_24h",
    "is_viral",
)


def _encoded(rows: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Row-wise features and the per-video sensitivity."""
    avg, top = F.col("avg_sku_viral_sensitivity"), F.col("max_sku_viral_sensitivity")
    return (
        rows.join(sensitivity, "video_id", "left")
        .withColumns(
            {
                "engagement_score": scores.engagement_score(),
                "creator_tier_encoded": encode.encode_ordinal(
                    F.col("creator_tier"), C.CREATOR_TIER_CODES, C.CREATOR_TIER_DEFAULT
                ),
                "platform_encoded": encode.encode_ordinal(
                    F.col("platform"), C.PLATFORM_CODES, C.PLATFORM_DEFAULT
                ),
                "sku_viral_sensitivity": F.coalesce(avg, F.lit(1.0)),
                "sku_viral_sensitivity_max": F.coalesce(top, F.lit(1.0)),
                **encode.time_parts(),
                "is_on_foryou_int": encode.bool_int(F.col("is_on_foryou")),
                "has_link_in_bio_int": encode.bool_int(F.col("has_link_in_bio")),
            }
        )
        .drop("avg_sku_viral_sensitivity", "max_sku_viral_sensitivity")
    )


def _windowed(events: DataFrame) -> DataFrame:
    return events.selectExpr(*FEATURE_ROW).withColumns(
        {**velocity_columns(), "views_acceleration": acceleration("value")}
    )


def features(events: DataFrame, bridge: DataFrame, skus: DataFrame) -> DataFrame:
    """Feature table, one row per (video, hour).

    The window columns are added in place; no self-join carries them back.
    """
    return _encoded(_windowed(events), sku_sensitivity(bridge, skus))


def latest_snapshot(df: DataFrame) -> DataFrame:
    """The row with the highest hour of each video."""
    return _newest(df, 1)


def _newest(df: DataFrame, rows: int) -> DataFrame:
    newest_first = Window.partitionBy("video_id").orderBy(F.col("hours_since_post").desc())
    rank = F.row_number().over(newest_first)
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= rows).drop("_rank")


def latest_features(events: DataFrame, bridge: DataFrame, skus: DataFrame) -> DataFrame:
    """``latest_snapshot(features(...))`` without shuffling the history.

    The features of the newest row depend on the newest ``VELOCITY_ROWS`` rows only. The
    rank filter keeps those per task before the exchange, so with files clustered by video
    48 hourly rows shrink to three on the map side.
    """
    tail = _newest(events.selectExpr(*FEATURE_ROW), max(C.VELOCITY_ROWS, 2))
    return _encoded(latest_snapshot(_windowed(tail)), sku_sensitivity(bridge, skus))
