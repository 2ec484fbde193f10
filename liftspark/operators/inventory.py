"""Demand signal per SKU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import scores


SCORE_UNIT = 1_000_000


def _mean_score() -> Column:
    """Mean score, summed in whole millionths: the same in whatever order tasks finish."""
    units = F.round(F.col("engagement_score") * SCORE_UNIT).cast("bigint")
    return F.sum(units) / F.count(units) / SCORE_UNIT


def sku_signal(bridge: DataFrame, latest: DataFrame, lifts: bool = False) -> DataFrame:
    """Signal of the videos that tag a SKU, from their latest snapshots.

    The distinct count spreads a SKU by video before it is summed up, and the other
    aggregates combine on the map side, so a SKU tagged everywhere stays cheap.
    With ``lifts`` the highest predicted lifts come out of the same pass.
    """
    predicted = C.LIFT_COLUMNS if lifts else ()
    shown = latest.select(
        "video_id",
        "view_count",
        "engagement_score",
        "sku_viral_sensitivity",
        "is_viral",
        *predicted,
    )
    return (
        bridge.select("video_id", "sku_id")
        .join(shown, "video_id")
        .groupBy("sku_id")
        .agg(
            F.count_distinct("video_id").alias("active_video_count"),
            F.max("view_count").alias("max_view_count"),
            F.max("engagement_score").alias("max_engagement_score"),
            _mean_score().alias("avg_engagement_score"),
            F.max(scores.demand_pressure()).alias("demand_pressure_proxy"),
            F.bool_or("is_viral").alias("has_viral_video"),
            *[F.max(c).alias(c) for c in predicted],
        )
    )


def sku_inventory(
    skus: DataFrame,
    bridge: DataFrame,
    latest: DataFrame,
    as_of: Column | None = None,
    lifts: bool = False,
) -> DataFrame:
    """Staged SKUs with their demand signal and urgency; no video means zeros.

    With ``lifts`` the highest lifts of the SKU's videos are carried along, NULL without any.
    """
    return with_signal(skus, sku_signal(bridge, latest, lifts), as_of)


def with_signal(skus: DataFrame, signal: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Staged SKUs with a given demand signal and their urgency."""
    zero = {
        "active_video_count": F.lit(0).cast("bigint"),
        "max_view_count": F.lit(0),
        "max_engagement_score": F.lit(0.0),
        "avg_engagement_score": F.lit(0.0),
        "demand_pressure_proxy": F.lit(0.0),
        "has_viral_video": F.lit(False),
    }
    joined = skus.drop("created_at").join(signal, "sku_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, value) for c, value in zero.items()})
    return filled.withColumns(
        {
            "urgency_score": scores.urgency(
                F.col("inventory_risk_tier"), F.col("demand_pressure_proxy")
            ),
            "refreshed_at": F.current_timestamp() if as_of is None else as_of,
        }
    )
