"""Demand-lift scoring of videos and SKUs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode, scores, tiers

PREDICTION_KEY = ("video_id", "latest_event_id")


def rule_based_lift(videos: DataFrame, parity: bool = False) -> DataFrame:
    """Add the three lifts of the rule."""
    return videos.withColumns(scores.rule_based_lifts(parity))


def lift(videos: DataFrame, model_path: str | None = None) -> DataFrame:
    """Add the three lifts from the saved models, or from the rule without them."""
    from liftspark.operators import quantile
    from liftspark.sources import stored

    if model_path and stored.exists(videos.sparkSession, model_path):
        return quantile.predict(videos, quantile.load_models(videos.sparkSession, model_path))
    return rule_based_lift(videos)


def with_video_tier(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn(
        "risk_tier_predicted", tiers.video_tier(F.col("p90_demand_lift"))
    )


def unscored(videos: DataFrame, predictions: DataFrame) -> DataFrame:
    """Videos whose latest snapshot has no prediction."""
    return videos.join(predictions.select(*PREDICTION_KEY), list(PREDICTION_KEY), "left_anti")


def score_new(
    videos: DataFrame, predictions: DataFrame, model_path: str | None = None
) -> DataFrame:
    """Predictions of the unscored videos, to be appended to the prediction table."""
    features = videos.drop(*C.LIFT_COLUMNS, "risk_tier_predicted")
    scored = with_video_tier(lift(unscored(features, predictions), model_path))
    return scored.select(*PREDICTION_KEY, *C.LIFT_COLUMNS, "risk_tier_predicted")


def attach_predictions(videos: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fill the prediction columns of the video mart; unpredicted videos keep NULL."""
    pending = (*C.LIFT_COLUMNS, "risk_tier_predicted")
    filled = videos.drop(*pending).join(
        predictions.select(*PREDICTION_KEY, *pending), list(PREDICTION_KEY), "left"
    )
    return filled.select(*videos.columns)


def sku_lift(videos: DataFrame) -> DataFrame:
    """Highest p10, p50 and p90 of the videos that tag a SKU, each on its own.

    The tags come with the video row, so there is no join; malformed lists are skipped.
    """
    return (
        videos.filter(F.col("p90_demand_lift").isNotNull())
        .select(F.explode(encode.json_list(F.col("sku_ids_json"))).alias("sku_id"), *C.LIFT_COLUMNS)
        .groupBy("sku_id")
        .agg(*[F.max(c).alias(c) for c in C.LIFT_COLUMNS])
    )


def ml_risk(df: DataFrame, cfg: C.RiskConfig = C.RiskConfig()) -> DataFrame:
    """Add projected stock-out days and the SKU tier."""
    p90, lead = F.col("p90_demand_lift"), F.col("supplier_lead_time_days")
    days = scores.projected_days(F.col("current_stock"), F.col("baseline_daily_demand"), p90)
    return df.withColumns(
        {"projected_stockout_days": days, "ml_risk_tier": tiers.sku_tier(p90, days, lead, cfg)}
    )


def attach_sku_risk(
    skus: DataFrame, lifts: DataFrame | None = None, cfg: C.RiskConfig = C.RiskConfig()
) -> DataFrame:
    """Lifts and tier per SKU; a SKU without scored videos stays at baseline demand.

    Without ``lifts`` the lift columns of ``skus`` are taken as they are.
    """
    joined = skus if lifts is None else skus.drop(*C.LIFT_COLUMNS).join(lifts, "sku_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in C.LIFT_COLUMNS})
    return ml_risk(filled, cfg)
