"""Rates, scores, lifts and quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftspark import config as C


def clean_rate(count: Column, views: Column) -> Column:
    """Share of views, clipped to [0, 1], zero when there are no views."""
    share = F.try_divide(count.cast("double"), views.cast("double"))
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.round(F.coalesce(clipped, F.lit(0.0)), 6)


def engagement_score() -> Column:
    """Weighted sum of the save, share and click rates."""
    terms = [F.col(rate) * weight for rate, weight in C.SCORE_WEIGHTS.items()]
    return F.round(sum(terms[1:], terms[0]), 6)


def demand_pressure() -> Column:
    """Score times sensitivity in units of the normal score."""
    return F.col("engagement_score") * F.col("sku_viral_sensitivity") / C.PRESSURE_NORM


def days_of_cover(stock: Column, demand: Column) -> Column:
    """Days the stock lasts; NULL without demand. Unrounded: tiers compare this value."""
    return F.try_divide(stock.cast("double"), demand)


def projected_days(stock: Column, demand: Column, p90: Column) -> Column:
    """Days the stock lasts under the P90 lift, the lift floored away from zero.

    NULL without demand: the tier then falls through to NORMAL.
    """
    return F.try_divide(stock.cast("double"), demand * F.greatest(p90, F.lit(C.MIN_EFFECTIVE_LIFT)))


def urgency(tier: Column, pressure: Column) -> Column:
    """Tier weight scaled by social pressure."""
    weights = {t: w for t, w in C.TIER_WEIGHTS.items() if t != "NORMAL"}
    weight = F.lit(C.TIER_WEIGHTS["NORMAL"])
    for name, value in weights.items():
        weight = F.when(tier == name, value).otherwise(weight)
    return F.round(weight * (1.0 + pressure), 3)


def rule_based_lifts(parity: bool = False) -> dict[str, Column]:
    """P10/P50/P90 lift from score, sensitivity and placement, without a model.

    ``parity=True`` leaves the score out, as a scorer that sees only the model features does.
    """
    score = F.lit(0.0) if parity else F.col("engagement_score")
    # Multipliers and floors of the rule.
    base = score * F.col("sku_viral_sensitivity") * 10.0 + F.col("is_on_foryou") * 0.5
    p50 = F.greatest(base, F.lit(0.1))
    return {
        "p10_demand_lift": F.greatest(p50 * 0.4, F.lit(0.02)),
        "p50_demand_lift": p50,
        "p90_demand_lift": F.greatest(p50 * 2.2, F.lit(0.2)),
    }


def order_quantity(
    demand: Column,
    p90: Column,
    lead_days: Column,
    stock: Column,
    safety_days: int = C.SAFETY_STOCK_DAYS,
) -> Column:
    """Units that cover lead time plus safety days under P90 demand, at least one."""
    target = F.ceil(demand * p90 * (lead_days + safety_days))
    return F.greatest(target - stock, F.lit(1)).cast("bigint")
