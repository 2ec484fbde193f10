"""Tier, badge and triage rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftspark import config as C


def _ladder(value: Column, floors: Iterable[tuple[str, float]], default: str) -> Column:
    """First label whose floor the value reaches; ``floors`` run from high to low."""
    result = F.lit(default)
    for label, floor in reversed(tuple(floors)):
        result = F.when(value >= floor, label).otherwise(result)
    return result


def engagement_tier(score: Column) -> Column:
    return _ladder(score, C.BADGE_FLOORS, C.BADGE_DEFAULT)


def video_tier(p90: Column) -> Column:
    return _ladder(p90, C.VIDEO_TIER_FLOORS, "NORMAL")


def inventory_tier(cover: Column, lead_days: Column) -> Column:
    """Tier from unrounded days of cover; unknown cover is NORMAL."""
    return (
        F.when(cover < lead_days, "CRITICAL")
        .when(cover < lead_days * 2, "WARNING")
        .when(cover < C.INVENTORY_WATCH_DAYS, "WATCH")
        .otherwise("NORMAL")
    )


def below_reorder(stock: Column, reorder_point: Column) -> Column:
    return F.coalesce(stock <= reorder_point, F.lit(False))


def tier_order(tier: Column) -> Column:
    """1 for CRITICAL … 4 for NORMAL and anything unknown."""
    order = F.lit(C.TIER_ORDER["NORMAL"])
    for name in ("WATCH", "WARNING", "CRITICAL"):
        order = F.when(tier == name, C.TIER_ORDER[name]).otherwise(order)
    return order


def _tight(cover: Column, lead_days: Column, rule: C.TierRule) -> Column:
    return (cover < rule.cover_max_days) | (cover < lead_days + rule.lead_buffer_days)


def sku_tier(p90: Column, cover: Column, lead_days: Column, cfg: C.RiskConfig) -> Column:
    """Tier the scorer stores: a high lift needs short cover at every level."""
    critical, warning, watch = cfg.critical, cfg.warning, cfg.watch
    return (
        F.when((p90 >= critical.lift_min) & _tight(cover, lead_days, critical), "CRITICAL")
        .when((p90 >= warning.lift_min) & _tight(cover, lead_days, warning), "WARNING")
        .when((p90 >= watch.lift_min) & (cover < watch.cover_max_days), "WATCH")
        .otherwise("NORMAL")
    )


def triage_branch(p90: Column, cover: Column, lead_days: Column, cfg: C.RiskConfig) -> Column:
    """Name of the triage rule that fires.

    Unlike ``sku_tier``, a WARNING-level lift with ample stock is still watched,
    however long the cover.
    """
    warned = F.when(_tight(cover, lead_days, cfg.warning), "warning").otherwise("elevated")
    watched = F.when(cover < cfg.watch.cover_max_days, "watch").otherwise("comfortable")
    return (
        F.when((p90 >= cfg.critical.lift_min) & _tight(cover, lead_days, cfg.critical), "critical")
        .when(p90 >= cfg.warning.lift_min, warned)
        .when(p90 >= cfg.watch.lift_min, watched)
        .otherwise("quiet")
    )


BRANCH_TIER = {
    "critical": "CRITICAL",
    "warning": "WARNING",
    "elevated": "WATCH",
    "watch": "WATCH",
    "comfortable": "NORMAL",
    "quiet": "NORMAL",
}


def pick(branch: Column, values: dict[str, Column | str]) -> Column:
    """Value that belongs to the branch, as one CASE over its name."""
    result = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        hit = branch == name
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result
