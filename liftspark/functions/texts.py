"""Fixed alert and order texts, filled with column values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftspark.config import RiskConfig

# ---- Fixed values: text formats --------------------------------------------------
RULE = "━" * 40
PO_TEXT = (
    "🔴 URGENT PURCHASE ORDER — %s (%s)\n"
    + RULE
    + "\nQuantity: %s units | Est. Cost: $%s\n"
    "Current Stock: %s units (%s days cover)\n"
    "P90 Demand Lift: %sx baseline\n"
    "Lead Time: %s days\n" + RULE + "\n⚠️ REQUIRES HUMAN APPROVAL before submission to supplier.\n"
    "Deadline: Immediate — stock projected to deplete before next order cycle."
)
ALERT_TEXT = (
    "🟠 WARNING — Elevated Demand Risk: %s (%s)\n"
    + RULE
    + "\n• P90 Demand Lift: %sx baseline\n"
    "• Current Stock: %s units (%s days cover)\n"
    "• Active Viral Videos: %s\n"
    + RULE
    + "\n📋 Action: Review within 4 hours. Consider expedited order if trend continues."
)
NO_ACTION_TEXT = "No action required — monitoring engagement trend."
PO_URGENCY = "IMMEDIATE — stock depletion imminent under P90 scenario"
ALERT_URGENCY = "Review within 4 hours — demand trend accelerating"
SUMMARY_TEXT = (
    "SKU %s (%s) is experiencing %s predicted demand lift of %sx baseline. "
    "Current stock of %s units provides only %s days of cover under the P90 scenario, "
    "which is %s given a %s-day lead time."
)
CONFIDENCE_TEXT = (
    "Model predicts demand lift range of %sx to %sx, with median at %sx. "
    "Wide prediction interval indicates moderate uncertainty."
)
HISTORY_TEXT = (
    "Template-based analysis — no LLM available for historical comparison. "
    "Review engagement trajectory manually."
)
FACTOR_TEXTS = {
    "lift": "P90 demand lift: %sx baseline",
    "cover": "Days of cover: %s vs lead time %sd",
    "videos": "Active viral videos: %s",
    "score": "Max engagement score: %s",
    "tier": "Risk tier: %s — %s",
}
NOTICE_TEXT = "%s *%s* — %s (%s)\nP90 Lift: %sx | Stock: %s units | Cover: %sd\nAlert ID: %s"
REASON_TEXTS = {
    "critical": (
        "P90 lift %sx exceeds %sx threshold. Days of cover (%s) < %s days "
        "or < lead time (%sd). Immediate PO required."
    ),
    "warning": (
        "P90 lift %sx exceeds %sx threshold. Days of cover (%s) is tight. "
        "Human review recommended within 4 hours."
    ),
    "elevated": "P90 lift %sx is elevated but inventory (%s days) is comfortable.",
    "watch": "P90 lift %sx above %sx. Monitoring — re-evaluate next cycle.",
    "comfortable": "P90 lift %sx with comfortable inventory (%s days cover).",
    "quiet": "P90 lift %sx — no significant demand signal.",
}
EXTREME_LIFT = 3.0


STRENGTH_WORDS = ("extreme", "significant")
STOCK_WORDS = ("dangerously low", "below comfortable levels")
NOTICE_ICONS = ("🔴", "🟠")


def fixed(value: Column, digits: int) -> Column:
    """Number with exactly ``digits`` decimals and no grouping."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))


def grouped(value: Column, digits: int = 0) -> Column:
    """Number with thousands separators."""
    return F.format_number(F.round(value, digits) if digits else value, digits)


def _fill(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def reason_texts(p90: Column, cover: Column, lead_days: Column, cfg: RiskConfig) -> dict[str, Column]:
    """Reasoning of each triage branch."""
    lift, days = fixed(p90, 2), fixed(cover, 1)
    values = {
        "critical": (
            lift,
            F.lit(str(cfg.critical.lift_min)),
            days,
            F.lit(str(cfg.critical.cover_max_days)),
            lead_days.cast("string"),
        ),
        "warning": (lift, F.lit(str(cfg.warning.lift_min)), days),
        "elevated": (lift, days),
        "watch": (lift, F.lit(str(cfg.watch.lift_min))),
        "comfortable": (lift, days),
        "quiet": (lift,),
    }
    return {name: _fill(REASON_TEXTS[name], *args) for name, args in values.items()}


def purchase_order(quantity: Column, cost: Column) -> Column:
    c = F.col
    return _fill(
        PO_TEXT,
        c("sku_id"),
        c("sku_name"),
        grouped(quantity),
        grouped(cost, 2),
        grouped(c("current_stock")),
        fixed(c("days_of_cover"), 1),
        fixed(c("p90_demand_lift"), 2),
        c("supplier_lead_time_days").cast("string"),
    )


def alert_card() -> Column:
    c = F.col
    return _fill(
        ALERT_TEXT,
        c("sku_id"),
        c("sku_name"),
        fixed(c("p90_demand_lift"), 2),
        grouped(c("current_stock")),
        fixed(c("days_of_cover"), 1),
        c("active_video_count").cast("string"),
    )


def summary() -> Column:
    c = F.col
    strength = F.when(c("p90_demand_lift") >= EXTREME_LIFT, STRENGTH_WORDS[0]).otherwise(STRENGTH_WORDS[1])
    stock = F.when(
        c("days_of_cover") < c("supplier_lead_time_days"), STOCK_WORDS[0]
    ).otherwise(STOCK_WORDS[1])
    return _fill(
        SUMMARY_TEXT,
        c("sku_id"),
        c("sku_name"),
        strength,
        fixed(c("p90_demand_lift"), 1),
        grouped(c("current_stock")),
        fixed(c("days_of_cover"), 1),
        stock,
        c("supplier_lead_time_days").cast("string"),
    )


def confidence() -> Column:
    lifts = [fixed(F.col(f"{q}_demand_lift"), 1) for q in ("p10", "p90", "p50")]
    return _fill(CONFIDENCE_TEXT, *lifts)


def key_factors() -> Column:
    c = F.col
    return F.array(
        _fill(FACTOR_TEXTS["lift"], fixed(c("p90_demand_lift"), 2)),
        _fill(
            FACTOR_TEXTS["cover"],
            fixed(c("days_of_cover"), 1),
            c("supplier_lead_time_days").cast("string"),
        ),
        _fill(FACTOR_TEXTS["videos"], c("active_video_count").cast("string")),
        _fill(FACTOR_TEXTS["score"], fixed(c("max_engagement_score"), 4)),
        _fill(FACTOR_TEXTS["tier"], c("risk_tier"), c("reasoning")),
    )


def notice(alert_id: Column) -> Column:
    c = F.col
    return _fill(
        NOTICE_TEXT,
        F.when(c("risk_tier") == "CRITICAL", NOTICE_ICONS[0]).otherwise(NOTICE_ICONS[1]),
        c("risk_tier"),
        c("sku_id"),
        c("sku_name"),
        fixed(c("p90_demand_lift"), 2),
        grouped(c("current_stock")),
        fixed(c("days_of_cover"), 1),
        alert_id,
    )
