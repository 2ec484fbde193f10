"""Triage, drafts, alert rows, throttling and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import scores, texts, tiers
from liftspark.operators import ranking
from liftspark.sources.tables import with_alert_defaults

AT_RISK_COLUMNS = (
    "sku_id",
    "sku_name",
    "category",
    "current_stock",
    "baseline_daily_demand",
    "supplier_lead_time_days",
    "unit_price_usd",
    *C.LIFT_COLUMNS,
    "active_video_count",
    "max_engagement_score",
)


def at_risk(
    risk: DataFrame,
    videos: DataFrame | None,
    cfg: C.RiskConfig = C.RiskConfig(),
    ordered: bool = True,
    best: DataFrame | None = None,
) -> DataFrame:
    """SKUs whose P90 reaches the trigger, with their best videos, highest P90 first.

    ``ordered=False`` saves the sort where the rows go on into triage and alerts; ``best`` are
    the best videos where they are known already.
    """
    chosen = risk.filter(F.col("p90_demand_lift") >= cfg.trigger_lift).select(*AT_RISK_COLUMNS)
    listed = F.coalesce("top_video_ids", F.array().cast("array<string>"))
    best = ranking.top_videos(videos) if best is None else best
    joined = chosen.join(best, "sku_id", "left")
    listed_skus = joined.withColumn("top_video_ids", listed)
    return listed_skus.orderBy(F.col("p90_demand_lift").desc(), "sku_id") if ordered else listed_skus


def triage(df: DataFrame, cfg: C.RiskConfig = C.RiskConfig()) -> DataFrame:
    """Tier, action, reasoning and escalation flag of each SKU."""
    p90, lead = F.col("p90_demand_lift"), F.col("supplier_lead_time_days")
    projected = scores.projected_days(F.col("current_stock"), F.col("baseline_daily_demand"), p90)
    cover = F.when(F.col("baseline_daily_demand") > 0, projected).otherwise(
        C.NO_DEMAND_COVER_DAYS
    )
    actions = {
        "CRITICAL": cfg.critical.action,
        "WARNING": cfg.warning.action,
        "WATCH": cfg.watch.action,
        "NORMAL": cfg.normal_action,
    }
    branch, days = F.col("_branch"), F.col("days_of_cover")
    return (
        df.withColumn("days_of_cover", cover)
        .withColumn("_branch", tiers.triage_branch(p90, days, lead, cfg))
        .withColumns(
            {
                "risk_tier": tiers.pick(branch, tiers.BRANCH_TIER),
                "reasoning": tiers.pick(branch, texts.reason_texts(p90, days, lead, cfg)),
            }
        )
        .withColumns(
            {
                "action_type": tiers.pick(F.col("risk_tier"), actions),
                "should_continue": F.col("risk_tier").isin("CRITICAL", "WARNING"),
            }
        )
        .drop("_branch")
    )


def triage_summary(triaged: DataFrame) -> DataFrame:
    """SKUs seen, and how many are CRITICAL and WARNING."""
    return triaged.agg(
        F.count(F.lit(1)).alias("total_skus"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical"),
        F.count_if(F.col("risk_tier") == "WARNING").alias("warning"),
    )


def escalated(triaged: DataFrame) -> DataFrame:
    """SKUs that go on to investigation and action."""
    return triaged.filter("should_continue")


def order_plan(df: DataFrame) -> DataFrame:
    """Add order quantity and estimated cost."""
    quantity = scores.order_quantity(
        F.col("baseline_daily_demand"),
        F.col("p90_demand_lift"),
        F.col("supplier_lead_time_days"),
        F.col("current_stock"),
    )
    return df.withColumn("recommended_quantity", quantity).withColumn(
        "estimated_cost_usd", F.col("recommended_quantity") * F.col("unit_price_usd")
    )


def draft(triaged: DataFrame) -> DataFrame:
    """Investigation and action texts of triaged SKUs.

    Quantity and cost belong to purchase orders only; other tiers have NULL there.
    """
    critical = F.col("risk_tier") == "CRITICAL"
    warning = F.col("risk_tier") == "WARNING"
    planned = order_plan(triaged)
    quantity, cost = F.col("recommended_quantity"), F.col("estimated_cost_usd")
    action = (
        F.when(critical, texts.purchase_order(quantity, cost))
        .when(warning, texts.alert_card())
        .otherwise(texts.NO_ACTION_TEXT)
    )
    urgency = (
        F.when(critical, texts.PO_URGENCY).when(warning, texts.ALERT_URGENCY).otherwise("")
    )
    drafted = planned.withColumns(
        {
            "investigation_summary": texts.summary(),
            "confidence_assessment": texts.confidence(),
            "key_factors": texts.key_factors(),
            "historical_comparison": F.lit(texts.HISTORY_TEXT),
            "action_draft": action,
            "urgency_note": urgency,
        }
    )
    return drafted.withColumns(
        {c: F.when(critical, F.col(c)) for c in ("recommended_quantity", "estimated_cost_usd")}
    )


def alert_id(sku: Column, at: Column) -> Column:
    """``alert_{time}_{hash}``. The same SKU and run give the same id; 128 bits keep ids
    apart however many SKUs alert at once."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    digest = F.substring(F.sha2(F.concat_ws("|", sku, stamp), 256), 1, 32)
    return F.concat(F.lit("alert_"), stamp, F.lit("_"), digest)


def drafted_alerts(escalated_skus: DataFrame, as_of: Column) -> DataFrame:
    """Drafts with alert id, creation time and notification line."""
    return draft(escalated_skus).withColumns(
        {"alert_id": alert_id(F.col("sku_id"), as_of), "created_at": as_of}
    ).withColumn("notification", texts.notice(F.col("alert_id")))


def build_alerts(escalated_skus: DataFrame, as_of: Column) -> DataFrame:
    """PENDING alert rows of escalated SKUs, in the schema of the alert table."""
    return with_alert_defaults(drafted_alerts(escalated_skus, as_of), as_of)


def latest_alert(alerts: DataFrame) -> DataFrame:
    """Newest alert of each SKU."""
    newest = F.max(F.struct("created_at", "alert_id", "status")).alias("newest")
    return alerts.groupBy("sku_id").agg(newest).select(
        "sku_id",
        F.col("newest.alert_id").alias("latest_alert_id"),
        F.col("newest.status").alias("alert_status"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Pending and approved alerts."""
    return alerts.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.count_if(F.col("status") == "APPROVED").alias("approved"),
    )


def cooldown(candidates: DataFrame, history: DataFrame, hours: int) -> DataFrame:
    """Candidates whose SKU has no alert in the ``hours`` up to their own time.

    History is first reduced to the earliest and latest alert per (SKU, slot of that
    length). Such an alert lies in the candidate's slot or the one before, so one equi-join
    per slot decides exactly and no SKU multiplies its alerts by its candidates.
    """
    span = hours * 3600

    def slot(ts: str) -> Column:
        return F.floor(F.unix_seconds(F.col(ts)) / span)

    slots = history.groupBy("sku_id", slot("created_at").alias("_slot")).agg(
        F.min("created_at").alias("_first"), F.max("created_at").alias("_last")
    )
    same = slots.select("sku_id", "_slot", "_first")
    before = slots.select("sku_id", (F.col("_slot") + 1).alias("_slot"), "_last")
    at = F.col("created_at")
    recent = (F.col("_first") <= at) | (F.col("_last") > at - F.make_dt_interval(hours=F.lit(hours)))
    return (
        candidates.withColumn("_slot", slot("created_at"))
        .join(same, ["sku_id", "_slot"], "left")
        .join(before, ["sku_id", "_slot"], "left")
        .filter(~F.coalesce(recent, F.lit(False)))
        .select(*candidates.columns)
    )


def _hour() -> Column:
    return F.date_trunc("hour", F.col("created_at"))


def cap_per_hour(alerts: DataFrame, n: int, stored: DataFrame | None = None) -> DataFrame:
    """The most pressing alerts of each hour, by tier, then P90: n less those ``stored``.

    The rank filter leaves n rows per hour and task before the shuffle.
    """
    tier = tiers.tier_order(F.col("risk_tier"))
    pressing = Window.partitionBy(_hour()).orderBy(
        tier, F.col("p90_demand_lift").desc_nulls_last(), "sku_id"
    )
    ranked = alerts.withColumn("_rank", F.row_number().over(pressing)).filter(F.col("_rank") <= n)
    if stored is not None:
        used = stored.groupBy(_hour().alias("_hour")).agg(F.count(F.lit(1)).alias("_used"))
        ranked = ranked.withColumn("_hour", _hour()).join(used, "_hour", "left")
        ranked = ranked.filter(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= n)
    return ranked.select(*alerts.columns)


def suppress_beyond_cap(alerts: DataFrame, stored: DataFrame, n: int) -> DataFrame:
    """All alerts; those the cap of their hour holds back have the status SUPPRESSED."""
    passed = cap_per_hour(alerts, n, stored).select("alert_id", F.lit(True).alias("_passed"))
    status = F.when(F.col("_passed"), F.col("status")).otherwise(C.SUPPRESSED)
    return alerts.join(passed, "alert_id", "left").withColumn("status", status).select(*alerts.columns)


def _first_decisions(decisions: DataFrame) -> DataFrame:
    """The decision that counts for each alert: the earliest, then the lowest id."""
    first = F.min(F.struct("decided_at", "decision_id", "decision", "approved_by"))
    return decisions.groupBy("alert_id").agg(first.alias("d")).select("alert_id", "d.*")


def apply_decisions(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts after review: PENDING ones are approved or dismissed, others stay."""
    first = _first_decisions(decisions).withColumnRenamed("approved_by", "_by")
    pending = F.col("status") == "PENDING"
    approve = F.coalesce(pending & (F.col("decision") == "approve"), F.lit(False))
    dismiss = F.coalesce(pending & (F.col("decision") == "dismiss"), F.lit(False))
    at = F.col("decided_at")
    reviewed = alerts.join(first, "alert_id", "left").withColumns(
        {
            "approved_at": F.when(approve, at).otherwise(F.col("approved_at")),
            "approved_by": F.when(approve, F.col("_by")).otherwise(F.col("approved_by")),
            "updated_at": F.when(approve | dismiss, at).otherwise(F.col("updated_at")),
            "status": F.when(approve, "APPROVED")
            .when(dismiss, "DISMISSED")
            .otherwise(F.col("status")),
        }
    )
    return reviewed.select(*alerts.columns)


def decision_outcomes(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each decision did: success, not_pending or not_found."""
    known = alerts.select("alert_id", "status")
    first = _first_decisions(decisions).select("alert_id", F.col("decision_id").alias("_first"))
    outcome = (
        F.when(F.col("status").isNull(), "not_found")
        .when((F.col("status") == "PENDING") & (F.col("decision_id") == F.col("_first")), "success")
        .otherwise("not_pending")
    )
    return (
        decisions.join(first, "alert_id", "left")
        .join(known, "alert_id", "left")
        .select("decision_id", "alert_id", "decision", outcome.alias("outcome"))
    )
