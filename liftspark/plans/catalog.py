"""Named queries over the star-schema files, one or more per operator.

Each query takes (spark, folder) and returns a DataFrame over the whole tables. Plans that
several steps read are written to the shared folder while the query is built.
Averages are rounded at the edge, because their last bit depends on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode
from liftspark.operators import alerts as A
from liftspark.operators import evaluate as E
from liftspark.operators import features as FT
from liftspark.operators import ingest, inventory, maintenance, quality, ranking, scoring
from liftspark.operators import quantile as Q
from liftspark.operators import serving, staging
from liftspark.plans import checks, hourly, marts
from liftspark.session import scratch_path, tune
from liftspark.sources import tables, upsert
from liftspark.sources.star_schema import StarSchema, sku_key, video_key
from liftspark.streaming import cooldown as cooldown_stream
from liftspark.streaming import ingest as stream_tables
from liftspark.streaming import sinks, windows

AS_OF = "2024-02-01 00:00:00"
CUTOFF = "2024-01-30 00:00:00"
FRESH_AS_OF = "2024-02-01 06:00:00"
HORIZON = 720  # hours of the observed month
PAGE = 20
CAP = 20
BACKLOG_HORIZON = 600  # of the ingestion query, so that some hours lie beyond it
STREAM_SLICES = 3
STALE = "2024-01-05 00:00:00"  # rows before it can be sent behind the watermark
FIT = C.BoostConfig(rounds=6, learning_rate=0.3, max_depth=3, min_rows_per_leaf=5, patience=6)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


class Workbench:
    """Shared intermediate plans of the queries; nothing runs until a query is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.raw = StarSchema(spark, sf_dir)
        self.as_of = ts(AS_OF)

    def write_raw(self, *names: str) -> None:
        """Derive raw tables once, as files, for queries that read them again and again."""
        for name in names:
            vars(self.raw)[name] = tables.stage(getattr(self.raw, name), name)

    @cached_property
    def events(self) -> DataFrame:
        return staging.stg_events(FT.clean_rates(self.raw.events), self.as_of)

    @cached_property
    def staged_skus(self) -> DataFrame:
        return staging.stg_skus(self.raw.skus)

    @cached_property
    def features(self) -> DataFrame:
        return FT.features(self.events, self.raw.bridge, self.raw.skus)

    def video_mart(self, events: DataFrame) -> DataFrame:
        return marts.video_mart(events, self.raw.bridge, self.raw.skus, self.as_of)

    @cached_property
    def videos(self) -> DataFrame:
        return self.video_mart(self.events)

    @cached_property
    def scored(self) -> DataFrame:
        return marts.rule_scored(self.videos)

    @cached_property
    def stored_videos(self) -> DataFrame:
        """Scored video mart as a written table, for plans that read it more than once."""
        return tables.stage(self.scored, "scored_videos")

    def risk_mart(self, scored: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
        return marts.risk_from_videos(
            self.staged_skus, self.raw.bridge, scored, alerts, self.as_of
        )

    @cached_property
    def risk(self) -> DataFrame:
        return self.risk_mart(self.stored_videos)

    def triage(self, risk: DataFrame) -> DataFrame:
        return A.triage(A.at_risk(risk, self.stored_videos, ordered=False))

    @cached_property
    def triaged(self) -> DataFrame:
        return self.triage(self.risk)

    @cached_property
    def stored_triaged(self) -> DataFrame:
        return tables.stage(self.triaged, "triaged")

    def alerts_of(self, triaged: DataFrame) -> DataFrame:
        return A.build_alerts(A.escalated(triaged), self.as_of)

    @cached_property
    def alerts(self) -> DataFrame:
        return tables.stage(self.alerts_of(self.stored_triaged), "alerts")

    @cached_property
    def decisions(self) -> DataFrame:
        """A review round over the alerts: critical ones are approved, others dismissed;
        a part of the critical ones is decided twice, and watched SKUs have no alert."""
        alerts = self.alerts.select("alert_id", "sku_id", "risk_tier", "p90_demand_lift")
        hour = F.make_dt_interval(hours=F.lit(1))

        def decide(rows: DataFrame, tag: str, decision: Column, delay: Column) -> DataFrame:
            return rows.select(
                F.concat(F.lit(f"{tag}_"), F.col("sku_id")).alias("decision_id"),
                "alert_id",
                decision.alias("decision"),
                F.lit("ops_manager").alias("approved_by"),
                (self.as_of + delay).alias("decided_at"),
            )

        critical = F.col("risk_tier") == "CRITICAL"
        first = decide(alerts, "d1", F.when(critical, "approve").otherwise("dismiss"), hour)
        again = alerts.filter(critical & (F.col("p90_demand_lift") >= 4.0))
        second = decide(again, "d2", F.lit("dismiss"), hour * 2)
        absent = self.stored_triaged.filter("risk_tier = 'WATCH'").select(
            "sku_id", F.concat(F.lit("alert_none_"), F.col("sku_id")).alias("alert_id")
        )
        third = decide(absent, "d3", F.lit("approve"), hour * 3)
        return first.unionByName(second).unionByName(third)

    @cached_property
    def reviewed(self) -> DataFrame:
        return A.apply_decisions(self.alerts, self.decisions)

    @cached_property
    def timed_candidates(self) -> DataFrame:
        """Escalated SKUs spread over the hours of a morning by lead time."""
        delay = F.make_dt_interval(hours=F.col("supplier_lead_time_days") % 6)
        return A.escalated(self.stored_triaged).select(
            "sku_id",
            "risk_tier",
            "p90_demand_lift",
            (self.as_of + delay).alias("created_at"),
        )

    @cached_property
    def alert_history(self) -> DataFrame:
        """Earlier alerts of every at-risk SKU, at ages that follow from stock and lead."""
        age = F.make_dt_interval(hours=F.col("current_stock") % 7)
        older = F.make_dt_interval(hours=F.col("supplier_lead_time_days") % 11)
        rows = self.stored_triaged
        return rows.select("sku_id", (self.as_of - age).alias("created_at")).unionByName(
            rows.select("sku_id", (self.as_of - older).alias("created_at"))
        )


# ---- staging, features ------------------------------------------------------------
def stg_events(w: Workbench) -> DataFrame:
    return staging.stg_events(w.raw.events, w.as_of)


def stg_skus(w: Workbench) -> DataFrame:
    return w.staged_skus


def clean_rates(w: Workbench) -> DataFrame:
    return FT.clean_rates(w.raw.events).select("event_id", *FT.RATE_COUNTS)


def hourly_deltas(w: Workbench) -> DataFrame:
    counts = ("event_id", "video_id", "hours_since_post", "view_count", "save_count", "share_count")
    deltas = ("views_delta_1h", "saves_delta_1h", "shares_delta_1h", "save_velocity")
    return FT.hourly_deltas(w.raw.events.select(*counts)).select("event_id", *deltas)


_WINDOWED = (*FT.VELOCITY_DELTAS, "views_acceleration", "engagement_score")


def velocity_3h(w: Workbench) -> DataFrame:
    return FT.velocity(w.events).select("event_id", *_WINDOWED)


def enriched(w: Workbench) -> DataFrame:
    return FT.enrich(w.raw.events).select("event_id", *FT.RATE_COUNTS, *_WINDOWED)


def enrich_summary(w: Workbench) -> DataFrame:
    return FT.enrich_summary(w.raw.events)


def features(w: Workbench) -> DataFrame:
    return w.features


def sku_sensitivity(w: Workbench) -> DataFrame:
    return FT.sku_sensitivity(w.raw.bridge, w.raw.skus)


def latest_snapshot(w: Workbench) -> DataFrame:
    return FT.latest_snapshot(w.raw.events).select(
        "video_id", "event_id", "snapshot_at", "hours_since_post", "view_count"
    )


# ---- marts, ranking ---------------------------------------------------------------
def scored_videos(w: Workbench) -> DataFrame:
    return w.videos


def trending_top50(w: Workbench) -> DataFrame:
    return ranking.trending(w.scored)


def trending_page(w: Workbench) -> DataFrame:
    return ranking.trending_page(ranking.trending(w.videos), PAGE).select(
        "rank", "video_id", "total_views", "engagement_score", "engagement_tier", "age_label"
    )


def trending_display(w: Workbench) -> DataFrame:
    return serving.display_video(ranking.trending(w.scored))


def sku_signal(w: Workbench) -> DataFrame:
    return inventory.sku_signal(w.raw.bridge, w.videos)


def sku_inventory(w: Workbench) -> DataFrame:
    return inventory.sku_inventory(w.staged_skus, w.raw.bridge, w.videos, w.as_of)


# ---- scoring ----------------------------------------------------------------------
def video_lift_rule(w: Workbench) -> DataFrame:
    return scoring.lift(w.videos).select("video_id", *C.LIFT_COLUMNS)


def video_lift_parity(w: Workbench) -> DataFrame:
    return scoring.rule_based_lift(w.videos, parity=True).select("video_id", *C.LIFT_COLUMNS)


def video_tier(w: Workbench) -> DataFrame:
    return w.scored.select("video_id", "p90_demand_lift", "risk_tier_predicted")


def score_new(w: Workbench) -> DataFrame:
    """Videos with a snapshot after the cutoff, given the predictions made before it."""
    before = w.video_mart(w.events.filter(F.col("snapshot_at") < ts(CUTOFF)))
    known = scoring.with_video_tier(scoring.lift(before))
    return scoring.score_new(w.videos, known)


def attach_predictions(w: Workbench) -> DataFrame:
    before = w.video_mart(w.events.filter(F.col("snapshot_at") < ts(CUTOFF)))
    known = scoring.with_video_tier(scoring.lift(before))
    return scoring.attach_predictions(w.videos, known).select(
        "video_id", "latest_event_id", *C.LIFT_COLUMNS, "risk_tier_predicted"
    )


def sku_lift(w: Workbench) -> DataFrame:
    return scoring.sku_lift(w.scored)


def sku_risk_mart(w: Workbench) -> DataFrame:
    return w.risk_mart(w.scored)


def sku_risk_filtered(w: Workbench) -> DataFrame:
    return serving.sku_risk(w.risk_mart(w.scored), "beauty", "critical")


def sku_risk_alerted(w: Workbench) -> DataFrame:
    """SKU mart with the state of the latest alert after review."""
    return w.risk_mart(w.stored_videos, w.reviewed).select("sku_id", "ml_risk_tier", "latest_alert_id", "alert_status")


def threat_flags(w: Workbench) -> DataFrame:
    return serving.threat_flags(w.risk_mart(w.scored)).select(
        "sku_id", "category", "days_of_cover", "ml_risk_tier", "is_threatened"
    )


# ---- triage, alerts, review -------------------------------------------------------
def _joined_list(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.array_join(name, ","))


def top_videos_per_sku(w: Workbench) -> DataFrame:
    return _joined_list(ranking.top_videos(w.scored), "top_video_ids")


def at_risk(w: Workbench) -> DataFrame:
    return _joined_list(A.at_risk(w.risk, w.stored_videos), "top_video_ids")


def triage(w: Workbench) -> DataFrame:
    return w.triaged.select(
        "sku_id", "risk_tier", "action_type", "reasoning", "should_continue", "days_of_cover"
    )


def triage_summary(w: Workbench) -> DataFrame:
    return A.triage_summary(w.triaged)


def order_quantity(w: Workbench) -> DataFrame:
    return A.order_plan(w.risk_mart(w.scored)).select(
        "sku_id",
        "recommended_quantity",
        F.round("estimated_cost_usd", 2).alias("estimated_cost_usd"),
    )


def drafts(w: Workbench) -> DataFrame:
    drafted = A.drafted_alerts(A.escalated(w.triaged), w.as_of).select(
        "sku_id",
        "investigation_summary",
        "confidence_assessment",
        F.array_join("key_factors", "\n").alias("key_factors"),
        "historical_comparison",
        "action_draft",
        "urgency_note",
        "recommended_quantity",
        F.round("estimated_cost_usd", 2).alias("estimated_cost_usd"),
        "notification",
    )
    return drafted


def alerts_new(w: Workbench) -> DataFrame:
    return w.alerts_of(w.triaged)


def alert_queue(w: Workbench) -> DataFrame:
    risk = tables.stage(w.risk, "sku_risk")
    return marts.alert_queue(w.alerts_of(w.triage(risk)), risk)


def alert_list(w: Workbench) -> DataFrame:
    """Dismissed warnings as the review screen reads them."""
    queue = marts.alert_queue(w.reviewed, w.risk)
    return serving.to_response(serving.list_alerts(queue, "dismissed", "warning"))


def alert_counts(w: Workbench) -> DataFrame:
    return A.alert_counts(w.reviewed)


def decisions(w: Workbench) -> DataFrame:
    return w.reviewed.select(
        "alert_id", "sku_id", "status", "approved_at", "approved_by", "updated_at"
    )


def decision_outcomes(w: Workbench) -> DataFrame:
    return A.decision_outcomes(w.alerts, w.decisions)


def cooldown(w: Workbench) -> DataFrame:
    return A.cooldown(w.timed_candidates, w.alert_history, C.RiskConfig().cooldown_hours)


def cap_per_hour(w: Workbench) -> DataFrame:
    return A.cap_per_hour(w.timed_candidates, CAP)


def cap_with_history(w: Workbench) -> DataFrame:
    """Candidates with what the cap makes of them, given alerts stored in the same hours."""
    given = w.timed_candidates.withColumns(
        {"alert_id": F.concat(F.lit("a_"), F.col("sku_id")), "status": F.lit("PENDING")}
    )
    shifted = w.alert_history.withColumn("created_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(3)))
    return A.suppress_beyond_cap(given, shifted, 4 * CAP)


# ---- ingestion, maintenance -------------------------------------------------------
def bridge_explode(w: Workbench) -> DataFrame:
    return ingest.explode_bridge(w.raw.videos)


def next_hour(w: Workbench) -> DataFrame:
    return ingest.next_hour(w.raw.videos, w.raw.events, HORIZON)


def due_snapshots(w: Workbench) -> DataFrame:
    """Of the snapshots after the cutoff, those that directly follow the stored ones."""
    stored = w.raw.events.filter(F.col("snapshot_at") < ts(CUTOFF))
    arriving = w.raw.events.filter(F.col("snapshot_at") >= ts(CUTOFF))
    waiting = ingest.next_hour(w.raw.videos, stored, HORIZON)
    return ingest.due_snapshots(arriving, waiting).select(
        "event_id", "video_id", "hours_since_post", "view_count"
    )


def upserted(w: Workbench) -> DataFrame:
    """Catalog after the depleted rows of SKUs at their reorder point came in."""
    low = w.raw.skus.filter("current_stock <= reorder_point")
    return upsert.upsert(
        w.raw.skus, maintenance.deplete(low), ["sku_id"], [F.col("created_at").desc()]
    )


def event_keys(w: Workbench) -> DataFrame:
    """Event ids made anew from post time, video and hour."""
    key = encode.event_key(F.col("posted_at"), F.col("video_id"), F.col("hours_since_post"))
    return w.raw.events.select(key.alias("event_id"), "video_id", "hours_since_post")


def view_read(w: Workbench) -> DataFrame:
    """The staging view, read by its name."""
    tables.as_view(staging.stg_events(w.raw.events, w.as_of), "stg_engagement_events")
    return w.spark.table("stg_engagement_events").select("event_id", "platform", "view_count")


def alerts_empty_defaults(w: Workbench) -> DataFrame:
    """Alert rows that give nothing but id, SKU and tier."""
    given = w.staged_skus.select(
        F.concat(F.lit("a_"), F.col("sku_id")).alias("alert_id"),
        "sku_id",
        F.col("inventory_risk_tier").alias("risk_tier"),
    )
    return tables.with_alert_defaults(given, w.as_of)


def _stored_root(w: Workbench) -> str:
    """A root with the catalog tables stored."""
    root = scratch_path(w.spark, "root")
    w.write_raw("tags", "hourly", "skus")
    for name, df in (
        ("video_metadata", w.raw.videos),
        ("video_sku_bridge", w.raw.bridge),
        ("sku_catalog", w.raw.skus),
    ):
        hourly.store(w.spark, root, name, df)
    return root


def _backlog(w: Workbench) -> list[DataFrame]:
    """Two arrivals: history with every seventh hour missing; then several hours at once,
    the missing hours of every other video, and corrections of stored hours. Both bring rows
    that have lost their time."""
    hour, before = F.col("hours_since_post"), F.col("snapshot_at") < ts(CUTOFF)
    missing = hour % 7 == 3
    even = F.substring("video_id", -1, 1).cast("int") % 2 == 0
    events = w.raw.events
    corrected = events.filter(before & ~missing & (hour % 11 == 0))
    corrected = corrected.withColumn("view_count", F.col("view_count") + 1000)
    late = events.filter(~before).unionByName(events.filter(before & missing & even))

    def timeless(tag: str, chosen: Column) -> DataFrame:
        gone = {c: F.lit(None).cast(events.schema[c].dataType) for c in ("snapshot_at", "hours_since_post")}
        rows = events.filter(chosen).withColumns(gone)
        return rows.withColumn("event_id", F.concat("event_id", F.lit(tag)))

    return [
        events.filter(before & ~missing).unionByName(timeless("_a", hour % 13 == 5)),
        late.unionByName(corrected).unionByName(timeless("_b", hour % 17 == 5)),
    ]


def ingest_backlog(w: Workbench) -> DataFrame:
    """What is stored, and what is kept apart with its reason, after both arrivals."""
    root = scratch_path(w.spark, "root")
    w.write_raw("events")
    for batch in _backlog(w):
        hourly.ingest_batch(w.spark, root, tables.stage(batch, "arrived"), BACKLOG_HORIZON)
    kept = hourly.read(w.spark, root, "engagement_events").withColumn("reason", F.lit("stored"))
    columns = ("event_id", "video_id", "hours_since_post", "view_count", "reason")
    apart = hourly.read(w.spark, root, "quarantined_events")
    return kept.select(*columns).unionByName(apart.select(*columns))


def ingest_progress(w: Workbench) -> DataFrame:
    """Hours that each video has stored and misses after both arrivals, from its hour bits."""
    root = scratch_path(w.spark, "root")
    w.write_raw("events")
    for batch in _backlog(w):
        good, _ = ingest.within_horizon(batch, BACKLOG_HORIZON)
        hourly.mark_hours(w.spark, root, good)
    return hourly.progress(w.spark, root, BACKLOG_HORIZON)


def ingest_gaps(w: Workbench) -> DataFrame:
    """Runs of hours that are missing after the first arrival."""
    return ingest.gaps(ingest.hour_bits(_backlog(w)[0]))


def stored_upsert(w: Workbench) -> DataFrame:
    """Stored videos after the viral ones came in again, twice; some videos, of both arrivals,
    have no time of posting."""
    root = scratch_path(w.spark, "root")
    digit = F.substring("video_id", -1, 1)
    videos = w.raw.videos.withColumn("posted_at", F.when(~digit.isin("7", "9"), F.col("posted_at")))
    later = digit == "9"
    hourly.store(w.spark, root, "video_metadata", videos.filter(~later))
    again = videos.filter("is_viral").withColumn("video_duration_s", F.lit(1))
    again = again.unionByName(again).unionByName(videos.filter(later & ~F.col("is_viral")))
    hourly.store(w.spark, root, "video_metadata", again)
    return hourly.read(w.spark, root, "video_metadata")


def sku_incremental(w: Workbench) -> DataFrame:
    """SKU mart and best videos after three hourly runs, in which values of most videos fall.

    The first run knows all videos, many with values far too high; the others correct them.
    """
    root = _stored_root(w)
    digit = F.substring("video_id", -1, 1).cast("int")
    high = {
        "view_count": F.col("view_count") * 3 + 1000,
        "engagement_score": F.col("engagement_score") + 0.5,
        "is_viral": F.lit(True),
        "latest_event_id": F.concat(F.lit("early_"), "latest_event_id"),
    }
    right = tables.stage(w.videos, "videos")
    wrong = right.withColumns({c: F.when(digit < 8, v).otherwise(F.col(c)).cast(right.schema[c].dataType) for c, v in high.items()})
    for batch in (wrong, right.filter(digit < 5), right.filter((digit >= 5) & (digit < 8))):
        batch = tables.stage(batch, "batch")
        hourly.store(w.spark, root, "mart_videos", batch, ["video_id"], "hours_since_post")
        hourly.rescore(w.spark, root, w.as_of, changed=batch.select("video_id", "posted_at"))
    best = hourly.top_videos(w.spark, root).select("sku_id", F.array_join("top_video_ids", ",").alias("top_video_ids"))
    return hourly.read(w.spark, root, "mart_sku_risk").join(best, "sku_id", "left")


def _alerted_root(w: Workbench) -> str:
    root = _stored_root(w)
    hourly.replace(w.spark, root, "mart_videos", w.videos)
    hourly.rescore(w.spark, root, w.as_of)
    for _ in range(2):
        hourly.raise_alerts(w.spark, root, w.as_of)
    return root


def alerts_rerun(w: Workbench) -> DataFrame:
    """Stored alerts after the same run was made twice."""
    return hourly.read_alerts(w.spark, _alerted_root(w))


def stored_review(w: Workbench) -> DataFrame:
    """Stored alerts after two rounds of decisions, the second partly too late."""
    root = _alerted_root(w)
    first = F.col("decision_id").startswith("d1_")
    for chosen in (first, ~first):
        hourly.review(w.spark, root, w.decisions.filter(chosen))
    return hourly.read_alerts(w.spark, root).select(
        "alert_id", "sku_id", "status", "approved_at", "approved_by", "updated_at"
    )


def row_counts(w: Workbench) -> DataFrame:
    raw = w.raw
    return tables.row_counts(
        {
            "sku_catalog": raw.skus,
            "video_metadata": raw.videos,
            "video_sku_bridge": raw.bridge,
            "engagement_events": raw.events,
        }
    )


def encoded_lists(w: Workbench) -> DataFrame:
    lists = w.raw.videos.select(
        "video_id",
        encode.json_list(F.col("sku_ids_json")).alias("sku_ids"),
        encode.json_list(F.col("region_codes_json")).alias("region_codes"),
    )
    return tables.encode_lists(lists)


def viral_share(w: Workbench) -> DataFrame:
    return serving.viral_share(w.raw.videos)


def deplete(w: Workbench) -> DataFrame:
    return maintenance.deplete(w.raw.skus).select("sku_id", "current_stock")


def drift(w: Workbench) -> DataFrame:
    return maintenance.drift(w.raw.skus, seed=42).select("sku_id", "baseline_daily_demand")


# ---- quality ----------------------------------------------------------------------
def dq_report(w: Workbench) -> DataFrame:
    events = quality.check_declared(
        w.raw.events,
        ["event_id"],
        ["event_id", "video_id", "view_count", "trending_rank", "demand_lift_24h"],
        {"platform": C.PLATFORMS, "creator_tier": C.CREATOR_TIERS},
    )
    skus = quality.check_declared(
        w.staged_skus,
        ["sku_id", "sku_name"],
        ["sku_id", "sku_name", "days_of_cover"],
        {"category": C.CATEGORIES, "inventory_risk_tier": C.RISK_TIERS},
    )
    return quality.report({"engagement_events": events, "sku_catalog": skus})


def dq_suite(w: Workbench) -> DataFrame:
    """The declared tests of all tables, from raw to marts."""
    w.write_raw("tags", "hourly", "skus", "events", "videos")
    feature_rows = tables.stage(w.features, "features")
    inventory_rows = tables.stage(sku_inventory(w), "inventory")
    found = {
        "engagement_events": w.raw.events,
        "sku_catalog": w.raw.skus,
        "video_metadata": w.raw.videos,
        "video_sku_bridge": w.raw.bridge,
        "agent_alerts": w.alerts,
        "stg_engagement_events": stg_events(w),
        "stg_sku_catalog": w.staged_skus,
        "int_engagement_features": feature_rows,
        "int_sku_inventory": inventory_rows,
        "mart_scored_videos": w.stored_videos,
        "mart_sku_risk": marts.sku_risk_base(inventory_rows),
        "mart_trending_videos": ranking.trending(w.stored_videos),
    }
    return quality.report({n: quality.check_declared(found[n], *quality.DECLARED[n]) for n in quality.DECLARED})


CHECKED = ("engagement_events", "sku_catalog", "video_metadata", "video_sku_bridge")
RESENT = "2024-03-01 12:00:00"


def dq_incremental(w: Workbench) -> DataFrame:
    """Checks of the stored tables, brought up to date after each of three arrivals of events.

    The first has NULL counts and unknown platforms, the second corrects some of them on the later
    days, the third brings stored events again under another day, which the upsert cannot know.
    """
    root, hour = _stored_root(w), F.col("hours_since_post")
    w.write_raw("events")
    fixed = (hour % 13 == 5) & (F.col("snapshot_at") >= ts(CUTOFF))
    broken = w.raw.events.withColumn("view_count", F.when(hour % 13 != 5, F.col("view_count")))
    broken = broken.withColumn("platform", F.when(hour % 11 == 3, F.lit("other")).otherwise(F.col("platform")))
    again = w.raw.events.filter((hour % 19 == 4) & (F.col("snapshot_at") < ts(CUTOFF)))
    for batch in (broken, w.raw.events.filter(fixed), again.withColumn("snapshot_at", ts(RESENT))):
        hourly.store(w.spark, root, "engagement_events", batch)
        for name in CHECKED:
            checks.refresh(w.spark, root, name)
    return checks.report(w.spark, root, CHECKED)


def quarantine_videos(w: Workbench) -> DataFrame:
    _, bad = quality.validate(w.raw.videos, quality.video_rules())
    return _joined_list(bad.select("video_id", "reasons"), "reasons")


def dq_freshness(w: Workbench) -> DataFrame:
    return quality.check_freshness(w.raw.events, ts(FRESH_AS_OF))


def quarantine_events(w: Workbench) -> DataFrame:
    _, bad = quality.validate(w.raw.events, quality.event_rules())
    return _joined_list(bad.select("event_id", "reasons"), "reasons")


def valid_events(w: Workbench) -> DataFrame:
    good, _ = quality.validate(w.raw.events, quality.event_rules())
    return good.select("event_id", "video_id", "save_rate", "like_rate")


def quarantine_skus(w: Workbench) -> DataFrame:
    _, bad = quality.validate(w.raw.skus, quality.sku_rules())
    return _joined_list(bad.select("sku_id", "reasons"), "reasons")


# ---- label, evaluation, learning --------------------------------------------------
def lift_label(w: Workbench) -> DataFrame:
    reach = w.raw.events.groupBy("video_id").agg(
        F.min("posted_at").alias("posted_at"), F.max("hours_since_post").alias("last_hour")
    )
    posts = reach.withColumn("periods", F.floor(F.col("last_hour") / 24) + 1)
    return E.demand_lift_label(w.raw.sales.withColumnRenamed("cents", "amount"), posts)


def sku_sales_24h(w: Workbench) -> DataFrame:
    """Sales of each tagged SKU in the day after the post."""
    part = "CAST(get_json_object(props, '$.k') AS BIGINT) + 100 * (user_id % 20)"
    sales = w.raw.table("events").filter("event_type = 'purchase'").selectExpr(
        f"{sku_key(part)} AS sku_id", "CAST(ts AS TIMESTAMP) AS sold_at", "CAST(round(value * 100) AS BIGINT) AS amount"
    )
    return E.sku_sales_within(sales, w.raw.bridge)


def eval_metrics(w: Workbench) -> DataFrame:
    metrics = E.evaluate(w.stored_videos)
    return metrics.select(*[F.round(c, 4).alias(c) for c in metrics.columns])


def quantile_fit_predict(w: Workbench) -> DataFrame:
    """Fit the three quantiles on the labelled videos and predict all of them."""
    return Q.predict(w.videos, Q.fit(w.videos, FIT)).select(
        "video_id", C.LABEL, *C.LIFT_COLUMNS
    )


def train_split(w: Workbench) -> DataFrame:
    """The part each labelled video falls into."""
    labelled = w.videos.filter(F.col(C.LABEL).isNotNull()).select("video_id")
    train, valid = Q.split(labelled)
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


def feature_rows(w: Workbench) -> DataFrame:
    """The assembled feature vector of each video, spread over columns again."""
    vectors = Q.assemble(w.videos).select("video_id", vector_to_array("_features").alias("x"))
    return vectors.select("video_id", *[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(len(C.FEATURE_COLUMNS))])


# (quantile, start, [(feature, threshold, low, high)]): one split per tree.
SMALL_TREES = (
    ("p10", 0.5, [("hours_since_post", 300.0, 0.25, -0.25), ("save_velocity", 0.05, 0.125, 0.5)]),
    ("p50", 0.75, [("like_rate", 0.03, -0.5, 0.25), ("views_delta_1h", 100.0, 0.0, 1.5)]),
    ("p90", 1.0, [("is_on_foryou", 0.5, -1.25, 2.0), ("hours_since_post", 500.0, 0.5, 0.125)]),
)


def _small_models(w: Workbench) -> dict[str, Q.QuantileModel]:
    rows = []
    for q, start, trees in SMALL_TREES:
        rows.append((q, C.QUANTILES[q], start, -1, 0, None, None, None, None, None))
        for number, (name, threshold, low, high) in enumerate(trees):
            feature = C.FEATURE_COLUMNS.index(name)
            nodes = ((feature, threshold, 1, 2, 0.0), (-1, 0.0, 1, 1, low), (-1, 0.0, 2, 2, high))
            rows += [(q, C.QUANTILES[q], start, number, n, *node) for n, node in enumerate(nodes)]
    return Q.from_nodes(w.spark.createDataFrame(rows, Q.NODES))


def tree_predict(w: Workbench) -> DataFrame:
    """Predictions of a small node table: leaves added up, ordered, not below zero."""
    return Q.predict(w.videos, _small_models(w)).select("video_id", *C.LIFT_COLUMNS)


def model_lift(w: Workbench) -> DataFrame:
    """Lifts and tier of all videos by a model that was saved and is loaded again."""
    path = scratch_path(w.spark, "model")
    Q.save_models(w.spark, _small_models(w), path)
    scored = scoring.with_video_tier(scoring.lift(w.videos, path))
    return scored.select("video_id", *C.LIFT_COLUMNS, "risk_tier_predicted")


def model_metrics(w: Workbench) -> DataFrame:
    """Metrics of a saved model on the videos held out from training."""
    path = scratch_path(w.spark, "model")
    Q.save_models(w.spark, _small_models(w), path)
    _, held_out = Q.split(w.videos.filter(F.col(C.LABEL).isNotNull()))
    metrics = E.evaluate(tables.stage(scoring.lift(held_out, path), "scored"))
    return metrics.select(*[F.round(c, 4).alias(c) for c in metrics.columns])


def fit_quality(w: Workbench) -> DataFrame:
    """Whether a fit orders its quantiles, beats constants and covers what it should."""
    scored = tables.stage(quantile_fit_predict(w).filter(F.col(C.LABEL).isNotNull()), "scored")
    y, checks = F.col(C.LABEL), {}
    p10, p50, p90 = C.LIFT_COLUMNS
    checks["is_ordered"] = F.min((F.col(p10) <= F.col(p50)) & (F.col(p50) <= F.col(p90)))
    for q, alpha in C.QUANTILES.items():
        flat = F.lit(scored.agg(F.percentile_approx(y, alpha, Q.SKETCH_ACCURACY)).first()[0])
        lift = F.col(f"{q}_demand_lift")
        # The best constant is in reach of the fit; many labels are zero and tie with it.
        checks[f"{q}_near_or_below_constant"] = E.pinball(y, lift, alpha) <= E.pinball(y, flat, alpha) * 1.05
        checks[f"{q}_covers"] = (E.coverage(y, lift) > alpha - 0.15) & (
            F.avg((y < lift).cast("int")) < alpha + 0.15
        )
    return scored.agg(*[c.alias(n) for n, c in checks.items()])


def train_metrics(w: Workbench) -> DataFrame:
    """Metrics of the held-out videos that a training run appends."""
    root = scratch_path(w.spark, "root")
    hourly.replace(w.spark, root, "mart_videos", w.videos)
    hourly.train(w.spark, root, f"{root}/model", FIT, w.as_of)
    return hourly.read(w.spark, root, "train_metrics")


# ---- streams ----------------------------------------------------------------------
def _in_slices(df: DataFrame, time: str, folder: str, run: Callable[[bool], None]) -> None:
    """Let the rows arrive in slices of time: each is written by all tasks, then the job runs over it.

    ``run`` is told whether the slice is the last one.
    """
    low, high = df.agg(F.min(time), F.max(time)).first()
    step = (high - low) / STREAM_SLICES
    at = F.col(time)
    for i in range(STREAM_SLICES):
        last = i == STREAM_SLICES - 1
        inside = at >= F.lit(low + i * step) if i else F.lit(True)
        if not last:
            inside &= at < F.lit(low + (i + 1) * step)
        df.filter(inside).write.mode("append").parquet(folder)
        run(last)


def _activity_stream(w: Workbench, folder: str) -> DataFrame:
    arriving = sinks.file_stream(w.spark, tables.make_folder(w.spark, folder), w.raw.table("events").schema)
    part = "CAST(get_json_object(props, '$.k') AS BIGINT) + 100 * (user_id % 20)"
    return arriving.selectExpr(
        f"{video_key()} AS video_id",
        f"{sku_key(part)} AS sku_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type",
        "value",
    )


def _closed_and_open(w: Workbench, windowed: Callable, read: Callable) -> DataFrame:
    folder, table, progress = (scratch_path(w.spark, n) for n in ("arriving", "windows", "progress"))
    stream = windowed(_activity_stream(w, folder))
    _in_slices(w.raw.table("events"), "ts", folder, lambda last: sinks.write_final(stream, table, progress))
    return read(w.spark, table, progress, stream)


def stream_hourly(w: Workbench) -> DataFrame:
    return _closed_and_open(w, windows.stream_hourly, windows.read_hourly)


def stream_velocity(w: Workbench) -> DataFrame:
    return _closed_and_open(w, windows.stream_velocity, windows.read_velocity)


def stream_ingest(w: Workbench) -> DataFrame:
    folder, root, progress = (scratch_path(w.spark, n) for n in ("arriving", "root", "progress"))

    def run(last: bool) -> None:
        stream_tables.stream_ingest(w.spark, folder, root, progress, horizon=HORIZON)

    _in_slices(tables.stage(w.raw.events, "events"), "snapshot_at", folder, run)
    return hourly.read(w.spark, root, "engagement_events")


def stream_distinct(w: Workbench) -> DataFrame:
    """What is stored and what is kept apart, of a source that sends rows again and again.

    Each slice also brings rows of the slice before; some rows of the first days come in the last
    slice only, behind the watermark.
    """
    folder, root, progress = (scratch_path(w.spark, n) for n in ("arriving", "root", "progress"))
    every, hour = tables.stage(w.raw.events, "events"), F.col("hours_since_post")
    low, high = every.agg(F.min("snapshot_at"), F.max("snapshot_at")).first()
    step = (high - low) / STREAM_SLICES
    withheld = (F.col("snapshot_at") < ts(STALE)) & (hour % 29 == 7)
    for i in range(STREAM_SLICES):
        at = F.floor((F.unix_micros("snapshot_at") - F.unix_micros(F.lit(low))) / F.lit(step.total_seconds() * 1e6))
        sent = F.least(at, F.lit(STREAM_SLICES - 1))
        chosen = (sent == i) & ~withheld | withheld & F.lit(i == STREAM_SLICES - 1)
        arrived = every.filter(chosen)
        for repeated in ((sent == i) & (hour % 3 == 0), (sent == i - 1) & (hour % 5 == 0)):
            arrived = arrived.unionByName(every.filter(repeated & ~withheld))
        arrived.write.mode("append").parquet(folder)
        stream_tables.stream_distinct(w.spark, folder, root, progress, "2 days", horizon=BACKLOG_HORIZON)
    columns = ("event_id", "video_id", "hours_since_post", "view_count", "reason")
    kept = hourly.read(w.spark, root, "engagement_events").withColumn("reason", F.lit("stored"))
    return kept.select(*columns).unionByName(hourly.read(w.spark, root, "quarantined_events").select(*columns))


def stream_refresh(w: Workbench) -> DataFrame:
    folder, root, progress = scratch_path(w.spark, "arriving"), _stored_root(w), scratch_path(w.spark, "progress")

    def run(last: bool) -> None:
        stream_tables.stream_refresh(w.spark, folder, root, progress, w.as_of, horizon=HORIZON)

    _in_slices(tables.stage(w.raw.events, "events"), "snapshot_at", folder, run)
    return hourly.read(w.spark, root, "mart_videos").drop(hourly.DAY)


def stream_cooldown(w: Workbench) -> DataFrame:
    """Purchases as demand candidates of their SKU, thinned to one alert per pause."""
    folder, out, state = (scratch_path(w.spark, n) for n in ("arriving", "alerts", "state"))
    candidates = (
        _activity_stream(w, folder)
        .filter("event_type = 'purchase'")
        .select("sku_id", F.col("ts").alias("created_at"), F.col("value").alias("p90_demand_lift"))
    )

    def run(last: bool) -> None:
        cooldown_stream.run_cooldown(candidates, out, state)

    _in_slices(w.raw.table("events"), "ts", folder, run)
    closed = cooldown_stream.read_alerts(w.spark, out)
    return closed.unionByName(cooldown_stream.read_due(w.spark, out, state))


QUERIES: tuple[Callable[[Workbench], DataFrame], ...] = (
    stg_events,
    stg_skus,
    clean_rates,
    hourly_deltas,
    velocity_3h,
    enriched,
    enrich_summary,
    features,
    sku_sensitivity,
    latest_snapshot,
    scored_videos,
    trending_top50,
    trending_page,
    trending_display,
    sku_signal,
    sku_inventory,
    video_lift_rule,
    video_lift_parity,
    video_tier,
    score_new,
    attach_predictions,
    sku_lift,
    sku_risk_mart,
    sku_risk_filtered,
    sku_risk_alerted,
    threat_flags,
    top_videos_per_sku,
    at_risk,
    triage,
    triage_summary,
    order_quantity,
    drafts,
    alerts_new,
    alert_queue,
    alert_list,
    alert_counts,
    decisions,
    decision_outcomes,
    cooldown,
    cap_per_hour,
    cap_with_history,
    bridge_explode,
    next_hour,
    due_snapshots,
    upserted,
    event_keys,
    view_read,
    alerts_empty_defaults,
    ingest_backlog,
    ingest_progress,
    ingest_gaps,
    stored_upsert,
    sku_incremental,
    alerts_rerun,
    stored_review,
    row_counts,
    encoded_lists,
    viral_share,
    deplete,
    drift,
    dq_report,
    dq_suite,
    dq_incremental,
    dq_freshness,
    quarantine_events,
    valid_events,
    quarantine_skus,
    quarantine_videos,
    lift_label,
    sku_sales_24h,
    eval_metrics,
    quantile_fit_predict,
    train_split,
    feature_rows,
    tree_predict,
    model_lift,
    model_metrics,
    fit_quality,
    train_metrics,
    stream_hourly,
    stream_velocity,
    stream_ingest,
    stream_distinct,
    stream_refresh,
    stream_cooldown,
)
