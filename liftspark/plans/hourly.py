"""Runs over stored tables: hourly pipeline, daily catalog refresh, training, review.

Every step ends in a committed table (``sources.stored``) and the next one starts from it,
so a lost executor costs the running step only, and a run that is repeated changes nothing.
Events and features lie by the day of the snapshot, videos by the day of the post: a run
reads and writes the days of its batch. Alerts and decisions are only appended; the state
of an alert is derived from both when it is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark import schemas
from liftspark.operators import alerts as A
from liftspark.operators import evaluate, incremental, ingest, inventory, maintenance, quantile, scoring, staging
from liftspark.operators import features as FT
from liftspark.plans import marts
from liftspark.session import tune
from liftspark.sources import stored, tables

DAY = "day"
STREAM_BATCH = "stream_batch"
# The time whose day a table lies by; tables without are one part.
_DAY_OF = {
    "engagement_events": "snapshot_at",
    "engagement_features": "snapshot_at",
    "quarantined_events": "snapshot_at",
    "video_metadata": "posted_at",
    "video_sku_bridge": "posted_at",
    "mart_videos": "posted_at",
    "video_predictions": "posted_at",
    "sku_changes": "posted_at",
    "video_hours": "posted_at",
}
_UNDATED = (
    "sku_catalog",
    "sku_state",
    "mart_sku_risk",
    "agent_alerts",
    "alert_decisions",
    "prediction_history",
    "train_metrics",
)
_NEWEST = {
    "engagement_events": "snapshot_at",
    "video_metadata": "posted_at",
    "video_sku_bridge": "posted_at",
    "sku_catalog": "created_at",
}
PREDICTION = (
    "video_id string, posted_at timestamp, latest_event_id string, p10_demand_lift double,"
    " p50_demand_lift double, p90_demand_lift double, risk_tier_predicted string"
)
HOURS = "video_id string, posted_at timestamp, word int, bits bigint"
DECISION = (
    "decision_id string, alert_id string, decision string, approved_by string,"
    " decided_at timestamp, outcome string"
)


def _path(root: str, name: str) -> str:
    return tables.table_path(root, name)


def _part(name: str) -> str | None:
    return DAY if name in _DAY_OF else None


def _dated(name: str, df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.to_date(_DAY_OF[name])) if name in _DAY_OF else df


def _schema(spark: SparkSession, root: str, name: str):
    """Declared schema of a raw table, or that a derived one was written with."""
    return schemas.RAW[name] if name in schemas.RAW else stored.schema_of(spark, _path(root, name))


def _days(df: DataFrame, time: str) -> list:
    """Days of a batch, None for unknown ones."""
    found = df.select(F.to_date(time)).distinct().limit(stored.MAX_PARTS + 1).collect()
    if len(found) > stored.MAX_PARTS:
        raise ValueError(f"a batch may touch {stored.MAX_PARTS} days at most")
    return [r[0] for r in found]


def read(spark: SparkSession, root: str, name: str, days=None, between=None) -> DataFrame:
    """A stored table, or the rows of some days; alerts come in their present state."""
    if name == "agent_alerts":
        return read_alerts(spark, root)
    schema = _schema(spark, root, name)
    return stored.read(spark, _path(root, name), schema, _part(name), days, between)


def store(spark: SparkSession, root: str, name: str, new: DataFrame, keys=None, newest=None) -> None:
    """Insert or replace rows by key; of rows with one key the newest counts."""
    tune(spark)
    order = [F.col(newest or _NEWEST[name]).desc()]
    keys = keys or schemas.KEYS[name]
    stored.upsert(spark, _path(root, name), _dated(name, new), keys, order, _part(name))


def replace(spark: SparkSession, root: str, name: str, df: DataFrame) -> None:
    """Full refresh of a table, which ``df`` may read."""
    number = stored.next_number(spark, _path(root, name))
    stored.publish(spark, _path(root, name), _dated(name, df), _part(name), number=number)


def _appended(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Rows of a table that is only appended to."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return stored.read(spark, _path(root, name), schema)


def _append(spark: SparkSession, root: str, name: str, df: DataFrame) -> None:
    """Add rows; the small folders of many runs are put together now and then."""
    stored.append(spark, _path(root, name), df)
    stored.compact(spark, _path(root, name), df.schema)




def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Alerts with the decisions taken so far."""
    alerts = _appended(spark, root, "agent_alerts", schemas.AGENT_ALERTS)
    decisions = _appended(spark, root, "alert_decisions", DECISION)
    return A.apply_decisions(alerts, decisions.filter("outcome = 'success'").drop("outcome"))


def ingest_batch(
    spark: SparkSession, root: str, batch: DataFrame, horizon: int = C.SNAPSHOT_HORIZON_HOURS
) -> None:
    """Store every arriving snapshot: backlog, late hours and corrections alike.

    Rows without a key or outside the hours that are tracked go to ``quarantined_events`` with a
    reason; those without an id are known by their whole content, so that none replaces another.
    """
    good, beyond = ingest.within_horizon(batch, horizon)
    store(spark, root, "engagement_events", good)
    mark_hours(spark, root, good)
    set_apart(spark, root, beyond)


def set_apart(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Store rows with a ``reason`` in the quarantine, once however often they come."""
    if rows.isEmpty():
        return
    whole = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    keyed = rows.withColumn("row_key", F.coalesce("event_id", whole))
    store(spark, root, "quarantined_events", keyed, ["row_key"], "snapshot_at")


def append_events(spark: SparkSession, root: str, events: DataFrame, stream: str, batch_id: int) -> None:
    """Add the new events of a stream's batch, which is named in the commit and so added once."""
    tune(spark)
    path, mark = _path(root, "engagement_events"), f"{STREAM_BATCH} {stream}"
    if stored.entry(spark, path)["meta"].get(mark, -1) < batch_id:
        stored.append(spark, path, _dated("engagement_events", events), DAY, {mark: batch_id})
        stored.compact(spark, path, schemas.RAW["engagement_events"], DAY)


def not_stored(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Events whose id is not stored under their day, as ``late``, or ``no_time`` if they have none.

    Only the days of the rows are read.
    """
    days = [d for d in _days(rows, "snapshot_at") if d is not None]
    known = read(spark, root, "engagement_events", days).select("event_id")
    reason = F.when(F.col("snapshot_at").isNull(), "no_time").otherwise("late")
    return rows.join(known, "event_id", "left_anti").select(*rows.columns, reason.alias("reason"))


def _hours_of(spark: SparkSession, root: str, days: list | None = None) -> DataFrame:
    schema = spark.createDataFrame([], HOURS).schema
    return stored.read(spark, _path(root, "video_hours"), schema, DAY, days)


def mark_hours(spark: SparkSession, root: str, events: DataFrame) -> None:
    """Set the bits of the events' hours; only the days on which their videos were posted are read.

    Events that are marked twice, or a run that is repeated, change nothing.
    """
    new = tables.stage(ingest.hour_bits(events), "hours")
    days = _days(new, "posted_at")
    if not days:
        return

    def write() -> None:
        path = _path(root, "video_hours")
        number = stored.next_number(spark, path)
        words = ingest.merged_bits(_hours_of(spark, root, days).unionByName(new))
        stored.publish(spark, path, _dated("video_hours", words), DAY, days, number)

    stored.again(write)


def progress(spark: SparkSession, root: str, horizon: int = C.SNAPSHOT_HORIZON_HOURS) -> DataFrame:
    """Hours stored, missing and reached of every video with snapshots, without reading those."""
    return ingest.progress(_hours_of(spark, root), horizon)


def gaps(spark: SparkSession, root: str) -> DataFrame:
    """Runs of hours that are missing, by video."""
    return ingest.gaps(_hours_of(spark, root))


def _around(batch: DataFrame, hours: int) -> tuple[dt.date, dt.date] | None:
    """First and last day that rows of the batch's videos can lie on."""
    low, high = batch.agg(F.min("snapshot_at"), F.max("snapshot_at")).first()
    if low is None:
        return None
    reach = dt.timedelta(hours=hours)
    return (low - reach).date(), (high + reach).date()


def refresh_touched(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    as_of: Column,
    horizon: int = C.SNAPSHOT_HORIZON_HOURS,
) -> None:
    """Features and mart rows after a batch.

    A snapshot changes its own features and those of the rows that look back on it, so
    those rows are written; the others keep theirs. A video lives for ``horizon`` hours,
    which bounds the days that are read.
    """
    tune(spark)
    with tables.scratch(spark):
        keys = batch.select("video_id", "event_id", "snapshot_at", "posted_at").distinct()
        keys = tables.stage(keys, "keys")
        days = _around(keys, horizon)
        if days is None:
            return
        videos = keys.select("video_id").distinct()
        near = read(spark, root, "engagement_events", between=days)
        events = near.join(videos, "video_id", "left_semi").select(*near.columns)
        bridge = read(spark, root, "video_sku_bridge", days=_days(keys, "posted_at"))
        bridge = bridge.join(videos, "video_id", "left_semi")
        staged = staging.stg_events(FT.clean_rates(events), as_of)
        rows = FT.features(staged, bridge, read(spark, root, "sku_catalog"))
        back = Window.partitionBy("video_id").orderBy("hours_since_post")
        changed = (
            events.select("event_id", "video_id", "hours_since_post")
            .join(keys.select("event_id", F.lit(1).alias("_new")), "event_id", "left")
            .withColumn("_new", F.max("_new").over(back.rowsBetween(1 - max(C.VELOCITY_ROWS, 2), 0)))
            .filter("_new = 1")
            .select("video_id", "event_id")
            .distinct()
        )
        # Both sides lie by video already, so the rows are not moved to be marked.
        names, flagged = rows.columns, changed.withColumn("_changed", F.lit(True))
        rows = rows.join(flagged, ["video_id", "event_id"], "left").select(*names, "_changed")
        rows = tables.stage(rows, "features")
        latest = marts.scored_videos(FT.latest_snapshot(rows), as_of)
        written = rows.filter("_changed").select(*names)
        store(spark, root, "engagement_features", written, ["event_id"], "hours_since_post")
        store(spark, root, "mart_videos", latest, ["video_id"], "hours_since_post")


def rebuild_videos(spark: SparkSession, root: str, as_of: Column) -> None:
    """Features and video mart anew from all stored events."""
    tune(spark)
    staged = staging.stg_events(FT.clean_rates(read(spark, root, "engagement_events")), as_of)
    rows = FT.features(staged, read(spark, root, "video_sku_bridge"), read(spark, root, "sku_catalog"))
    replace(spark, root, "engagement_features", rows)
    latest = FT.latest_snapshot(read(spark, root, "engagement_features"))
    replace(spark, root, "mart_videos", marts.scored_videos(latest, as_of))


def read_videos(spark: SparkSession, root: str, days=None) -> DataFrame:
    """Video mart, or that of some days of posting, with the newest prediction of each video.

    A prediction counts where it is for the video's latest row.
    """
    schema = spark.createDataFrame([], PREDICTION).schema
    predictions = stored.read(spark, _path(root, "video_predictions"), schema, DAY, days)
    return scoring.attach_predictions(read(spark, root, "mart_videos", days=days), predictions)


def _changed_rows(spark: SparkSession, root: str, changed: DataFrame | None) -> tuple[DataFrame, list | None]:
    """Video mart rows of the changed videos, and the days they were posted on; all without."""
    if changed is None:
        return read_videos(spark, root), None
    days = _days(changed, "posted_at")
    return read_videos(spark, root, days).join(changed.select("video_id"), "video_id", "left_semi"), days


def _state_of(spark: SparkSession, root: str, buckets: list | None = None) -> DataFrame:
    schema = spark.createDataFrame([], incremental.STATE).schema
    return stored.read(spark, _path(root, "sku_state"), schema, "bucket", buckets)


def _through(spark: SparkSession, root: str) -> int:
    """Number of the last version of the changes that the SKU state has taken in."""
    return int(stored.entry(spark, _path(root, "sku_state"))["meta"].get("applied", -1))


def note_changes(spark: SparkSession, root: str, changed: DataFrame | None = None) -> None:
    """Write down what the changed videos add to their SKUs now, beside what the state knows.

    Reads and writes the days on which these videos were posted.
    """
    path, schema = _path(root, "sku_changes"), spark.createDataFrame([], incremental.CHANGES).schema
    videos, days = _changed_rows(spark, root, changed)
    now = incremental.contributions(videos, read(spark, root, "video_sku_bridge", days=days))
    now = tables.stage(now, "contributions")

    def write() -> None:
        number, through = stored.next_number(spark, path), _through(spark, root)
        known = stored.read(spark, path, schema, DAY, days)
        rows = incremental.changes(now, known, int(number), through)
        kept = known.join(now.select("video_id"), "video_id", "left_anti")
        dated = _dated("sku_changes", kept.unionByName(rows.select(*schema.names)))
        stored.publish(spark, path, dated, DAY, days, number)

    stored.again(write)


def refresh_skus(spark: SparkSession, root: str, spare: int = incremental.SPARE) -> None:
    """Bring the SKU state up to the noted changes.

    The state's log entry names the version of the changes it has taken in. Later changes lie in
    the folders that are new since, however many runs broke off in between; they alone are read,
    and only the buckets of the SKUs they touch are written. A SKU that has run out of spare
    videos is looked up among all of them.
    """
    changes, state = _path(root, "sku_changes"), _path(root, "sku_state")
    schema = spark.createDataFrame([], incremental.CHANGES).schema

    def write() -> None:
        number, through, newest = stored.next_number(spark, state), _through(spark, root), stored.entries(spark, changes)
        if not newest or int(newest[-1]) <= through:
            return
        live = stored.live(spark, changes, newest[-1])
        before = f"{through:012d}"
        known = stored.live(spark, changes, before) if before in newest else {}
        days = [k for k, folders in live.items() if folders != known.get(k)]
        rows = stored.read(spark, changes, schema, DAY, days).filter(F.col("batch") > through)
        rows = incremental.dealt(tables.stage(rows, "changes"))
        skus = rows.select(F.explode(F.array_union(F.coalesce("before.skus", "now.skus"), F.col("now.skus"))).alias("sku_id"))
        buckets = [r[0] for r in skus.select(incremental.bucket()).distinct().collect()]
        old = _state_of(spark, root, buckets)
        moved = tables.stage(incremental.advance(old, rows, spare), "moved")
        short = moved.filter("short").select("sku_id")
        if short.isEmpty():
            moved = moved.drop("short")
        else:
            every = incremental.dealt(stored.read(spark, changes, schema, DAY))
            moved = incremental.with_looked_up(moved, incremental.looked_up(short, every, spare))
        kept = old.join(moved.select("sku_id"), "sku_id", "left_anti")
        out = kept.unionByName(moved.select(*kept.columns))
        stored.publish(spark, state, out, "bucket", buckets, number, {"applied": int(newest[-1])})

    stored.again(write)


def rescore(
    spark: SparkSession,
    root: str,
    as_of: Column,
    model_path: str | None = None,
    cfg: C.RiskConfig = C.RiskConfig(),
    changed: DataFrame | None = None,
) -> int:
    """Score videos that have no prediction for their latest row, then refresh the SKU mart.

    With ``changed`` (video_id, posted_at) only these videos are read. The newest prediction of a
    video replaces the one before; all stay in ``prediction_history``. The mart comes from the
    state kept per SKU. Returns the number of videos scored.
    """
    tune(spark)
    with tables.scratch(spark):
        open_videos = _changed_rows(spark, root, changed)[0].filter("p90_demand_lift IS NULL")
        lifted = scoring.with_video_tier(
            scoring.lift(open_videos.drop(*C.LIFT_COLUMNS, "risk_tier_predicted"), model_path)
        )
        names = [c.split()[0] for c in PREDICTION.split(", ")]
        new = tables.stage(lifted.select(*names), "predictions")
        n = new.count()
        if n:
            store(spark, root, "video_predictions", new, ["video_id"], "latest_event_id")
            _append(spark, root, "prediction_history", new.withColumn("scored_at", as_of))
        note_changes(spark, root, changed)
        refresh_skus(spark, root)
        skus = staging.stg_skus(read(spark, root, "sku_catalog"))
        rows = inventory.with_signal(skus, incremental.signal(_state_of(spark, root)), as_of)
        replace(spark, root, "mart_sku_risk", marts.sku_risk_mart(rows, None, read_alerts(spark, root), cfg))
    return n


def top_videos(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the best videos of each SKU, from the state kept per SKU."""
    return incremental.top_videos(_state_of(spark, root))


def raise_alerts(
    spark: SparkSession,
    root: str,
    as_of: Column,
    cfg: C.RiskConfig = C.RiskConfig(),
    throttle: bool = False,
) -> DataFrame:
    """Triage the SKUs at risk and append their alerts; returns the alerts of this run.

    An alert whose id is stored is not stored again, so a run can be repeated. ``throttle``
    applies cooldown and hourly cap; what the cap holds back is stored as SUPPRESSED.
    """
    tune(spark)
    with tables.scratch(spark):
        risk = read(spark, root, "mart_sku_risk")
        at_risk = A.at_risk(risk, None, cfg, ordered=False, best=top_videos(spark, root))
        known = _appended(spark, root, "agent_alerts", schemas.AGENT_ALERTS)
        new = A.build_alerts(A.escalated(A.triage(at_risk, cfg)), as_of)
        new = new.join(known.select("alert_id"), "alert_id", "left_anti").select(*new.columns)
        if throttle:
            raised = known.filter(F.col("status") != C.SUPPRESSED)
            new = tables.stage(A.cooldown(new, raised, cfg.cooldown_hours), "cooled")
            new = A.suppress_beyond_cap(new, raised, cfg.max_alerts_per_hour)
        _append(spark, root, "agent_alerts", tables.stage(new, "alerts"))
    alerts = _appended(spark, root, "agent_alerts", schemas.AGENT_ALERTS)
    return alerts.filter((F.col("created_at") == as_of) & (F.col("status") != C.SUPPRESSED))


def run_hourly(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    as_of: Column,
    model_path: str | None = None,
    cfg: C.RiskConfig = C.RiskConfig(),
    throttle: bool = False,
    horizon: int = C.SNAPSHOT_HORIZON_HOURS,
) -> DataFrame:
    """Ingest, refresh the marts, score, triage and append alerts; returns the run's alerts."""
    with tables.scratch(spark):
        batch = tables.stage(batch, "arrived")
        ingest_batch(spark, root, batch, horizon)
        good = ingest.within_horizon(batch, horizon)[0]
        refresh_touched(spark, root, good, as_of, horizon)
        changed = tables.stage(good.select("video_id", "posted_at").distinct(), "changed")
        rescore(spark, root, as_of, model_path, cfg, changed)
    return raise_alerts(spark, root, as_of, cfg, throttle)


def review(spark: SparkSession, root: str, decisions: DataFrame) -> DataFrame:
    """Append review decisions with what each did; returns the outcomes.

    Stored alerts are not touched, so alerts raised meanwhile are safe, and decisions that
    were taken before keep counting.
    """
    tune(spark)
    outcomes = A.decision_outcomes(read_alerts(spark, root), decisions)
    outcomes = tables.stage(outcomes, "outcomes")
    logged = decisions.join(outcomes.select("decision_id", "outcome"), "decision_id")
    _append(spark, root, "alert_decisions", logged.select(*[c.split()[0] for c in DECISION.split(", ")]))
    return outcomes


def refresh_catalog(spark: SparkSession, root: str, seed: int) -> None:
    """Daily run: take one day of demand off the stock, then vary the baseline."""
    tune(spark)
    skus = maintenance.deplete(read(spark, root, "sku_catalog"))
    replace(spark, root, "sku_catalog", maintenance.drift(skus, seed))


def train(
    spark: SparkSession,
    root: str,
    model_path: str,
    params: C.BoostConfig = C.BoostConfig(),
    as_of: Column | None = None,
) -> dict[str, quantile.QuantileModel]:
    """Weekly run: fit the three quantiles on the labelled videos and publish them.

    The metrics of the held-out videos are appended to ``train_metrics``, by version.
    """
    tune(spark)
    videos = read_videos(spark, root)
    models = quantile.fit(videos, params)
    version = quantile.save_models(spark, models, model_path)
    _, held_out = quantile.split(videos.filter(F.col(C.LABEL).isNotNull()), params.train_ratio, params.seed)
    metrics = evaluate.evaluate(quantile.predict(held_out, models, params.features), exact=False)
    at = F.current_timestamp() if as_of is None else as_of
    _append(spark, root, "train_metrics", metrics.withColumns({"version": F.lit(version), "trained_at": at}))
    return models


def clean_up(spark: SparkSession, root: str, keep: int = 3) -> None:
    """Delete superseded versions of the stored tables, but for the newest ones."""
    for name in (*_DAY_OF, *_UNDATED):
        for kind in ("", "_check_counts", "_check_values"):
            stored.vacuum(spark, _path(root, name) + kind, keep)
