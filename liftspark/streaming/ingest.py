"""Continuous ingestion and incremental refresh of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark import schemas
from liftspark.operators import ingest
from liftspark.plans import hourly
from liftspark.sources import tables
from liftspark.streaming import sinks


_ONCE = "_once"


def stream_ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    horizon: int = C.SNAPSHOT_HORIZON_HOURS,
) -> None:
    """Upsert arriving snapshot files into the event table, broken rows into the quarantine.

    The upsert by event id makes a repeated batch harmless and keeps late snapshots,
    however late: there is no streaming state and no watermark to drop them.
    """
    events = sinks.file_stream(
        spark, folder, schemas.ENGAGEMENT_EVENTS, files_per_batch=files_per_batch
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        with tables.scratch(batch.sparkSession):
            batch = tables.stage(batch, "arrived")
            hourly.ingest_batch(batch.sparkSession, root, batch, horizon)

    sinks.run_batches(events, handle, checkpoint)


def stream_distinct(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    lateness: str = "3 days",
    files_per_batch: int | None = None,
    horizon: int = C.SNAPSHOT_HORIZON_HOURS,
) -> None:
    """Append arriving snapshot files to the event table, for a source that sends rows repeatedly.

    The stream keeps the ids of the last ``lateness`` of event time and lets each through once, so
    the rows are appended and what is stored is not read. All copies of an id carry the same
    ``snapshot_at``, so a copy whose id has been forgotten is behind the watermark: it is not let
    through, and goes to the quarantine as ``late`` unless its id is stored under its day. Rows
    without id or time cannot be told apart from their copies; they go there too (``no_key``,
    ``no_time``), as do those outside the tracked hours. Corrections of stored rows are copies
    here; they need ``stream_ingest``.

    The commit of the rows names the stream's batch, so a batch that is run again adds nothing.
    """
    arriving = sinks.file_stream(spark, folder, schemas.ENGAGEMENT_EVENTS, files_per_batch=files_per_batch)
    names = arriving.columns
    keyed = arriving.filter("event_id IS NOT NULL AND snapshot_at IS NOT NULL")
    once = keyed.withWatermark("snapshot_at", lateness).dropDuplicatesWithinWatermark(["event_id"])
    # Late rows vanish in the deduplication, so all rows pass beside it to be compared.
    both = once.select(*names, F.lit(True).alias(_ONCE)).unionByName(arriving.withColumn(_ONCE, F.lit(False)))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with tables.scratch(session):
            batch = tables.stage(batch, "arrived")
            new, every = (batch.filter(F.col(_ONCE) == kind).drop(_ONCE) for kind in (True, False))
            good, _ = ingest.within_horizon(new, horizon)
            hourly.append_events(session, root, good, checkpoint, batch_id)
            hourly.mark_hours(session, root, good)
            tracked, beyond = ingest.within_horizon(every, horizon)
            hourly.set_apart(session, root, beyond)
            # Few rows are lost as a rule, so their ids are found first and whole rows stay where they are.
            ids = tables.stage(tracked.select("event_id").join(good.select("event_id"), "event_id", "left_anti"), "lost")
            lost = tracked.join(ids, "event_id", "left_semi").select(*names)
            hourly.set_apart(session, root, hourly.not_stored(session, root, lost))

    sinks.run_batches(both, handle, checkpoint)


def stream_refresh(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    as_of: Column,
    files_per_batch: int | None = None,
    horizon: int = C.SNAPSHOT_HORIZON_HOURS,
) -> None:
    """Ingest arriving snapshot files and keep features and video mart current."""
    events = sinks.file_stream(
        spark, folder, schemas.ENGAGEMENT_EVENTS, files_per_batch=files_per_batch
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        session = batch.sparkSession
        with tables.scratch(session):
            batch = tables.stage(batch, "arrived")
            hourly.ingest_batch(session, root, batch, horizon)
            good, _ = ingest.within_horizon(batch, horizon)
            hourly.refresh_touched(session, root, good, as_of, horizon)

    sinks.run_batches(events, handle, checkpoint)
