"""Windowed engagement on event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark.streaming import sinks

LATENESS = "72 hours"
_KIND, _VALUE = "event_type", "value"


def _increments() -> dict[str, Column]:
    kind = F.col(_KIND)
    views = F.when(kind == "view", F.floor(_VALUE) * 10).otherwise(0)
    return {
        "views": F.sum(views).cast("bigint"),
        "saves": F.count_if(kind == "signup"),
        "shares": F.count_if(kind == "error"),
        "clicks": F.count_if(kind == "click"),
        "carts": F.count_if(kind == "purchase"),
    }


def _windowed(activity: DataFrame, window: Column, lateness: str) -> DataFrame:
    grouped = activity.withWatermark("ts", lateness).groupBy(window.alias("w"), "video_id")
    return grouped.agg(*[c.alias(n) for n, c in _increments().items()])


_SHORT = ("views", "saves", "shares")  # of the three hours; the query holds no others


def _held(state: DataFrame, names) -> DataFrame:
    """Windows as a query holds them: one counter of the state for each increment it uses, in order."""
    counters = ", ".join(f"{n}: bigint" for n in names)
    rows = state.select(F.col("key.window").alias("w"), "key.video_id", F.col("value").cast(f"struct<{counters}>").alias("v"))
    return rows.select("w", "video_id", "v.*")


def _by_hour(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", F.col("w.start").alias("hour"), *_increments())


def _by_last_hour(rows: DataFrame) -> DataFrame:
    return rows.select(
        "video_id",
        (F.col("w.end") - F.expr("INTERVAL 1 HOUR")).alias("hour"),
        *[F.col(c).alias(f"{c}_velocity_3h") for c in _SHORT],
    )


def stream_hourly(activity: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Increments per video and clock hour.

    Map-side partial sums meet the state store once per (hour, video) and task. State is
    dropped once the watermark passes; later rows are left out and counted
    (``sinks.run_batches``), so the lateness should exceed the longest delay expected.
    """
    return _by_hour(_windowed(activity, F.window("ts", "1 hour"), lateness))


def stream_velocity(activity: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Increments per video over the three clock hours that end with ``hour``.

    On gap-free series this is the three-row velocity of the batch features; with gaps it
    is the stricter reading, three hours by the clock.
    """
    return _by_last_hour(_windowed(activity, F.window("ts", "3 hours", "1 hour"), lateness))


def _current(spark: SparkSession, table: str, checkpoint: str, stream: DataFrame, shape, names) -> DataFrame:
    closed = sinks.read_final(spark, table, stream.schema)
    state = sinks.open_state(spark, table, checkpoint)
    return closed if state is None else closed.unionByName(shape(_held(state, names)))


def read_hourly(spark: SparkSession, table: str, checkpoint: str, stream: DataFrame) -> DataFrame:
    """Closed hours from the table, and those still open from the query's own state."""
    return _current(spark, table, checkpoint, stream, _by_hour, _increments())


def read_velocity(spark: SparkSession, table: str, checkpoint: str, stream: DataFrame) -> DataFrame:
    """Closed windows from the table, and those still open from the query's own state."""
    return _current(spark, table, checkpoint, stream, _by_last_hour, _SHORT)
