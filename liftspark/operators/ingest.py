"""Bridge, high-water mark and hourly batch selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode


def explode_bridge(videos: DataFrame) -> DataFrame:
    """One row per video and tagged SKU; malformed lists give none."""
    return videos.select(
        "video_id",
        F.explode(encode.json_list(F.col("sku_ids_json"))).alias("sku_id"),
        "platform",
        "posted_at",
    )


def next_hour(
    videos: DataFrame, events: DataFrame, horizon: int = C.SNAPSHOT_HORIZON_HOURS
) -> DataFrame:
    """The hour each video still waits for; videos at the horizon are complete and left out."""
    reached = events.groupBy("video_id").agg(F.max("hours_since_post").alias("max_hour"))
    following = (F.coalesce("max_hour", F.lit(-1)) + 1).cast("int")
    return (
        videos.select("video_id")
        .join(reached, "video_id", "left")
        .select("video_id", following.alias("next_hour"))
        .filter(F.col("next_hour") < horizon)
    )


def due_snapshots(batch: DataFrame, waiting: DataFrame) -> DataFrame:
    """Rows of the batch that are the next hour of their video."""
    keyed = waiting.select("video_id", F.col("next_hour").alias("hours_since_post"))
    return batch.join(keyed, ["video_id", "hours_since_post"], "left_semi").select(*batch.columns)


def within_horizon(
    batch: DataFrame, horizon: int = C.SNAPSHOT_HORIZON_HOURS
) -> tuple[DataFrame, DataFrame]:
    """Rows with a key and an hour that is tracked, and the others with the reason."""
    hour = F.col("hours_since_post")
    reason = (
        F.when(F.col("event_id").isNull() | F.col("video_id").isNull(), "no_key")
        .when(hour.isNull(), "no_hour")
        .when(hour < 0, "before_post")
        .when(hour >= horizon, "beyond_horizon")
    )
    return batch.filter(reason.isNull()), batch.withColumn("reason", reason).filter("reason IS NOT NULL")


WORD_HOURS = 64


def hour_bits(events: DataFrame) -> DataFrame:
    """(video_id, posted_at, word, bits): the hours present, 64 to a word, one bit each.

    Tasks combine their rows before the shuffle; words of any two sets of events merge by OR, so
    an event that comes again changes nothing. Events without video or hour, or before the post,
    have no bit.
    """
    hour = F.col("hours_since_post")
    bit = F.expr(f"shiftleft(1L, CAST(hours_since_post % {WORD_HOURS} AS INT))")
    rows = events.filter(F.col("video_id").isNotNull() & (hour >= 0))
    words = rows.select("video_id", "posted_at", F.expr(f"hours_since_post div {WORD_HOURS}").cast("int").alias("word"), bit.alias("bits"))
    return merged_bits(words)


def merged_bits(words: DataFrame) -> DataFrame:
    """One row per video and word."""
    return words.groupBy("video_id", "word").agg(F.min("posted_at").alias("posted_at"), F.bit_or("bits").alias("bits")).select(
        "video_id", "posted_at", "word", "bits"
    )


def _present(words: DataFrame) -> DataFrame:
    # The highest set bit is the length of the number written in binary.
    top = F.col("word") * WORD_HOURS + F.length(F.bin("bits")) - 1
    merged = merged_bits(words).groupBy("video_id").agg(
        F.max(top).cast("int").alias("max_hour"),
        F.sum(F.bit_count("bits")).alias("stored_hours"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )
    return merged


def progress(words: DataFrame, horizon: int = C.SNAPSHOT_HORIZON_HOURS) -> DataFrame:
    """Hours stored and missing of each video up to the highest, and whether it is finished."""
    missing = F.col("max_hour") + 1 - F.col("stored_hours")
    return _present(words).select(
        "video_id",
        "max_hour",
        "stored_hours",
        missing.alias("missing_hours"),
        (F.col("max_hour") >= horizon - 1).alias("is_finished"),
    )


def gaps(words: DataFrame) -> DataFrame:
    """(video_id, from_hour, to_hour) of each run of hours missing below the highest of a video."""
    present = _present(words).filter(F.col("stored_hours") <= F.col("max_hour"))
    hours = present.select("video_id", "words", F.explode(F.sequence(F.lit(0), F.col("max_hour"))).alias("hour"))
    word = F.coalesce(F.try_element_at("words", F.expr(f"hour div {WORD_HOURS}").cast("int")), F.lit(0).cast("bigint"))
    hours = hours.withColumn("bits", word).filter(f"shiftright(bits, CAST(hour % {WORD_HOURS} AS INT)) & 1 = 0")
    # Hours of one run are as far from their rank as from each other.
    run = F.col("hour") - F.row_number().over(Window.partitionBy("video_id").orderBy("hour"))
    return hours.select("video_id", "hour", run.alias("run")).groupBy("video_id", "run").agg(
        F.min("hour").alias("from_hour"), F.max("hour").alias("to_hour")
    ).drop("run")
