"""Encodings, time parts, keys and text shapes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def encode_ordinal(value: Column, codes: Mapping[str, int], default: int) -> Column:
    """Map a string to its code; NULL and unknown values get ``default``."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def bool_int(flag: Column) -> Column:
    return flag.cast("int")


def weekday(ts: Column) -> Column:
    """Day of week counted from Sunday = 0."""
    return F.dayofweek(ts) - 1


def time_parts(snapshot: str = "snapshot_at", posted: str = "posted_at") -> dict[str, Column]:
    """Hour and weekday of the snapshot and of the post."""
    parts = {}
    for prefix, name in (("snapshot", snapshot), ("posted", posted)):
        parts[f"{prefix}_hour_of_day"] = F.hour(name)
        parts[f"{prefix}_day_of_week"] = weekday(F.col(name))
    return parts


def age_label(hours: Column) -> Column:
    """``< 1 hour``, ``N hours`` or ``N days``; days round half to even."""
    days = F.rint(hours / 24).cast("int")
    return (
        F.when(hours < 1, "< 1 hour")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def json_list(text: Column) -> Column:
    """JSON array text to ``array<string>``; malformed text gives NULL."""
    return F.from_json(text, "array<string>")


def percent(rate: Column) -> Column:
    """Rate of six decimals as a percentage of two, rounded half up in decimals."""
    return F.round(rate.cast("decimal(12,6)") * 100, 2).cast("double")


def iso_text(ts: Column) -> Column:
    """ISO-8601 text ending in Z, empty for NULL."""
    return F.coalesce(F.date_format(ts, ISO_FORMAT), F.lit(""))


def event_key(posted_at: Column, video_id: Column, hour: Column) -> Column:
    """``evt_{yyyymmdd}_{video}_h{hh}``; hours of three digits keep all of them."""
    return F.concat(
        F.lit("evt_"),
        F.date_format(posted_at, "yyyyMMdd"),
        F.lit("_"),
        video_id,
        F.format_string("_h%02d", hour),
    )


def null_as(dtype: str) -> Column:
    """Typed NULL for a value a later step fills in."""
    return F.lit(None).cast(dtype)
