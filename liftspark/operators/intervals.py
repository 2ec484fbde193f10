"""Joins of points in time to the intervals they lie in, by equal buckets instead of a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, hours: int) -> DataFrame:
    """Rows of ``points`` and ``spans`` with equal ``on`` and start <= at < start + hours.

    Time is cut into buckets as long as the intervals, so an interval touches two of them at
    most: a span has two rows, a point one, and they meet by bucket. The bucket is part of the
    key, so a key that holds much of the data is dealt out by time. Rows with a NULL among ``on``
    or the times meet nothing. No column but those of ``on`` may be in both.
    """
    length = hours * 3_600_000_000
    micros = lambda c: F.unix_micros(F.col(c))
    bucket = F.floor(micros(at) / length)
    first = F.floor(micros(start) / length)
    last = F.floor((micros(start) + length - 1) / length)
    dealt = spans.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    joined = points.withColumn("_bucket", bucket).join(dealt, [*on, "_bucket"])
    inside = (micros(at) >= micros(start)) & (micros(at) < micros(start) + length)
    return joined.filter(inside).drop("_bucket")
