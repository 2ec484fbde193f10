"""Insert-or-replace by key, as a plan; ``stored.upsert`` applies it to stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under ``order``.

    The rank filter runs before the shuffle too, so a key repeated a billion times sends
    one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``base`` whose key is not in ``new``, plus the last new row of each key."""
    latest = last_per_key(new, keys, order)
    return base.join(new.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(
        latest.select(*base.columns)
    )
