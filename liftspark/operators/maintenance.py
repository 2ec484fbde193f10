"""Daily catalog refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deplete(skus: DataFrame) -> DataFrame:
    """Take one day of baseline demand off the stock, down to zero."""
    sold = F.rint("baseline_daily_demand").cast("int")
    left = F.greatest(F.col("current_stock") - sold, F.lit(0))
    return skus.withColumn("current_stock", left)


def drift(skus: DataFrame, seed: int) -> DataFrame:
    """Vary the baseline by up to five percent either way.

    The draw hangs on the SKU and the seed, not on the partition, so a task that is run
    again repeats it.
    """
    digits = F.substring(F.sha2(F.concat_ws("|", "sku_id", F.lit(seed)), 256), 1, 8)
    draw = F.conv(digits, 16, 10).cast("double") / 2**32
    factor = 0.95 + 0.10 * draw
    return skus.withColumn(
        "baseline_daily_demand", F.round(F.col("baseline_daily_demand") * factor, 1)
    )
