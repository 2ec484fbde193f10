"""Left join with one row of facts per key, without moving the rows of a hot key to one task."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 4096  # a key with at least this part of the rows is hot; there are at most as many such keys


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, spread: Column) -> DataFrame:
    """All ``rows``, each with the columns of ``facts`` (one row per key) or NULLs.

    ``hot`` is a condition on the facts that at most ``SHARE`` keys can meet: theirs are
    broadcast. The other facts are joined by key; there the rows of hot keys, and those whose
    first key is NULL, are dealt out by ``spread``, whose 64 bits stand in for the first key, and
    what they meet is not used.
    """
    values = [c for c in facts.columns if c not in keys]
    is_hot = F.coalesce(hot, F.lit(False))

    def named(df: DataFrame, mark: str) -> DataFrame:
        renamed = [F.col(k).alias(f"{mark}{k}") for k in keys] + [F.col(v).alias(f"{mark}{v}") for v in values]
        return df.select(*renamed, F.lit(True).alias(f"{mark}found"))

    def same(mark: str, first: str) -> Column:
        return reduce(and_, [F.col(first if k == keys[0] else k) == F.col(f"{mark}{k}") for k in keys])

    kind = rows.schema[keys[0]].dataType
    decoy = F.xxhash64(spread)
    decoy = F.encode(decoy.cast("string"), "utf-8") if kind.typeName() == "binary" else decoy.cast(kind)
    out = rows.join(F.broadcast(named(facts.filter(is_hot), "_h_")), same("_h_", keys[0]), "left")
    known = F.col(keys[0]).isNotNull() & F.col("_h_found").isNull()
    out = out.withColumn("_key", F.when(known, F.col(keys[0])).otherwise(decoy))
    out = out.join(named(facts.filter(~is_hot), "_c_"), same("_c_", "_key"), "left")
    picked = [F.when(F.col("_h_found"), F.col(f"_h_{v}")).when(known, F.col(f"_c_{v}")).alias(v) for v in values]
    return out.select(*rows.columns, *picked)
