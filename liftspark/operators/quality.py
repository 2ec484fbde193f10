"""Record rules with quarantine, and table checks with severities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode

_COUNTS = (
    "view_count",
    "like_count",
    "comment_count",
    "share_count",
    "save_count",
    "click_to_product",
    "add_to_cart",
)
_RATES = ("save_rate", "share_rate", "click_rate", "cart_rate", "like_rate")
_DELTAS = ("views_delta_1h", "saves_delta_1h", "shares_delta_1h", "save_velocity")


def _non_empty_list(column: str) -> Column:
    return F.size(encode.json_list(F.col(column))) > 0


def sku_rules() -> dict[str, Column]:
    """Conditions a SKU row must meet. The bounds."""
    return {
        "category": F.col("category").isin(*C.CATEGORIES),
        "unit_price_usd": F.col("unit_price_usd") > 0,
        "baseline_daily_demand": F.col("baseline_daily_demand") > 0,
        "current_stock": F.col("current_stock") >= 0,
        "supplier_lead_time_days": F.col("supplier_lead_time_days").between(1, 90),
        "reorder_point": F.col("reorder_point") >= 0,
        "viral_sensitivity": F.col("viral_sensitivity").between(0.0, 5.0),
    }


def video_rules() -> dict[str, Column]:
    """Conditions a video row must meet. The bounds."""
    return {
        "platform": F.col("platform").isin(*C.PLATFORMS),
        "creator_tier": F.col("creator_tier").isin(*C.CREATOR_TIERS),
        "video_duration_s": F.col("video_duration_s").between(1, 600),
        "sku_ids": _non_empty_list("sku_ids_json"),
    }


def event_rules() -> dict[str, Column]:
    """Conditions an engagement row must meet. The bounds."""
    return {
        "platform": F.col("platform").isin(*C.PLATFORMS),
        "creator_tier": F.col("creator_tier").isin(*C.CREATOR_TIERS),
        "hours_since_post": F.col("hours_since_post") >= 0,
        "sku_ids": _non_empty_list("sku_ids_json"),
        **{c: F.col(c) >= 0 for c in _COUNTS},
        **{c: F.col(c).between(0.0, 1.0) for c in _RATES},
        **{c: F.col(c) >= 0 for c in _DELTAS},
        "snapshot_after_post": F.col("snapshot_at") >= F.col("posted_at"),
    }


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of the broken ones.

    A rule that evaluates to NULL counts as broken. Both results are plain filters over
    the same input and need no shuffle.
    """
    broken = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )
    judged = df.withColumn("reasons", broken)
    good = judged.filter(F.size("reasons") == 0).drop("reasons")
    return good, judged.filter(F.size("reasons") > 0)


def _row(check: str, column: str, failures: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).alias("column_name"),
        failures.cast("bigint").alias("failures"),
    )


def _unpivot(df: DataFrame, measures: Mapping[tuple[str, str], Column]) -> DataFrame:
    """One pass over the table for all measures, then one row per measure."""
    named = {f"m{i}": m for i, m in enumerate(measures.values())}
    totals = df.agg(*[m.alias(n) for n, m in named.items()])
    rows = [_row(check, col, F.col(n)) for (check, col), n in zip(measures, named)]
    return totals.select(F.inline(F.array(*rows)))


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Number of values that occur more than once."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1")
    return _unpivot(repeated, {("unique", column): F.count(F.lit(1))})


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    return _unpivot(df, {("not_null", c): F.count_if(F.col(c).isNull()) for c in columns})


def check_accepted(df: DataFrame, accepted: Mapping[str, Sequence]) -> DataFrame:
    """Values outside the accepted ones per column, all columns in one pass."""
    return _unpivot(
        df,
        {
            ("accepted_values", c): F.count_if(~F.col(c).isin(*values))
            for c, values in accepted.items()
        },
    )


def check_freshness(
    df: DataFrame,
    as_of: Column,
    column: str = "snapshot_at",
    warn_hours: int = C.FRESHNESS_WARN_HOURS,
    error_hours: int = C.FRESHNESS_ERROR_HOURS,
) -> DataFrame:
    """Age of the newest row and its verdict: pass, warn or error."""
    seconds = F.unix_seconds(as_of) - F.unix_seconds(F.col("newest"))
    age = seconds / 3600
    status = (
        F.when(age.isNull() | (age > error_hours), "error")
        .when(age > warn_hours, "warn")
        .otherwise("pass")
    )
    return df.agg(F.max(column).alias("newest")).select(
        F.lit("freshness").alias("check"),
        F.lit(column).alias("column_name"),
        seconds.alias("age_seconds"),
        status.alias("status"),
    )


# The declared tests of the tables.
_VIDEO_KINDS = {"platform": C.PLATFORMS, "creator_tier": C.CREATOR_TIERS}
_EVENT_TESTS = ("event_id", "video_id", "hours_since_post", "platform", "creator_tier", "view_count")
_RISK_TIER = {"inventory_risk_tier": C.RISK_TIERS}
DECLARED = {
    "engagement_events": (["event_id"], [*_EVENT_TESTS], _VIDEO_KINDS),
    "sku_catalog": (["sku_id"], ["sku_id", "baseline_daily_demand"], {}),
    "video_metadata": (["video_id"], ["video_id", "platform"], {}),
    "video_sku_bridge": ([], ["video_id", "sku_id"], {}),
    "agent_alerts": (["alert_id"], ["alert_id"], {}),
    "stg_engagement_events": (["event_id"], [*_EVENT_TESTS, "save_rate", "is_viral"], _VIDEO_KINDS),
    "stg_sku_catalog": (
        ["sku_id"],
        ["sku_id", "sku_name", "category", "days_of_cover", "inventory_risk_tier", "viral_sensitivity"],
        {"category": C.CATEGORIES, **_RISK_TIER},
    ),
    "int_engagement_features": (
        ["event_id"],
        [
            "event_id",
            "video_id",
            "hours_since_post",
            "views_velocity_3h",
            "engagement_score",
            "creator_tier_encoded",
            "platform_encoded",
        ],
        {"creator_tier_encoded": (0, 1, 2, 3, 4), "platform_encoded": (0, 1, 2)},
    ),
    "int_sku_inventory": (
        ["sku_id"],
        ["sku_id", "inventory_risk_tier", "urgency_score", "days_of_cover"],
        _RISK_TIER,
    ),
    "mart_scored_videos": (
        ["video_id"],
        ["video_id", "platform", "engagement_score", "hours_observed", "sku_viral_sensitivity"],
        {"platform": C.PLATFORMS},
    ),
    "mart_sku_risk": (
        ["sku_id"],
        ["sku_id", "inventory_risk_tier", "urgency_score", "days_of_cover"],
        _RISK_TIER,
    ),
    "mart_trending_videos": (["video_id", "rank"], ["video_id", "engagement_score", "rank"], {}),
}


def _declared_counts(not_null: Sequence[str], accepted: Mapping) -> dict[tuple[str, str], Column]:
    measures = {("not_null", c): F.count_if(F.col(c).isNull()) for c in not_null}
    return measures | {("accepted_values", c): F.count_if(~F.col(c).isin(*v)) for c, v in accepted.items()}


def _values(unique: Sequence[str]) -> Column:
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in unique]
    return F.inline(F.array(*pairs))


def check_declared(df: DataFrame, unique: Sequence[str], not_null: Sequence[str], accepted: Mapping) -> list:
    """All declared tests of a table: one aggregate, and one for its unique columns.

    Unique columns share a scan as (column, value) rows, which combine on the map side.
    """
    results = [_unpivot(df, _declared_counts(not_null, accepted))]
    if unique:
        values = df.select(_values(unique)).filter("value IS NOT NULL")
        repeated = values.groupBy("column_name", "value").count().filter("count > 1")
        count = {("unique", c): F.count_if(F.col("column_name") == c) for c in unique}
        results.append(_unpivot(repeated, count))
    return results


def count_parts(df: DataFrame, part: str, not_null: Sequence[str], accepted: Mapping) -> DataFrame:
    """(part, check, column_name, failures): what the rows of each part add to the counts of the table."""
    measures = _declared_counts(not_null, accepted)
    named = {f"m{i}": m for i, m in enumerate(measures.values())}
    totals = df.groupBy(part).agg(*[m.alias(n) for n, m in named.items()])
    rows = [_row(check, col, F.col(n)) for (check, col), n in zip(measures, named)]
    return totals.select(part, F.inline(F.array(*rows)))


def value_parts(df: DataFrame, part: str, unique: Sequence[str]) -> DataFrame:
    """(part, column_name, value, n): how often each part has each value of the unique columns."""
    values = df.select(part, _values(unique)).filter("value IS NOT NULL")
    return values.groupBy(part, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def repeated_change(old: DataFrame, new: DataFrame, rest: DataFrame) -> DataFrame:
    """(column_name, change): by how much the number of repeated values changes as ``new`` replaces ``old``.

    All three have (column_name, value, n); ``rest`` are the parts that stay, of which only the
    values count that come, go or change their number.
    """
    sides = old.select("column_name", "value", F.col("n").alias("n_old"), F.lit(0).alias("n_new")).unionByName(
        new.select("column_name", "value", F.lit(0).alias("n_old"), F.col("n").alias("n_new"))
    )
    changed = (
        sides.groupBy("column_name", "value")
        .agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
        .filter("n_old <> n_new")
    )
    keys = ["column_name", "value"]
    elsewhere = rest.join(changed.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("n").alias("n_rest"))
    known = F.coalesce("n_rest", F.lit(0))
    was, now = (known + F.col("n_old") > 1).cast("int"), (known + F.col("n_new") > 1).cast("int")
    return changed.join(elsewhere, keys, "left").groupBy("column_name").agg(F.sum(now - was).alias("change"))


SEVERITY = {"unique": "error", "not_null": "error"}  # Fixed values; all others warn.


def report(results: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """Check results of several tables in one list with severity and status."""
    severity = F.lit("warn")
    for check, level in SEVERITY.items():
        severity = F.when(F.col("check") == check, level).otherwise(severity)
    named = [
        df.withColumn("table_name", F.lit(table)) for table, dfs in results.items() for df in dfs
    ]
    failed = F.col("failures") > 0
    return (
        reduce(DataFrame.unionByName, named)
        .withColumn("severity", severity)
        .withColumn("status", F.when(failed, F.col("severity")).otherwise("pass"))
        .select("table_name", "check", "column_name", "severity", "failures", "status")
    )
