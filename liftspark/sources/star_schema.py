"""Raw demand-signal tables derived from the star-schema Parquet files.

Users of ``events`` play the videos and parts play the SKUs. Raw rows are first
aggregated to one row per (video, hour) with map-side combine, which also flattens a user
that owns a large share of them: from there on a video has at most one row per hour of
the observed period, and window partitions are bounded by that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import encode

VIRAL_VIEWS = 8_000
LABEL_HOURS = 24
_SO_FAR = "OVER (PARTITION BY video_id ORDER BY hour ROWS UNBOUNDED PRECEDING)"
_WHOLE = "OVER (PARTITION BY video_id)"


def _label_at(index: str, labels: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"element_at(array({listed}), CAST({index} + 1 AS INT))"


def video_key(user: str = "user_id") -> str:
    return f"format_string('vid_%06d', {user})"


def sku_key(part: str = "p_partkey") -> str:
    return f"format_string('SKU-%06d', {part})"


def _ratio(part: str) -> str:
    """Share of the views, or the plain count while there are none."""
    return f"round({part} / greatest(view_count, 1), 6)"


# Columns read from the source files, declared so that no job infers them.
SOURCES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
    " value DOUBLE, props STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DOUBLE",
    "lineitem": "l_partkey BIGINT, l_quantity DOUBLE",
}

# Static context of a video, all from the user number.
CONTEXT = {
    "platform": _label_at("user_id % 3", C.PLATFORMS),
    "creator_id": "concat('cr_', user_id % 50)",
    "creator_tier": _label_at("(user_id div 7) % 5", C.CREATOR_TIERS),
    "video_duration_s": "CAST(10 + user_id % 171 AS INT)",
    "has_link_in_bio": "user_id % 10 < 6",
    "is_on_foryou": "user_id % 5 = 0",
    "trending_rank": "CASE WHEN user_id % 7 = 0 THEN CAST(1 + user_id % 50 AS INT) END",
    "region_codes_json": "CASE WHEN user_id % 2 = 0 THEN '[\"US\"]' ELSE '[\"US\",\"GB\"]' END",
}


def _context(*names: str) -> list[str]:
    return [f"{CONTEXT[name]} AS {name}" for name in names]


@dataclass(frozen=True)
class StarSchema:
    """Lazy raw tables over one folder of star-schema files."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir.rstrip('/')}/{name}.parquet"
        return self.spark.read.schema(SOURCES[name]).parquet(path)

    @cached_property
    def activity(self) -> DataFrame:
        """Events with the hour as a timestamp and the value in cents."""
        return self.table("events").selectExpr(
            "user_id",
            "date_trunc('HOUR', CAST(ts AS TIMESTAMP)) AS hour",
            "event_type",
            "value",
            "CAST(round(value * 100) AS BIGINT) AS cents",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Increments per (video, hour); one partial and one final aggregation."""
        counts = {
            "saves": "event_type = 'signup'",
            "shares": "event_type = 'error'",
            "clicks": "event_type = 'click'",
            "carts": "event_type = 'purchase'",
            "likes": "value > 50",
            "comments": "value > 100",
        }
        increments = self.activity.groupBy("user_id", "hour").agg(
            F.expr(
                "CAST(sum(CASE WHEN event_type = 'view' THEN floor(value) * 10 ELSE 0 END) AS BIGINT)"
                " AS views"
            ),
            *[F.expr(f"count_if({cond}) AS {n}") for n, cond in counts.items()],
            F.expr("sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS cents"),
        )
        # The text key is made once per hour, not per event, and keys all later shuffles.
        return increments.selectExpr(f"{video_key()} AS video_id", "*")

    @cached_property
    def timeline(self) -> DataFrame:
        """Hourly rows with running counts, post time and label; one shuffle by video."""
        running = {
            "view_count": "views",
            "like_count": "likes",
            "comment_count": "comments",
            "share_count": "shares",
            "save_count": "saves",
            "click_to_product": "clicks",
            "add_to_cart": "carts",
        }
        timed = self.hourly.selectExpr(
            "*",
            f"first(hour) {_SO_FAR} AS posted_at",
            *[f"sum({c}) {_SO_FAR} AS {name}" for name, c in running.items()],
        ).selectExpr(
            "*", "CAST(timestampdiff(HOUR, posted_at, hour) AS INT) AS hours_since_post"
        )
        early = f"sum(CASE WHEN hours_since_post < {LABEL_HOURS} THEN cents ELSE 0 END) {_WHOLE}"
        days = f"(max(hours_since_post) {_WHOLE} div {LABEL_HOURS} + 1)"
        return timed.selectExpr(
            "*",
            f"round(try_divide({early} * {days}, sum(cents) {_WHOLE}), 4) AS demand_lift_24h",
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Distinct (video, SKU) pairs of existing parts, with the post time.

        Grouping by the pair spreads a busy video over its SKUs before the window, which
        then sees at most the distinct SKUs of a video.
        """
        pairs = self.activity.groupBy("user_id", "k").agg(F.expr("min(hour) AS hour"))
        keyed = pairs.selectExpr(
            f"{video_key()} AS video_id", "user_id", "k + 100 * (user_id % 20) AS p_partkey", "hour"
        ).selectExpr("*", f"min(hour) {_WHOLE} AS posted_at")
        return keyed.join(self.table("part").select("p_partkey"), "p_partkey", "left_semi")

    @cached_property
    def bridge(self) -> DataFrame:
        return self.tags.selectExpr(
            "video_id", f"{sku_key()} AS sku_id", *_context("platform"), "posted_at"
        )

    @cached_property
    def tag_lists(self) -> DataFrame:
        """The SKU list of a video: a record field, bounded by the tags of one video."""
        listed = f"to_json(sort_array(collect_list({sku_key()}))) AS sku_ids_json"
        return self.tags.groupBy("video_id").agg(F.expr(listed))

    @cached_property
    def events(self) -> DataFrame:
        """``engagement_events``: rates are plain ratios, not clipped."""
        key = encode.event_key(F.col("posted_at"), F.col("video_id"), F.col("hours_since_post"))
        listed = self.timeline.join(self.tag_lists, "video_id", "left")
        return listed.withColumn("event_id", key).selectExpr(
            "event_id",
            "video_id",
            "posted_at",
            "hour AS snapshot_at",
            "hours_since_post",
            *_context("platform", "creator_id", "creator_tier"),
            "coalesce(sku_ids_json, '[]') AS sku_ids_json",
            *_context("video_duration_s", "has_link_in_bio"),
            "view_count",
            "like_count",
            "comment_count",
            "share_count",
            "save_count",
            "click_to_product",
            "add_to_cart",
            f"{_ratio('save_count')} AS save_rate",
            f"{_ratio('share_count')} AS share_rate",
            f"{_ratio('click_to_product')} AS click_rate",
            f"{_ratio('add_to_cart')} AS cart_rate",
            f"{_ratio('like_count')} AS like_rate",
            "views AS views_delta_1h",
            "saves AS saves_delta_1h",
            "shares AS shares_delta_1h",
            "coalesce(round(try_divide(saves, views), 6), 0D) AS save_velocity",
            *_context("is_on_foryou", "trending_rank", "region_codes_json"),
            "demand_lift_24h",
            f"view_count >= {VIRAL_VIEWS} AS is_viral",
        )

    @cached_property
    def videos(self) -> DataFrame:
        """``video_metadata``: one row per video."""
        totals = self.hourly.groupBy("video_id", "user_id").agg(
            F.expr("min(hour) AS posted_at"), F.expr("sum(views) AS views")
        )
        return totals.join(self.tag_lists, "video_id", "left").selectExpr(
            "video_id",
            *_context("platform", "creator_id", "creator_tier"),
            "posted_at",
            *_context("video_duration_s", "has_link_in_bio"),
            "coalesce(sku_ids_json, '[]') AS sku_ids_json",
            *_context("region_codes_json"),
            f"views >= {VIRAL_VIEWS} AS is_viral",
        )

    @cached_property
    def skus(self) -> DataFrame:
        """``sku_catalog``: parts with the demand their order lines show."""
        sold = (
            self.table("lineitem")
            .groupBy("l_partkey")
            .agg(F.expr("sum(l_quantity) AS quantity"))
            .withColumnRenamed("l_partkey", "p_partkey")
        )
        return (
            self.table("part")
            .join(sold, "p_partkey", "left")
            .selectExpr(
                "*",
                "coalesce(quantity, 0D) / 100D AS baseline_daily_demand",
                "CAST(3 + p_partkey % 28 AS INT) AS supplier_lead_time_days",
            )
            .selectExpr(
                f"{sku_key()} AS sku_id",
                "p_name AS name",
                f"{_label_at('p_partkey % 8', C.CATEGORIES)} AS category",
                "p_retailprice AS unit_price_usd",
                "baseline_daily_demand",
                "CAST(p_size * 3 AS INT) AS current_stock",
                "supplier_lead_time_days",
                "CAST(floor(baseline_daily_demand * supplier_lead_time_days * 1.2D) AS INT)"
                " AS reorder_point",
                # Eighths, so that sums are exact in any order.
                "0.5D + (p_partkey % 41) / 8D AS viral_sensitivity",
                "TIMESTAMP'2024-01-01' AS created_at",
            )
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Purchases as (video_id, sold_at, cents)."""
        return (
            self.table("events")
            .filter("event_type = 'purchase'")
            .selectExpr(
                f"{video_key()} AS video_id",
                "CAST(ts AS TIMESTAMP) AS sold_at",
                "CAST(round(value * 100) AS BIGINT) AS cents",
            )
        )
