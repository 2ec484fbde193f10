"""Demand signal per SKU kept current by changes, equal to ``inventory.sku_signal`` over all videos.

Counts and sums are retracted: a changed video's old share is taken off, its new one added. A
maximum cannot be retracted, so a SKU keeps the best few videos of each measure, with spare ones.
A video that leaves them makes room; a video that enters must be at or above the *cut*, the last
place when videos were left out, since others unseen may lie below. Only when fewer videos are
left than are needed are those of this SKU looked up again.

``contribution`` is what a video adds to each SKU it tags; ``changes`` are rows with a video's
contribution before and now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.functions import scores
from liftspark.operators.inventory import SCORE_UNIT

# Measure and how many of the best videos are asked for; the number is its place in the list.
MEASURES = (
    ("view_count", 1),
    ("engagement_score", 1),
    ("demand_pressure", 1),
    ("p10_demand_lift", 1),
    ("p50_demand_lift", 1),
    ("p90_demand_lift", C.TOP_VIDEOS_PER_SKU),
)
SPARE = 8
BUCKETS = 64  # parts of the state by SKU
TAGS = 200_000  # (video, SKU) pairs that a task lists
_SHARE = "struct<skus: array<string>, viral: bigint, units: bigint, scored: bigint, best: array<double>>"
_PLACE = "struct<measure: int, value: double, video_id: string>"
CHANGES = f"video_id string, posted_at timestamp, batch bigint, before {_SHARE}, now {_SHARE}"
STATE = (
    "sku_id string, bucket int, n_videos bigint, viral bigint, units bigint, scored bigint,"
    f" tops array<{_PLACE}>, cuts array<{_PLACE}>"
)
SUMS = ("n_videos", "viral", "units", "scored")


def bucket(sku_id: str = "sku_id") -> Column:
    return F.pmod(F.xxhash64(sku_id), F.lit(BUCKETS).cast("bigint")).cast("int")


def contributions(videos: DataFrame, bridge: DataFrame) -> DataFrame:
    """(video_id, posted_at, now): what each video adds to the SKUs it tags."""
    tags = bridge.groupBy("video_id").agg(F.sort_array(F.collect_set("sku_id")).alias("skus"))
    units = F.round(F.col("engagement_score") * SCORE_UNIT).cast("bigint")
    known = {"demand_pressure": scores.demand_pressure()}
    share = F.struct(
        F.coalesce("skus", F.array().cast("array<string>")).alias("skus"),
        F.coalesce(F.col("is_viral").cast("boolean").cast("bigint"), F.lit(0)).cast("bigint").alias("viral"),
        F.coalesce(units, F.lit(0)).cast("bigint").alias("units"),
        units.isNotNull().cast("bigint").alias("scored"),
        F.array(*[(known[m] if m in known else F.col(m)).cast("double") for m, _ in MEASURES]).alias("best"),
    )
    return videos.join(tags, "video_id", "left").select("video_id", "posted_at", share.cast(_SHARE).alias("now"))


def changes(now: DataFrame, applied: DataFrame, batch: int, through: int) -> DataFrame:
    """Rows of the changed videos: the contribution the state knows, and the present one.

    A row of ``applied`` that the state has not taken in yet keeps its ``before``.
    """
    old = applied.select(
        "video_id", F.when(F.col("batch") > through, F.col("before")).otherwise(F.col("now")).alias("before")
    )
    joined = now.join(old, "video_id", "left")
    return joined.select("video_id", "posted_at", F.lit(batch).cast("bigint").alias("batch"), "before", "now")


def dealt(rows: DataFrame) -> DataFrame:
    """Change rows dealt to tasks by their tags: a file of a few megabytes can name millions of them."""
    tags = [F.greatest(F.coalesce(F.size(f"{share}.skus"), F.lit(0)), F.lit(0)) for share in ("before", "now")]
    n = rows.agg(F.sum((tags[0] + tags[1]).cast("bigint"))).first()[0] or 0
    return rows.repartition(1 + n // TAGS, "video_id")


def _places(rows: DataFrame, share: str) -> DataFrame:
    """(sku_id, measure, value, video_id) of the videos' values that are known."""
    places = F.transform(
        f"{share}.best",
        lambda value, i: F.struct(i.cast("int"), value, F.col("video_id")),
    ).cast(f"array<{_PLACE}>")
    tagged = rows.select(F.explode(f"{share}.skus").alias("sku_id"), F.filter(places, lambda p: p["value"].isNotNull()).alias("p"))
    return tagged.select("sku_id", F.inline("p"))


def _best(places: DataFrame, spare: int, more: int = 0) -> DataFrame:
    """The first places of each SKU and measure, with their rank; tasks cut before the shuffle."""
    order = Window.partitionBy("sku_id", "measure").orderBy(F.desc("value"), "video_id")
    wanted = F.get(F.array(*[F.lit(k) for _, k in MEASURES]), F.col("measure")) + spare + more
    longest = max(k for _, k in MEASURES) + spare + more
    ranked = places.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= longest)
    return ranked.filter(F.col("rank") <= wanted)


def _listed(ranked: DataFrame, spare: int) -> DataFrame:
    """(sku_id, tops, cuts, short) from ranked places that reach one beyond the kept ones.

    A place too many, or a cut from before, means that videos were left out; ``short`` says that
    fewer are kept than asked for although some were.
    """
    wanted = F.get(F.array(*[F.lit(k) for _, k in MEASURES]), F.col("measure"))
    place = F.struct("measure", "value", "video_id")
    kept = F.col("rank") <= wanted + spare
    lists = ranked.groupBy("sku_id", "measure").agg(
        F.sort_array(F.collect_list(F.when(kept, F.struct("rank", place.alias("p"))))).alias("l"),
        F.max("rank").alias("n"),
        F.first("cut", ignorenulls=True).alias("cut"),
    )
    over = F.col("n") > wanted + spare
    cut = F.when(over, F.element_at("l", -1)["p"]).otherwise(F.col("cut"))
    lists = lists.select(
        "sku_id", "measure", F.col("l.p").alias("l"), cut.alias("cut"), (cut.isNotNull() & (F.col("n") < wanted)).alias("short")
    )
    return lists.groupBy("sku_id").agg(
        F.flatten(F.sort_array(F.collect_list("l"))).alias("tops"),
        F.collect_list("cut").alias("cuts"),
        F.max("short").alias("short"),
    )


def _sums(rows: DataFrame) -> DataFrame:
    """What the changes add to and take off each SKU's sums."""

    def side(share: str, sign: int) -> DataFrame:
        values = [F.lit(sign).alias("n_videos")] + [(F.col(f"{share}.{c}") * sign).alias(c) for c in SUMS[1:]]
        return rows.select(F.explode(f"{share}.skus").alias("sku_id"), *values)

    both = side("before", -1).unionByName(side("now", 1)).groupBy("sku_id")
    return both.agg(*[F.sum(c).alias(f"{c}_d") for c in SUMS])


def advance(state: DataFrame, rows: DataFrame, spare: int = SPARE) -> DataFrame:
    """New state rows of the SKUs that the changes touch, with ``short`` where some must be looked up.

    Nothing is read of other SKUs or videos. A SKU tagged by many of the changed videos is summed
    and cut to its best places on the map side.
    """
    sums = _sums(rows)
    gone = rows.select("video_id", F.explode(F.array_union(F.coalesce("before.skus", "now.skus"), F.col("now.skus"))).alias("sku_id"))
    touched = state.join(sums.select("sku_id"), "sku_id", "left_semi")
    old = touched.select("sku_id", F.inline("tops")).join(gone, ["sku_id", "video_id"], "left_anti")
    cuts = touched.select("sku_id", F.inline("cuts")).select(
        "sku_id", "measure", F.struct("measure", "value", "video_id").alias("cut")
    )
    new = _best(_places(rows, "now"), spare, 1).drop("rank")
    both = new.unionByName(old.select(*new.columns)).join(cuts, ["sku_id", "measure"], "left")
    above = F.col("cut").isNull() | (F.col("value") > F.col("cut.value"))
    above |= (F.col("value") == F.col("cut.value")) & (F.col("video_id") <= F.col("cut.video_id"))
    ranked = _best(both.filter(above), spare, 1)
    # A measure whose kept videos are all gone has only its cut left.
    left = cuts.join(ranked.select("sku_id", "measure").distinct(), ["sku_id", "measure"], "left_anti")
    listed = _listed(ranked, spare).join(left.select("sku_id", F.lit(True).alias("empty")).distinct(), "sku_id", "full")
    out = sums.join(touched.drop("tops", "cuts"), "sku_id", "left").join(listed, "sku_id", "left")
    none = F.array().cast(f"array<{_PLACE}>")
    return out.select(
        "sku_id",
        bucket().alias("bucket"),
        *[(F.coalesce(c, F.lit(0)) + F.col(f"{c}_d")).cast("bigint").alias(c) for c in SUMS],
        F.coalesce("tops", none).alias("tops"),
        F.coalesce("cuts", none).alias("cuts"),
        F.coalesce(F.col("short") | F.col("empty"), F.col("short"), F.col("empty"), F.lit(False)).alias("short"),
    )


def looked_up(short: DataFrame, applied: DataFrame, spare: int = SPARE) -> DataFrame:
    """(sku_id, tops, cuts) of the given SKUs, from all videos that tag them."""
    places = _places(applied, "now").join(short.select("sku_id"), "sku_id", "left_semi")
    ranked = _best(places, spare, 1).withColumn("cut", F.lit(None).cast(_PLACE))
    return _listed(ranked, spare).select("sku_id", F.col("tops").alias("all_tops"), F.col("cuts").alias("all_cuts"))


def with_looked_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """State rows whose short lists are replaced."""
    joined = rows.join(found, "sku_id", "left")
    none = F.array().cast(f"array<{_PLACE}>")
    for c in ("tops", "cuts"):
        joined = joined.withColumn(c, F.when(F.col("short"), F.coalesce(f"all_{c}", none)).otherwise(F.col(c)))
    return joined.drop("all_tops", "all_cuts", "short")


def signal(state: DataFrame) -> DataFrame:
    """The SKU's demand signal with the highest lifts, as ``inventory.sku_signal`` gives it."""

    def highest(i: int) -> Column:
        return F.get(F.filter("tops", lambda p: p["measure"] == i), F.lit(0))["value"]

    at = {name: highest(i) for i, (name, _) in enumerate(MEASURES)}
    return state.filter("n_videos > 0").select(
        "sku_id",
        F.col("n_videos").alias("active_video_count"),
        at["view_count"].cast("bigint").alias("max_view_count"),
        at["engagement_score"].alias("max_engagement_score"),
        F.try_divide(F.col("units"), F.col("scored")).alias("_mean"),
        at["demand_pressure"].alias("demand_pressure_proxy"),
        (F.col("viral") > 0).alias("has_viral_video"),
        *[at[c].alias(c) for c in C.LIFT_COLUMNS],
    ).withColumn("_mean", F.col("_mean") / SCORE_UNIT).withColumnRenamed("_mean", "avg_engagement_score")


def top_videos(state: DataFrame) -> DataFrame:
    """Ids of the videos with the highest P90 per SKU, best first, as ``ranking.top_videos`` gives them."""
    _, k = MEASURES[-1]
    places = F.slice(F.filter("tops", lambda p: p["measure"] == len(MEASURES) - 1), 1, k)
    listed = state.select("sku_id", F.transform(places, lambda p: p["video_id"]).alias("top_video_ids"))
    return listed.filter(F.size("top_video_ids") > 0)
