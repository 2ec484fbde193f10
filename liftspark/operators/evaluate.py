"""Label and evaluation of the quantile predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.operators import intervals


def pinball(y: Column, q: Column, alpha: float) -> Column:
    miss = y - q
    return F.avg(F.greatest(alpha * miss, (alpha - 1) * miss))


def coverage(y: Column, q: Column) -> Column:
    """Share of labels at or below the prediction."""
    return F.avg((y <= q).cast("int"))


def mae(y: Column, q: Column) -> Column:
    return F.avg(F.abs(y - q))


def mape(y: Column, q: Column) -> Column:
    """Mean relative error over the labels that are not zero; zero if there are none."""
    return F.coalesce(F.avg(F.when(y != 0, F.abs((y - q) / y))), F.lit(0.0))


SKETCH_ACCURACY = 100_000
BRACKET = (0.4999, 0.5001)  # wider than the sketch can err
SLICES = 4096


def exact_median(df: DataFrame, value: Column) -> float | None:
    """Exact median without gathering or ranking the values.

    A mergeable sketch brackets the middle of the order, then the bracket is narrowed by
    counting: each pass counts, per equal slice of the bracket, the values in it, and goes
    on in the slice of the middle rank. A pass moves ``SLICES`` numbers; the bracket ends
    on a single value after a few passes, however many values lie in it.
    """
    values = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    ends = F.percentile_approx("v", list(BRACKET), SKETCH_ACCURACY).alias("ends")
    n, ends = values.agg(F.count("v"), ends).first()
    if not n:
        return None
    return (_ranked(values, (n + 1) // 2, *ends) + _ranked(values, n // 2 + 1, *ends)) / 2


def _ranked(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of a rank, which lies between ``low`` and ``high``."""
    v = F.col("v")
    while low < high:
        width = (high - low) / SLICES
        cut = F.least(F.floor((v - low) / width), F.lit(SLICES - 1)) if width > 0 else F.lit(0)
        slice_ = F.when(v < low, -1).when(v <= high, cut)
        rows = values.groupBy(slice_.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        counts = {r.s: r for r in rows.filter("s IS NOT NULL").collect()}
        seen = counts.pop(-1).n if -1 in counts else 0
        for s in sorted(counts):
            seen += counts[s].n
            if seen >= rank:
                break
        if (counts[s].a, counts[s].b) == (low, high):
            # Neighbouring numbers: no slice parts them any more.
            below = values.agg(F.count_if(v <= low)).first()[0]
            return low if below >= rank else high
        low, high = counts[s].a, counts[s].b
    return low


def interval_width(df: DataFrame, p10: Column, p90: Column, exact: bool = True) -> dict[str, Column]:
    """Mean and median width of the P10 to P90 interval; ``exact=False`` sketches the median."""
    width = p90 - p10
    if exact:
        middle = F.lit(exact_median(df, width)).cast("double")
    else:
        middle = F.percentile_approx(width, 0.5, SKETCH_ACCURACY)
    return {"mean_interval_width": F.avg(width), "median_interval_width": middle}


def evaluate(df: DataFrame, label: str = C.LABEL, exact: bool = True) -> DataFrame:
    """All metrics in one row; a missing prediction column counts as 0.0.

    One aggregation, plus the two passes of the exact median.
    """
    y = F.col(label)
    lifts = {
        q: F.col(f"{q}_demand_lift") if f"{q}_demand_lift" in df.columns else F.lit(0.0)
        for q in C.QUANTILES
    }
    metrics = {}
    for q, alpha in C.QUANTILES.items():
        metrics[f"{q}_pinball_loss"] = pinball(y, lifts[q], alpha)
        metrics[f"{q}_coverage"] = coverage(y, lifts[q])
    metrics["p50_mae"] = mae(y, lifts["p50"])
    metrics["p50_mape"] = mape(y, lifts["p50"])
    labelled = df.filter(y.isNotNull())
    metrics.update(interval_width(labelled, lifts["p10"], lifts["p90"], exact))
    return labelled.agg(*[m.alias(n) for n, m in metrics.items()])


def demand_lift_label(sales: DataFrame, posts: DataFrame, hours: int = 24) -> DataFrame:
    """Sales in the first ``hours`` of a video over its mean sales of one such period.

    ``sales`` has (video_id, sold_at, amount), ``posts`` (video_id, posted_at, periods),
    where ``periods`` is the number of periods observed. Posts are unique, so the join is
    one to many and the sums combine before the shuffle. NULL without sales.
    """
    end = F.col("posted_at") + F.make_dt_interval(hours=F.lit(hours))
    inside = (F.col("sold_at") >= F.col("posted_at")) & (F.col("sold_at") < end)
    sums = (
        sales.join(posts.select("video_id", "posted_at"), "video_id")
        .groupBy("video_id")
        .agg(
            F.sum(F.when(inside, F.col("amount")).otherwise(0)).alias("early"),
            F.sum("amount").alias("total"),
        )
    )
    lift = F.try_divide(
        (F.col("early") * F.col("periods")).cast("double"), F.col("total").cast("double")
    )
    return posts.join(sums, "video_id", "left").select(
        "video_id", F.round(lift, 4).alias(C.LABEL)
    )


def sku_sales_within(sales: DataFrame, bridge: DataFrame, hours: int = 24) -> DataFrame:
    """Sales of each tagged SKU in the first ``hours`` after a video's post, for sales without video.

    ``sales`` has (sku_id, sold_at, amount), ``bridge`` (video_id, sku_id, posted_at). Sales of one
    SKU and moment are added up, and posts of one SKU and moment are joined once, before they meet.
    Tags without sales have zeros.
    """
    moments = sales.groupBy("sku_id", "sold_at").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    tags = bridge.select("video_id", "sku_id", "posted_at").distinct()
    posts = tags.select("sku_id", "posted_at").distinct()
    found = intervals.within(moments, posts, ["sku_id"], "sold_at", "posted_at", hours)
    sums = found.groupBy("sku_id", "posted_at").agg(F.sum("n").alias("n_sales"), F.sum("amount").alias("amount"))
    return tags.join(sums, ["sku_id", "posted_at"], "left").select(
        "video_id", "sku_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sales", "amount")]
    )
