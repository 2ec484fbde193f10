"""Alert cooldown over a stream, in keyed state.

Candidates first combine to one row per SKU and hourly cycle, with map-side maxima, so a SKU
with a third of all candidates sends one row per task and hour. A cycle is emitted once, when the
watermark closes it; the last alert of each SKU is a keyed value in the state store, read and
written for the SKUs with closed cycles only, and a timer forgets it when its pause is over.
Cycles closed in one batch are decided in order of time; those of later batches are later.

Alerts are appended to a stored table whose log names the batch, so a batch that is run again
after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from liftspark.config import RiskConfig
from liftspark.streaming import sinks

OUTPUT = "sku_id string, cycle timestamp, p90_demand_lift double"
_CYCLE = "struct<cycle: timestamp, p90_demand_lift: double>"
_PASSED = "sku_id string, millis long, p90_demand_lift double"
_HOUR_MILLIS = 3_600_000


class _Pause(StatefulProcessor):
    """Lets the first closed cycle of a SKU through, then none until the pause is over."""

    def __init__(self, hours: int):
        self.millis = hours * _HOUR_MILLIS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "millis long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        before = last = held[0] if held else None
        for millis, lift in sorted((r.millis, r.p90_demand_lift) for r in rows):
            if last is None or millis >= last + self.millis:
                last = millis
                yield Row(sku_id=key[0], millis=millis, p90_demand_lift=lift)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.millis)
            self.last.update((last,))
            self.handle.registerTimer(last + self.millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held and held[0] + self.millis <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_cooldown(candidates: DataFrame, hours: int, lateness: str) -> DataFrame:
    """Stream of alerts (sku_id, cycle, p90_demand_lift) of closed cycles.

    Candidates without a SKU or a time belong to no cycle and are left out; one without a lift
    counts as the least.
    """
    known = candidates.filter("sku_id IS NOT NULL AND created_at IS NOT NULL")
    cycles = (
        known.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "sku_id")
        .agg(F.max("p90_demand_lift").alias("p90_demand_lift"))
        .select(
            "sku_id",
            F.window_time("w").alias("at"),
            F.unix_millis(F.col("w.start")).alias("millis"),
            "p90_demand_lift",
        )
    )
    passed = cycles.groupBy("sku_id").transformWithState(_Pause(hours), _PASSED, "Append", "eventTime")
    return passed.select("sku_id", F.timestamp_millis("millis").alias("cycle"), "p90_demand_lift")


def run_cooldown(
    candidates: DataFrame,
    out: str,
    home: str,
    hours: int = RiskConfig().cooldown_hours,
    lateness: str = "1 hour",
) -> int:
    """Thin arriving candidates (sku_id, created_at, p90_demand_lift) to one alert per pause.

    ``home`` keeps progress and state, ``out`` is the stored table of alerts. Returns the
    number of rows (one per SKU, cycle and task) that came after their cycle was decided;
    they are counted, not used.
    """
    return sinks.write_final(stream_cooldown(candidates, hours, lateness), out, home)


def _schema() -> StructType:
    return StructType.fromDDL(OUTPUT)


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    """Alerts (sku_id, cycle, p90_demand_lift) let through so far."""
    return sinks.read_final(spark, out, _schema())


def _folded(cycles: Column, last: Column, hours: int) -> Column:
    """The cycles let through after the last alert, in order of time."""
    pause = F.make_dt_interval(hours=F.lit(hours))
    start = F.struct(last.alias("last"), F.array().cast(f"array<{_CYCLE}>").alias("passed"))

    def step(state: Column, cycle: Column) -> Column:
        free = state["last"].isNull() | (cycle["cycle"] >= state["last"] + pause)
        return F.when(
            free,
            F.struct(cycle["cycle"].alias("last"), F.concat(state["passed"], F.array(cycle)).alias("passed")),
        ).otherwise(state)

    return F.aggregate(cycles, start, step)["passed"]


def read_due(spark: SparkSession, out: str, home: str, hours: int = RiskConfig().cooldown_hours) -> DataFrame:
    """Alerts that the cycles still open would let through, if nothing else arrived.

    Read from the query's own state as of the last batch in ``out``; the run can go on
    afterwards. A SKU has at most the open hours of the watermark delay.
    """
    cycles = sinks.open_state(spark, out, home, "stateStoreSave")
    if cycles is None:
        return spark.createDataFrame([], _schema())
    cycle = F.struct(F.col("key.window.start").alias("cycle"), F.col("value").cast("struct<v: double>")["v"].alias("p90_demand_lift"))
    waiting = cycles.groupBy(F.col("key.sku_id").alias("sku_id")).agg(F.array_sort(F.collect_list(cycle)).alias("open"))
    lasts = sinks.open_state(spark, out, home, "transformWithStateInPySparkExec", "last")
    lasts = lasts.select("key.sku_id", F.timestamp_millis("value.millis").alias("last"))
    passed = _folded(F.col("open"), F.col("last"), hours)
    return waiting.join(lasts, "sku_id", "left").select("sku_id", F.inline(passed))
