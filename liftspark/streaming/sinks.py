"""Sources, sinks and run helpers shared by the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftspark.session import STATE_STORE
from liftspark.sources import stored, tables

BATCH = "batch_id"
MAX_BATCHES = 10_000  # of a run, for the count of late rows


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream under a declared schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> int:
    """Work through everything that has arrived, batch by batch, and stop.

    Returns the number of rows that came after the watermark had closed their window.
    """
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    conf.set("spark.sql.streaming.numRecentProgressUpdates", str(MAX_BATCHES))
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()
    states = [state for progress in query.recentProgress for state in progress["stateOperators"]]
    return sum(state["numRowsDroppedByWatermark"] for state in states)


def write_final(stream: DataFrame, table: str, checkpoint: str) -> int:
    """Append each row once it is final to a stored table; returns the number of late rows.

    The table's log entry names the batch its rows go up to, so a batch that is run again after a
    failure adds nothing. Small folders are put together on the way.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        with tables.scratch(spark):
            # The batch is run even if its rows are there, since its state has to be written.
            rows = tables.stage(batch, "final")
            if _batch_of(spark, table) < batch_id:
                stored.append(spark, table, rows, meta={BATCH: batch_id})
                stored.compact(spark, table, rows.schema)

    return run_batches(stream, handle, checkpoint, "append")


def _batch_of(spark: SparkSession, table: str) -> int:
    return stored.entry(spark, table)["meta"].get(BATCH, -1)


def read_final(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """Rows that are final."""
    return stored.read(spark, table, schema)


def open_state(
    spark: SparkSession, table: str, checkpoint: str, operator: str | None = None, variable: str | None = None
) -> DataFrame | None:
    """What the query of ``write_final`` still holds, as of the last batch in its table.

    A query of several stateful operators names the one to read, and the variable of keyed
    state. None before the first batch.
    """
    batch = _batch_of(spark, table)
    if batch < 0:
        return None
    reader = spark.read.format("statestore").option("batchId", batch)
    if operator:
        listed = spark.read.format("state-metadata").load(checkpoint).filter(F.col("operatorName") == operator)
        reader = reader.option("operatorId", listed.first().operatorId)
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)
