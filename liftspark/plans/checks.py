"""Declared checks of stored tables, kept by day.

Beside a table lie two small ones with the same days: ``<name>_check_counts`` has what each day adds
to the counts of NULLs and unexpected values, ``<name>_check_values`` how often each day has each
value of the unique columns. Their log entries name the folders of the table that were checked, so
a run finds the days that were written since by comparing names: it reads and checks those, and
nothing else of the table. How many values are repeated is a number in the log entry; values
that a run brings or takes away are looked up among the values of the other days. A run that only
corrects rows changes no value and looks up nothing.

Both tables are replaced by whole days in one commit each: a run that breaks off leaves the
former results, and the next one makes up for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from liftspark.operators import quality
from liftspark.plans import hourly
from liftspark.plans.hourly import DAY
from liftspark.session import tune
from liftspark.sources import stored, tables

FOLDERS, REPEATED = "checked_folders", "repeated"
COUNTS = "check string, column_name string, failures bigint, day date"
VALUES = "column_name string, value string, n bigint, day date"


def _schema(spark: SparkSession, text: str) -> StructType:
    return spark.createDataFrame([], text).schema


def _rows(spark: SparkSession, root: str, name: str, number: str, parts: Sequence[str]) -> DataFrame:
    """Rows of some parts with their day; a table without days is of the unknown one."""
    path, schema = hourly._path(root, name), hourly._schema(spark, root, name)
    if name not in hourly._DAY_OF:
        rows = stored.read(spark, path, schema, days=parts, number=number)
        return rows.withColumn(DAY, F.lit(None).cast("date"))
    wide = schema if DAY in schema.names else StructType([*schema.fields]).add(DAY, DateType())
    return stored.read(spark, path, wide, DAY, parts, number=number)


def _refresh(spark: SparkSession, root: str, name: str, kind: str, schema: str, make, change=None) -> list[str]:
    """Bring the parts of a check table up to the present version of its table; returns them.

    ``make`` gives the check rows of table rows, ``change`` what they change in the log entry.
    """
    source, path = hourly._path(root, name), f"{hourly._path(root, name)}_check_{kind}"
    done: list[str] = []

    def write() -> None:
        nonlocal done
        version = stored.entries(spark, source)[-1]
        now = stored.live(spark, source, version)
        number, meta = stored.next_number(spark, path), stored.entry(spark, path)["meta"]
        before = meta.get(FOLDERS, {})
        done = sorted(p for p in now.keys() | before.keys() if now.get(p) != before.get(p))
        if not done and stored.exists(spark, path):
            return
        days, form = [stored.UNKNOWN] if done == [""] else done, _schema(spark, schema)
        with tables.scratch(spark):
            new = tables.stage(make(_rows(spark, root, name, version, done)).select(*form.names), "checked")
            more = {FOLDERS: now}
            if change:
                kept = [d for d in stored.live(spark, path) if d not in days]
                old = stored.read(spark, path, form, DAY, days)
                more |= change(meta, old, new, stored.read(spark, path, form, DAY, kept))
            stored.publish(spark, path, new, DAY, days, number, more)

    stored.again(write)
    return done


def refresh(spark: SparkSession, root: str, name: str) -> list[str]:
    """Check the days of a stored table that were written since the last run; returns them."""
    tune(spark)
    unique, not_null, accepted = quality.DECLARED[name]

    def repeated(meta: dict, old: DataFrame, new: DataFrame, rest: DataFrame) -> dict:
        counts = dict(meta.get(REPEATED, {}))
        for row in quality.repeated_change(old, new, rest).collect():  # one row per unique column
            counts[row.column_name] = counts.get(row.column_name, 0) + row.change
        return {REPEATED: counts}

    if unique:
        _refresh(
            spark, root, name, "values", VALUES,
            lambda df: quality.value_parts(df, DAY, unique), repeated,
        )
    return _refresh(
        spark, root, name, "counts", COUNTS, lambda df: quality.count_parts(df, DAY, not_null, accepted)
    )


def results(spark: SparkSession, root: str, name: str) -> list[DataFrame]:
    """(check, column_name, failures) of a table as of its last check, from the partial results."""
    path, (unique, not_null, accepted) = hourly._path(root, name), quality.DECLARED[name]
    form = "check string, column_name string, failures bigint"
    declared = [("not_null", c, 0) for c in not_null] + [("accepted_values", c, 0) for c in accepted]
    # A row for each declared check, so that a table without rows has its checks too.
    parts = stored.read(spark, f"{path}_check_counts", _schema(spark, COUNTS), DAY).drop(DAY)
    parts = parts.unionByName(spark.createDataFrame(declared, form))
    counts = parts.groupBy("check", "column_name").agg(F.sum("failures").alias("failures"))
    if not unique:
        return [counts]
    found = stored.entry(spark, f"{path}_check_values")["meta"].get(REPEATED, {})
    return [counts, spark.createDataFrame([("unique", c, found.get(c, 0)) for c in unique], form)]


def report(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """Check results of several stored tables with severity and status; no table is read."""
    return quality.report({name: results(spark, root, name) for name in names})
