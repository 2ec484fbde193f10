"""Stored tables: a log of versions over immutable data folders.

::

    table/data/stored_version=<id>/[part=<value>/]*.parquet   written once, never changed
    table/_log/<number>.json                      the live folders of each part, with their size

A write puts rows into a new data folder and then commits a log entry, a small file that is
created only if its number is free. Readers take the newest entry, so they see the table before
or after a write, never between; a write that breaks off leaves the table as it was. An entry
lists one line per part (days, as a rule), so it stays small. A reader opens the folders of the
parts it asks for, and lists no others.

Two writers that start from the same version reach for the same number, and one of them gets
``Conflict``: an upsert then starts again from the new version, an append just takes the next
number. Appended folders pile up until ``compact`` puts the small ones of a part together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from liftspark.sources import tables
from liftspark.sources.upsert import last_per_key

VERSION = "stored_version"
UNKNOWN = "__HIVE_DEFAULT_PARTITION__"  # part of the rows whose part column is NULL
MAX_PARTS = 5_000  # days a batch may touch
ATTEMPTS = 5  # of a write that others get ahead of
SMALL_BYTES = 64 << 20  # folders below are put together
MANY_FOLDERS = 16  # small folders a part may have
ORPHAN_HOURS = 24  # data without an entry may belong to a writer that is still at work


class Conflict(RuntimeError):
    """Another writer has committed the version this write started from."""


def _listed(spark: SparkSession, path: str):
    """Statuses below a path; none if the path is absent."""
    if not tables.path_exists(spark, path):
        return []
    return list(tables.file_system(spark, path).listStatus(tables.hadoop_path(spark, path)))


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    names = [s.getPath().getName() for s in _listed(spark, path)]
    return sorted(n for n in names if n.startswith(prefix))


def label(value) -> str:
    """Name of the part that rows with this value lie in."""
    return UNKNOWN if value is None else str(value)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Numbers of the log entries, oldest first."""
    names = _folders(spark, f"{path}/_log", "")
    return [n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(".")]


def next_number(spark: SparkSession, path: str) -> str:
    """Number that a write based on the present version takes."""
    names = entries(spark, path)
    return f"{int(names[-1]) + 1 if names else 0:012d}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the table has a committed version; read errors are errors, not absence."""
    return bool(entries(spark, path))


def entry(spark: SparkSession, path: str, number: str | None = None) -> dict:
    """A log entry: ``parts`` with [folder, files, bytes] of each live folder, ``meta``, ``schema``."""
    number = number or next(iter(entries(spark, path)[-1:]), None)
    if number is None:
        return {"parts": {}, "meta": {}, "schema": None}
    return json.loads(tables.read_text(spark, f"{path}/_log/{number}.json"))


def live(spark: SparkSession, path: str, number: str | None = None) -> dict[str, list[str]]:
    """Data folders of each part."""
    return {part: [f[0] for f in folders] for part, folders in entry(spark, path, number)["parts"].items()}


def schema_of(spark: SparkSession, path: str) -> StructType:
    """Schema the table was last written with."""
    return StructType.fromJson(entry(spark, path)["schema"])


def _opened(spark: SparkSession, path: str, schema: StructType, part: str | None, folders: Sequence[str]) -> DataFrame:
    full = StructType([f for f in schema.fields if f.name != part]).add(VERSION, "string")
    if part:
        full = full.add(part, schema[part].dataType if part in schema.names else DateType())
    reader = spark.read.schema(full).option("basePath", f"{path}/data")
    return reader.parquet(*[f"{path}/data/{f}" for f in folders]).select(*schema.names)


def read(
    spark: SparkSession,
    path: str,
    schema: StructType,
    part: str | None = None,
    days: Sequence | None = None,
    between: tuple | None = None,
    number: str | None = None,
) -> DataFrame:
    """The table, or the rows of the given days; None among the days means unknown ones.

    Only the folders of those days are opened. The part column is among the rows if it is in
    the schema. ``number`` asks for the version of that log entry.
    """
    parts = live(spark, path, number)
    if days is not None:
        parts = {k: parts[k] for k in {label(d) for d in days} & set(parts)}
    if between is not None:
        low, high = map(label, between)
        parts = {k: v for k, v in parts.items() if k != UNKNOWN and low <= k <= high}
    folders = [f for k in sorted(parts) for f in parts[k]]
    if not folders:
        return spark.createDataFrame([], schema)
    return _opened(spark, path, schema, part, folders)


def _write(spark: SparkSession, path: str, df: DataFrame, part: str | None) -> dict[str, list]:
    """Write rows to a new data folder; returns what an entry says of its parts."""
    version = f"{VERSION}={uuid.uuid4().hex}"
    home = f"{path}/data/{version}"
    if part:
        # One writer per day where days are small, several where one holds much.
        df.hint("rebalance", part).write.partitionBy(part).parquet(home)
        names = {n.split("=", 1)[1]: f"{version}/{n}" for n in _folders(spark, home, f"{part}=")}
    else:
        df.hint("rebalance").write.parquet(home)
        names = {"": version}
    system, out = tables.file_system(spark, home), {}
    for name, folder in names.items():
        summary = system.getContentSummary(tables.hadoop_path(spark, f"{path}/data/{folder}"))
        out[name] = [[folder, summary.getFileCount(), summary.getLength()]]
    return out


def _commit(spark: SparkSession, path: str, number: str, parts: dict, meta: dict, schema) -> None:
    text = json.dumps({"parts": parts, "meta": meta, "schema": schema})
    if not tables.create_once(spark, f"{path}/_log/{number}.json", text):
        raise Conflict(f"{path}: version {number} is there already")


def again(write: Callable[[], None]) -> None:
    """Run a write anew while other writers get ahead of it."""
    for attempt in range(ATTEMPTS):
        try:
            return write()
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise


def publish(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    part: str | None = None,
    days: Sequence | None = None,
    number: str | None = None,
    meta: dict | None = None,
) -> None:
    """Write rows and make them the table, or the given days of it.

    ``number`` is what ``next_number`` gave before the table was read for ``df``: if another
    writer has committed since, the commit fails with ``Conflict`` and nothing changes.
    """
    number = number or next_number(spark, path)
    before = entry(spark, path)
    parts = _write(spark, path, df, part)
    if days is not None:
        gone = {label(d) for d in days}
        parts = {k: v for k, v in before["parts"].items() if k not in gone} | parts
    _commit(spark, path, number, parts, before["meta"] | (meta or {}), df.schema.jsonValue())


def upsert(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    part: str | None = None,
    meta: dict | None = None,
) -> None:
    """Insert or replace by key; only the days of the batch are read, and only by their keys.

    Days in which the batch replaces rows are written anew; to the others its rows are added.
    ``part`` is a column the key determines; rows where it is NULL lie in a part of their own.
    Rows need whole keys: a NULL in one is an error, since no later row could replace it.
    """
    keys = list(keys)
    batch = _one_per_key(new, keys, order)
    broken = F.lit(False)
    for k in keys:
        broken |= F.col(k).isNull()
    shape = batch.select(F.col(part) if part else F.lit(None).alias("_part"), broken.alias("_broken"))
    found = shape.distinct().limit(2 * MAX_PARTS + 1).collect()
    if any(r[1] for r in found):
        raise ValueError(f"{path}: rows with NULL in {', '.join(keys)}")
    days = [r[0] for r in found] if part else None
    if part and len(days) > MAX_PARTS:
        raise ValueError(f"a batch may touch {MAX_PARTS} days at most")

    def write() -> None:
        number, before = next_number(spark, path), entry(spark, path)
        if before["schema"] and not found and not meta:
            return
        base, rows, gone = read(spark, path, batch.schema, part, days), batch, set()
        if before["parts"].keys() & ({label(d) for d in days} if part else {""}):
            where = F.col(part) if part else F.lit(None)
            held = base.select(*keys, where.alias("_part")).join(batch.select(*keys).hint("merge"), keys, "left_semi")
            held = tables.stage(held, "replaced")
            again_on = [r[0] for r in held.select("_part").distinct().collect()]
            if again_on:
                gone = {label(d) for d in again_on} if part else {""}
                base = read(spark, path, batch.schema, part, again_on if part else None)
                rows = base.join(held.select(*keys), keys, "left_anti").select(*base.columns).unionByName(batch)
        made = _write(spark, path, rows, part)
        parts = {k: v for k, v in before["parts"].items() if k not in gone}
        parts |= {k: parts.get(k, []) + v for k, v in made.items()}
        _commit(spark, path, number, parts, before["meta"] | (meta or {}), batch.schema.jsonValue())

    again(write)
    compact(spark, path, batch.schema, part)


def _one_per_key(new: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """The rows as files, one of each key. Keys alone are shuffled, and the rows of repeated ones."""
    rows = tables.stage(new, "arrived")
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    repeated = tables.stage(repeated, "repeated")
    if repeated.isEmpty():
        return rows
    # A NULL in a key meets nothing, so such rows stay and are found by the caller.
    alone = rows.join(repeated, keys, "left_anti").select(*rows.columns)
    last = last_per_key(rows.join(repeated, keys, "left_semi").select(*rows.columns), keys, order)
    return tables.stage(alone.unionByName(last), "batch")


def append(spark: SparkSession, path: str, df: DataFrame, part: str | None = None, meta: dict | None = None) -> None:
    """Add rows; what is stored is not read, and writers do not get in each other's way.

    ``meta`` is committed with the rows, so a reader or a repeated run knows what they contain.
    """
    added = {} if df.isEmpty() else _write(spark, path, df, part)
    if not added and not meta and exists(spark, path):
        return

    def write() -> None:
        number, before = next_number(spark, path), entry(spark, path)
        parts = {k: before["parts"].get(k, []) + added.get(k, []) for k in before["parts"] | added}
        known = before["schema"] or df.schema.jsonValue()
        _commit(spark, path, number, parts, before["meta"] | (meta or {}), known)

    again(write)


def compact(
    spark: SparkSession,
    path: str,
    schema: StructType,
    part: str | None = None,
    many: int = MANY_FOLDERS,
    small: int = SMALL_BYTES,
) -> int:
    """Put the small folders of each part that has at least ``many`` of them together.

    Large folders stay as they are, so a row is rewritten a few times at most. Returns the number
    of folders put together; rows are the same before and after.
    """
    merged = 0

    def write() -> None:
        nonlocal merged
        number, before = next_number(spark, path), entry(spark, path)
        little = {k: [f for f in v if f[2] < small] for k, v in before["parts"].items()}
        little = {k: v for k, v in little.items() if len(v) >= max(many, 2)}
        merged = sum(map(len, little.values()))
        if not little:
            return
        wide = schema if part is None or part in schema.names else StructType([*schema.fields]).add(part, DateType())
        rows = _opened(spark, path, wide, part, [f[0] for v in little.values() for f in v])
        made = _write(spark, path, rows, part)
        parts = {k: [f for f in v if f not in little.get(k, [])] + made.get(k, []) for k, v in before["parts"].items()}
        _commit(spark, path, number, {k: v for k, v in parts.items() if v}, before["meta"], before["schema"])

    again(write)
    return merged


def vacuum(spark: SparkSession, path: str, keep: int = 3) -> int:
    """Delete entries older than the newest ``keep``, the data only they need, and what broke off."""
    known = entries(spark, path)
    kept, old = known[-keep:], known[:-keep]
    needed = {f.split("/")[0] for n in kept for fs in live(spark, path, n).values() for f in fs}
    garbage = {f.split("/")[0] for n in old for fs in live(spark, path, n).values() for f in fs} - needed
    before = (time.time() - ORPHAN_HOURS * 3600) * 1000
    for status in _listed(spark, f"{path}/data"):
        name = status.getPath().getName()
        if name not in needed and status.getModificationTime() < before:
            garbage.add(name)
    gone = [f"{path}/data/{f}" for f in sorted(garbage) if tables.path_exists(spark, f"{path}/data/{f}")]
    gone += [f"{path}/_log/{n}.json" for n in old]
    for name in gone:
        tables.remove(spark, name)
    return len(gone)
