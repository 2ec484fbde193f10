"""Reading and writing the Parquet tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark import schemas
from liftspark.session import scratch_path


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; any other trouble with it is raised."""
    return file_system(spark, path).exists(hadoop_path(spark, path))


def make_folder(spark: SparkSession, path: str) -> str:
    """The path, as an empty folder that a stream can watch."""
    file_system(spark, path).mkdirs(hadoop_path(spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    """Content of one small file."""
    stream = file_system(spark, path).open(hadoop_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file of this content unless there is one; of several writers exactly one succeeds.

    Nobody sees the file before it is whole: a finished file is linked or renamed to its name
    where the store has no overwriting rename, and elsewhere a new object appears when closed.
    """
    system = file_system(spark, path)
    target = hadoop_path(spark, path)
    scheme = system.getUri().getScheme()
    system.mkdirs(target.getParent())
    beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    if scheme == "file":
        made, name = (hadoop_path(spark, p).toUri().getPath() for p in (beside, path))
        with open(made, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(made, name)
        except FileExistsError:
            return False
        finally:
            os.remove(made)
        return True
    if scheme in ("hdfs", "viewfs"):
        _write_text(system, hadoop_path(spark, beside), text)
        if system.rename(hadoop_path(spark, beside), target):
            return True
        remove(spark, beside)
        return False
    try:
        _write_text(system, target, text)
    except Py4JJavaError as error:
        if path_exists(spark, path):
            return False
        raise error
    return True


def _write_text(system, target, text: str) -> None:
    out = system.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an appended-to or fully written Parquet folder is there and complete."""
    return path_exists(spark, f"{path}/_SUCCESS")


def overwrite(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Full refresh of a table that ``df`` does not itself read.

    Partitioned output is rebalanced first: one writer per partition where it is small,
    several where one partition holds much of the data.
    """
    partition_by = list(partition_by)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder, and read it back.

    Later steps then depend on files, not on the executors that computed them.
    """
    path = scratch_path(df.sparkSession, name)
    for made in _SCRATCH:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []  # paths staged inside the open ``scratch`` blocks


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was staged inside; nothing staged may leave the block."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            remove(spark, path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a result that is recomputed at each read."""
    df.createOrReplaceTempView(name)
    return df


def encode_lists(df: DataFrame) -> DataFrame:
    """Replace each array column ``x`` by its JSON text in ``x_json``."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(
        *[
            F.to_json(F.coalesce(c, F.array())).alias(f"{c}_json") if c in arrays else F.col(c)
            for c in df.columns
        ]
    )


def with_alert_defaults(df: DataFrame, as_of) -> DataFrame:
    """Complete alert rows: missing columns are NULL, status PENDING, times ``as_of``."""
    defaults = {"status": F.lit("PENDING"), "created_at": as_of, "updated_at": as_of}
    out = []
    for f in schemas.AGENT_ALERTS.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            value = F.coalesce(value, defaults[f.name])
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row (table_name, n) per table, each counted where it lies."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
