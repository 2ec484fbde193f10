"""Small helpers shared by the text operators.

A word is a run of characters other than space and the ASCII control separators, which is
what ``bytes.split`` without argument yields for UTF-8.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATORS = " \t\n\x0b\x0c\r"
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def struct(columns: str) -> StructType:
    """Struct type of ``name type`` pairs with simple types, without a running session."""
    out = StructType()
    for column in columns.split(","):
        name, kind = column.split()
        out = out.add(name, kind)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; NULL has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS)
    return F.size(F.array_remove(parts, "")).cast("long")


def utf8(text) -> bytes:
    """UTF-8 bytes of a text; a missing text is empty."""
    return b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")


def joined(spans) -> str:
    """``kind:start:end`` of each span, comma-joined in the given order."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
