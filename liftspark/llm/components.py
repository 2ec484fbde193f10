"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftspark.sources.tables import stage

SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, spread: str) -> DataFrame:
    """Rows with ``m``, the least ``value`` among the rows of their key.

    The rows of a key are dealt to ``SALTS`` parts by the hash of ``spread``, and the least
    value goes to the parts there are, so a key with a third of all rows is joined by many
    tasks and the joined side never has more rows than ``rows``.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    parts = rows.groupBy(key, salt.alias("salt")).agg(F.min(value).alias("m"))
    least = parts.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    dealt = least.select(key, F.explode("salts").alias("salt"), "m")
    return rows.withColumn("salt", salt).join(dealt, [key, "salt"]).drop("salt")


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and its neighbours."""
    return with_least(edges, "u", "v", "v").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node already."""
    found = _least(edges)
    rest = found.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(found.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node.

    Each round is two joins with a map-side minimum per node and is written to the shared
    folder; the edges of a node are dealt to several tasks. The number of rounds follows the
    logarithm of the longest chain.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = stage(edges.select(u.alias("u"), v.alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        edges = stage(_small_star(_large_star(edges)).distinct(), "edges")
