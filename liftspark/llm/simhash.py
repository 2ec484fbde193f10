"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

A fingerprint has eight bytes. Three differing bits touch at most three of them, so linked
fingerprints share at least ``MIN_SHARED`` = 5 bytes in place. The index posts every
distinct fingerprint under 14 sets of four positional bytes, chosen so that any five bytes
contain exactly one of the sets: a pair shares a posting list exactly if it shares five
bytes. The tally of shared positional bytes decides in which of its lists a pair counts,
and the bits are verified.

Skew: equal fingerprints are one node, so a group of copies of any size is one row in the
index. A list of more than ``PAIR_LIMIT`` different fingerprints is not paired up: in it
32 bits are equal, and two fingerprints lie within three bits exactly if some value lies
within one bit of the first and two of the second. Every fingerprint is sent to those
values, and each value links all that reach it to the least within one bit, so links stay
in proportion to the fingerprints and none is lost between components.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like any
other; repeated rows get equal results; the component is the least id reachable (NULL ids
are passed over; NULL where there is no other); an empty table gives no rows. Only id and
text are read, so other columns cannot clash.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from liftspark.llm.components import components, with_least
from liftspark.llm.texts import free_name, table, utf8
from liftspark.sources.tables import stage

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 5
PAIR_LIMIT = 1024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLICE = 1 << 16


def _position_sets() -> list:
    """Sets of four byte positions; any five positions contain exactly one of them.

    Both halves, and every two pairs, one from each half, of the same of the three ways to
    split a half into pairs.
    """
    splits = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    crossed = [(*a, b[0] + 4, b[1] + 4) for split in splits for a in split for b in split]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *crossed]


POSITION_SETS = _position_sets()


def _mask(positions: Sequence) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text) -> int:
    """Majority of each bit over the shingle hashes, as a signed 64-bit number."""
    words = utf8(text).translate(_LOWER).split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        stop = min(at + _SLICE, n)
        parts = zip(*[words[at + j : stop + j] for j in range(width)])
        hashes = np.array([digest(b" ".join(p), SEED) for p in parts], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype=np.int64)


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many bytes two fingerprints share in place."""
    x = a.bitwiseXOR(b)
    return sum((x.bitwiseAND(F.lit(_mask([p]))) == 0).cast("int") for p in range(8))


def first_list(a: Column, b: Column) -> Column:
    """The first position set on which two fingerprints agree."""
    x = a.bitwiseXOR(b)
    out = F.lit(len(POSITION_SETS))
    for i, positions in reversed(list(enumerate(POSITION_SETS))):
        out = F.when(x.bitwiseAND(F.lit(_mask(positions))) == 0, i).otherwise(out)
    return out


def postings(nodes: DataFrame) -> DataFrame:
    """(list, key, fp): every fingerprint under each position set."""
    keys = [
        F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key"))
        for i, s in enumerate(POSITION_SETS)
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.list", "k.key", "fp")


def _paired(lists: DataFrame) -> DataFrame:
    """Verified pairs of short lists, each pair in the first of its lists only."""
    a = lists.select("list", "key", F.col("fp").alias("u"))
    b = lists.select("list", "key", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    return (
        a.join(b, ["list", "key"])
        .filter(u > v)
        .filter(shared_bytes(u, v) >= MIN_SHARED)
        .filter(first_list(u, v) == F.col("list"))
        .filter(bits_apart(u, v) <= MAX_BITS)
        .select("u", "v")
    )


def _flips(positions: Sequence, most: int) -> list:
    """Numbers with up to ``most`` bits set outside the positions."""
    free = [b for b in range(64) if b // 8 not in positions]
    one = [1 << b for b in free]
    out = [0, *one] + ([a | b for i, a in enumerate(one) for b in one[:i]] if most > 1 else [])
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _hubbed(lists: DataFrame) -> DataFrame:
    """Links of long lists through common neighbours; every edge is at most three bits."""
    edges = None
    for i, positions in enumerate(POSITION_SETS):
        own = lists.filter(F.col("list") == i).select("fp")

        def reached(most: int, name: str):
            flips = F.array(*[F.lit(x).cast("long") for x in _flips(positions, most)])
            hub = F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp"))))
            return own.select(hub.alias("hub"), F.col("fp").alias(name))

        centre = reached(1, "v").groupBy("hub").agg(F.min("v").alias("v"))
        found = reached(MAX_BITS - 1, "u").join(centre, "hub").filter("u != v").select("u", "v")
        edges = found if edges is None else edges.union(found)
    return edges


def links(nodes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` as all links do."""
    index = postings(nodes)
    sizes = index.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = stage(index.join(sizes, ["list", "key"]), "postings")
    edges = _paired(lists.filter(F.col("n") <= pair_limit))
    long_lists = lists.filter(F.col("n") > pair_limit)
    if not long_lists.isEmpty():
        edges = edges.union(_hubbed(long_lists))
    return edges


def _placed(prints: DataFrame, least: Column) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint; the root names its component."""
    nodes = stage(prints.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stage(placed, "placed")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = docs.select(F.col(doc_id).alias("doc_id"), _fingerprint(F.col(text)).alias("fp"))
    prints = stage(prints, "prints")
    placed = _placed(prints, F.col("doc_id"))
    named = with_least(placed, "root", "least", "fp").select("fp", F.col("m").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, the same for equal rows only."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]))
    return F.md5(F.concat(F.coalesce(F.md5("text"), F.lit("")), F.lit("|"), others))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least id, NULL ids last.

    Rows are told apart by their content, not by their id: a NULL or repeated id may stand in
    several components, and each of them keeps a row. Of several rows with the least id that
    with the least hash over all columns stays, whatever the order of tasks.
    """
    name = free_name(docs, "_row")
    docs_hashed = docs.withColumn(name, _row_hash(docs))
    prints = docs_hashed.select("doc_id", F.col(name).alias("row"), _fingerprint(F.col("text")).alias("fp"))
    least = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    chosen = _placed(stage(prints, "prints"), least).groupBy("root").agg(F.min("least").alias("least"))
    kept = chosen.select(F.col("least.row").alias(name))
    return docs_hashed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
