"""URL filters: host and path rules, and exact host membership by a Bloom filter cascade.

Rules name a host and a path prefix; a rule fits the host and all its subdomains, the
longest (host, then path) wins. Urls without a rule are judged by a list of hosts, held as
a cascade over the complete key universe (all hosts of the corpus): level 0 is a Bloom
filter of the listed hosts, level 1 one of the unlisted hosts that level 0 lets through,
level 2 one of the listed hosts that level 1 lets through, and so on until a level lets
nothing through. The first level that refuses a host then tells exactly whether it is
listed, so pages are judged in their scan, without a join.

A level is built by Spark: hosts hash to bit positions, positions are OR-ed into 64-bit
words with a map-side ``bit_or``, and only the words travel. A cascade is broadcast, so its
size is checked: hosts are dealt by hash to shards of at most ``SHARD_KEYS`` listed hosts,
a shard's cascade stays below ``MAX_BYTES`` or an error is raised, and a list of several
shards is judged in as many passes, each with one cascade in memory.

Defined results: NULL urls and urls without ``://`` have empty host and path, no rule, and
are judged like any host (the empty host can be listed); repeated urls get equal verdicts;
an empty list allows, an empty table gives no rows. Results are one struct column, so other
columns cannot clash.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from liftspark.llm.texts import table
from liftspark.sources.tables import stage

# (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Labels whose hosts the query lists.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino", "viagra", "free-money", "adult")
BITS_PER_KEY, HASHES = 10, 7
SHARD_KEYS = 4_000_000
MAX_BYTES = 32 << 20
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence = RULES) -> tuple:
    """Name and verdict of the longest fitting rule; NULL without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, f"{rule_host}{rule_path}").otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _hash(level: int, key: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{level}:"), key))


def _places(hashed: Column, bits: int) -> Column:
    """Bit positions by double hashing of the two halves."""
    low = hashed.bitwiseAND(0xFFFFFFFF)
    step = F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
    return F.array(*[(low + step * i) % bits for i in range(HASHES)])


class Cascade:
    """Levels of packed bits; ``listed`` is exact for the keys it was built over."""

    def __init__(self, levels: list):
        self.levels = levels

    @property
    def n_bytes(self) -> int:
        return sum(len(level) for level in self.levels)

    def passes(self, level: int, keys: Sequence) -> np.ndarray:
        """Which keys a level lets through."""
        bits = 8 * len(self.levels[level])
        packed = np.frombuffer(self.levels[level], np.uint8)
        digests = (xxhash.xxh64_intdigest(f"{level}:{k}".encode("utf-8", "surrogatepass"), 42) for k in keys)
        hashed = np.fromiter(digests, np.uint64, len(keys))
        low, step = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
        inside = np.ones(len(keys), bool)
        for i in range(HASHES):
            at = ((low + step * np.uint64(i)) % np.uint64(bits)).astype(np.int64)
            inside &= (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return inside

    def listed(self, keys: Sequence) -> np.ndarray:
        keys = np.asarray(keys, dtype=object)
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        left = np.arange(len(keys))
        for level in range(len(self.levels)):
            inside = self.passes(level, keys[left])
            out[left[~inside]] = level % 2 == 1
            left = left[inside]
        return out


def _member(spark: SparkSession, cascade: Cascade):
    shared = spark.sparkContext.broadcast(cascade)

    def member(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            codes, distinct = pd.factorize(keys.fillna(""))
            yield pd.Series(shared.value.listed(distinct)[codes] if len(distinct) else [], dtype=bool)

    return F.pandas_udf(member, BooleanType())


def _level(keys: DataFrame, level: int, n: int) -> bytes:
    """Bloom filter of ``n`` keys."""
    words = max(1, -(-n * BITS_PER_KEY // 64))
    if 8 * words > MAX_BYTES:
        raise ValueError(f"a level of {n} keys exceeds {MAX_BYTES} bytes")
    places = keys.select(F.explode(_places(_hash(level, F.col("key")), 64 * words)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = places.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = np.zeros(words, np.int64)
    for batch in np.array_split(np.array(rows.collect(), dtype=np.int64).reshape(-1, 2), 1):
        packed[batch[:, 0]] = batch[:, 1]
    return packed.astype("<i8").tobytes()


def build_cascade(universe: DataFrame) -> Cascade:
    """Cascade over rows (key, listed), keys distinct."""
    inserted, other, levels = universe.filter("listed"), universe.filter("NOT listed"), []
    n = inserted.count()
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        levels.append(_level(inserted, len(levels), n))
        top = Cascade([levels[-1]])
        through = _through(universe.sparkSession, top, len(levels) - 1)
        inserted, other = stage(other.filter(through(F.col("key"))), "cascade"), inserted
        n = inserted.count()
    cascade = Cascade(levels)
    if cascade.n_bytes > MAX_BYTES:
        raise ValueError(f"the cascade exceeds {MAX_BYTES} bytes")
    return cascade


def _through(spark: SparkSession, top: Cascade, number: int):
    """Whether a key passes the newest level, which hashes with its own number."""
    shared = spark.sparkContext.broadcast((number, top.levels[0]))

    def through(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, bits = shared.value
        level = Cascade([b""] * number + [bits])
        for keys in batches:
            yield pd.Series(level.passes(number, keys.tolist()), dtype=bool)

    return F.pandas_udf(through, BooleanType())


def cascades(universe: DataFrame) -> list:
    """One cascade per shard of the universe (key, listed)."""
    universe = stage(universe, "universe")
    shards = max(1, -(-universe.filter("listed").count() // SHARD_KEYS))
    if shards == 1:
        return [build_cascade(universe)]
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    return [build_cascade(universe.filter(shard == i)) for i in range(shards)]


def listed(spark: SparkSession, host: Column, parts: list) -> Column:
    """Exact membership of a host of the universe."""
    found = F.lit(False)
    for i, cascade in enumerate(parts):
        inside = _member(spark, cascade)(host)
        mine = F.pmod(F.xxhash64(host), F.lit(len(parts))) == i if len(parts) > 1 else F.lit(True)
        found = found | (mine & inside)
    return found


def spam_label(host: Column) -> Column:
    """Whether a label of the host is on the query's list."""
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, SPAM_LABELS)))


def judge(pages: DataFrame, url: Column, name: str, rules: Sequence = RULES, is_listed=spam_label) -> DataFrame:
    """Pages with a struct (host, path, rule, verdict)."""
    hosts = pages.select(host_of(url).alias("key")).distinct()
    parts = cascades(hosts.withColumn("listed", F.coalesce(is_listed(F.col("key")), F.lit(False))))
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    by_list = F.when(listed(pages.sparkSession, host, parts), "block").otherwise("allow")
    return pages.withColumn(
        name,
        F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict")),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, F.col("url"), "j").select("page_id", "j.*")


_RULES_SQL = [
    (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", f"{h}{p}", v)
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
]
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in _RULES_SQL)} END AS rule,
  CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _RULES_SQL)}
    WHEN list_has_any(string_split(host, '.'), {list(SPAM_LABELS)}) THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""
