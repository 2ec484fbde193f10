"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of a test question or answer is a pattern; a shorter
item is one pattern. Texts are normalised (A-Z lowered, words joined by single spaces),
scanned once, and matches are mapped back to word numbers and to offsets of the original.

The benchmark is the stated query set: its windows are read in blocks of at most ``MAX_NODES``
trie nodes (an item may lie in several; one longer window is a block of its own). Up to one block,
the usual case, the texts are scanned once where they are read. Beyond it there is one pass per
block, one after the other: each adds its hits to those of the passes before and is written to the
shared folder, so a task holds one automaton of bounded size however long the benchmark is, and
nothing is shuffled.

Defined results: NULL and empty texts and items have no words; repeated items count once
per id; passages of items without id are hit but are in no list of items; documents equal in
text get equal results; an empty benchmark hits nothing. Documents are only scanned row by row, so length and repetition cost no more
than their bytes.
"""

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from liftspark.llm.texts import free_name, sha256, struct, table, utf8
from liftspark.session import scratch_path
from liftspark.sources.tables import remove

WORDS = 10
MAX_NODES = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Bytes of words stay, A-Z are lowered, all other ASCII becomes a space.
_FOLD = bytes(
    b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
_LOWER = {c: c + 32 for c in range(65, 91)}  # keeps every offset
HITS = (
    StructType()
    .add("n_words", LongType())
    .add("starts", ArrayType(IntegerType()))
    .add("ends", ArrayType(IntegerType()))
    .add("items", ArrayType(StringType()))
)


def words(text) -> list:
    """Normalised words of a text, as UTF-8."""
    return utf8(text).translate(_FOLD).split()


def windows(item: list) -> set:
    """Patterns of an item: its windows, each between spaces."""
    last = max(len(item) - WORDS, 0)
    return {b" %s " % b" ".join(item[i : i + WORDS]) for i in range(last + 1)} if item else set()


def build(items: list):
    """Automaton over the windows of (item id, words); a window knows its items."""
    owners = {}
    for item, tokens in items:
        for window in windows(tokens):
            ids = owners.setdefault(window.decode("utf-8", "surrogatepass"), set())
            if item is not None:  # the passage counts all the same
                ids.add(item)
    automaton = ahocorasick.Automaton()
    for pattern, ids in owners.items():
        automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


def scan(text, automaton) -> tuple:
    """Number of words, hit word runs [start, end), and the items found."""
    tokens = words(text)
    if not tokens or not len(automaton):
        return len(tokens), [], [], []
    line = f" {b' '.join(tokens).decode('utf-8', 'surrogatepass')} "
    firsts, counts, items = [], [], set()
    for end, (size, count, ids) in automaton.iter(line):
        firsts.append(end + 1 - size)
        counts.append(count)
        items.update(ids)
    if not firsts:
        return len(tokens), [], [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    begin = np.searchsorted(spaces, firsts)
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + np.array(counts), -1)
    starts, ends = runs(np.cumsum(edges) > 0)
    return len(tokens), starts, ends, sorted(items)


def runs(mask) -> tuple:
    """Starts and ends of the runs of true values."""
    steps = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(mask, np.int8), [0]))))
    return steps[::2].tolist(), steps[1::2].tolist()


def offsets(text, starts, ends) -> list:
    """Code point spans of word runs in the original text."""
    if starts is None or not len(starts):
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in zip(starts, ends)]


def blocks(benchmark: DataFrame, max_nodes: int = MAX_NODES) -> Iterator[list]:
    """Items, or runs of their words, whose windows have at most ``max_nodes`` bytes together.

    Runs of one item overlap, so that each window lies in one of them.
    """
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for row in rows.filter("t IS NOT NULL").toLocalIterator():
        tokens = words(row.t)
        if not tokens:
            continue
        lengths = [len(t) + 1 for t in tokens]
        width = min(WORDS, len(tokens))
        begin, cost = 0, sum(lengths[:width]) + 1
        for i in range(len(tokens) - width + 1):
            if i:
                cost += lengths[i + width - 1] - lengths[i - 1]
            if size + cost > max_nodes and size:
                if i > begin:
                    block.append((row.i, tokens[begin : i - 1 + width]))
                yield block
                block, size, begin = [], 0, i
            size += cost
        block.append((row.i, tokens[begin:]))
    yield block


def scanner(spark: SparkSession, block: list):
    """Scalar function text -> hits of one block; each Python worker builds it once."""
    shared = spark.sparkContext.broadcast(block)

    def scan_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build(shared.value)
        for texts in batches:
            yield pd.DataFrame([scan(t, automaton) for t in texts], columns=HITS.names)

    return F.pandas_udf(scan_all, HITS)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str, name: str, max_nodes: int = MAX_NODES):
    """Documents with one struct column of hits against the whole benchmark."""
    spark, done, written = docs.sparkSession, False, None
    for block in blocks(benchmark, max_nodes):
        hits = scanner(spark, block)(F.col(text))
        if done:
            path = scratch_path(spark, "hits")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            hits = merged(F.col(name), hits)
            if written:
                remove(spark, written)
            written = path
        docs, done = docs.withColumn(name, hits), True
    return docs


def merged(before: Column, found: Column) -> Column:
    """Hits of two passes in one struct; overlapping runs stay as they are."""
    lists = {c: F.concat(before[c], found[c]) for c in ("starts", "ends", "items")}
    lists["items"] = F.array_sort(F.array_distinct(lists["items"]))
    return F.struct(found["n_words"].alias("n_words"), *[v.alias(k) for k, v in lists.items()])


def hit_words(starts, ends) -> int:
    """Words inside at least one run."""
    total, reach = 0, 0
    for a, b in sorted(zip(starts, ends)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


DIGEST = struct("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


@F.pandas_udf(DIGEST)
def digest(hits: pd.DataFrame) -> pd.DataFrame:
    """Counts and the hash of the item ids of a struct of hits."""
    rows = []
    for n, starts, ends, items in hits[HITS.names].itertuples(index=False):
        hit = hit_words(starts, ends)
        rows.append((n, hit, len(items), sha256(",".join(sorted(items))), hit > 0))
    return pd.DataFrame(rows, columns=DIGEST.names)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, hits: pd.DataFrame) -> pd.Series:
    out = []
    for text, starts, ends in zip(texts, hits["starts"], hits["ends"]):
        if isinstance(text, str) and len(starts):
            kept, reach = [], 0
            for a, b in sorted(offsets(text, starts, ends)):
                kept.append(text[reach:max(a, reach)])
                reach = max(reach, b)
            text = "".join(kept) + text[reach:]
        out.append(text)
    return pd.Series(out, dtype=object)


def cut_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with benchmark passages cut out of the text, in their own columns only."""
    name = free_name(docs, "_hits")
    found = with_hits(docs, benchmark, "text", name)
    return found.withColumn("text", _without(F.col("text"), F.col(name))).drop(name)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), "text", "hits")
    return found.select("doc_id", digest(F.col("hits")).alias("d")).select("doc_id", "d.*")


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), {WORDS}) AS n,
    array_to_string(w[i : i + least(len(w), {WORDS}) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS r(i) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - s.n + 2)) AS r(i)
),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
n_hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS r(k) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
