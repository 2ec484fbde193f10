"""Quality rules by compression bands.

Repetitive text compresses too well and noise compresses too badly. Each document is
compressed with zstandard as a whole and in fixed chunks; the ratio of plain to compressed
bytes must lie inside a band that depends on the length, because a compressor gains with
every byte it has already seen. The operator is one scalar function of the text: no
shuffle, and a task holds one Arrow batch.

Defined results: a NULL or empty text has no words, ratio 0 and fails the base rule; texts
shorter than ``MIN_BYTES`` are judged by the base rule alone; equal texts get equal
results; other columns, whatever their names, are untouched, since everything is returned
in one struct column.
"""

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftspark.llm.texts import SEPARATORS, free_name, struct, table, utf8

LEVEL = 3
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
# Bytes of a text, and the least and greatest ratio there; between two lines the limits are
# interpolated over the logarithm of the length.
BANDS = (
    (200, 0.90, 2.00),
    (400, 1.15, 1.86),
    (800, 1.35, 1.97),
    (1600, 1.50, 2.13),
    (3200, 1.65, 2.25),
    (6400, 1.80, 2.38),
    (12800, 1.90, 2.48),
    (51200, 2.00, 2.62),
)
MIN_BYTES = BANDS[0][0]
SECTION = BANDS[-1][0]
CHUNK = 2048
CHUNK_BAND = (1.50, 2.30)
MAX_BAD_CHUNKS = 0.34

RESULT = struct(
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, worst_low double, worst_high double,"
    " bad_chunks double"
)


def repeated_words(words: list) -> int:
    """Words inside ``WINDOW``-word windows that occur at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    keys = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(keys)]
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    return len(lines) - len(set(lines))


def band(n_bytes: int) -> tuple:
    """Least and greatest ratio allowed at a length."""
    at = np.log([b[0] for b in BANDS])
    x = np.log(max(n_bytes, 1))
    return float(np.interp(x, at, [b[1] for b in BANDS])), float(np.interp(x, at, [b[2] for b in BANDS]))


def ratios(data: bytes, compressor) -> tuple:
    """Whole ratio, and the ratios of the full chunks."""
    whole = len(data) / len(compressor.compress(data)) if data else 0.0
    chunks = [
        CHUNK / len(compressor.compress(data[i : i + CHUNK]))
        for i in range(0, len(data) - CHUNK + 1, CHUNK)
    ]
    return whole, chunks


def section_ratio(data: bytes, whole: float, compressor) -> float:
    """Ratio of a text compressed section by section; the whole ratio of one section."""
    if len(data) <= SECTION:
        return whole
    sections = (data[i : i + SECTION] for i in range(0, len(data), SECTION))
    return len(data) / sum(len(compressor.compress(s)) for s in sections)


def accepted(n_bytes: int, whole: float, sections: float, chunks: list) -> tuple:
    """Whether the ratios lie in their bands, and the share of chunks that don't."""
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks) / max(1, len(chunks))
    if n_bytes < MIN_BYTES:
        return True, bad
    low, high = band(n_bytes)
    return low <= whole and sections <= high and bad <= MAX_BAD_CHUNKS, bad


def measure(text, compressor) -> tuple:
    text = text if isinstance(text, str) else ""
    data = utf8(text)
    words = data.split()
    n = len(words)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    whole, chunks = ratios(data, compressor)
    fits, bad = accepted(len(data), whole, section_ratio(data, whole, compressor), chunks)
    return (
        n,
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated,
        failed,
        fits and not failed,
        whole,
        min(chunks, default=whole),
        max(chunks, default=whole),
        bad,
    )


@F.pandas_udf(RESULT)
def _quality(texts: pd.Series) -> pd.DataFrame:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    return pd.DataFrame([measure(t, compressor) for t in texts], columns=RESULT.names)


def quality(text: Column) -> Column:
    """Counts, ratios and verdict of a text, as one struct."""
    return _quality(text)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with their own columns only."""
    mark = free_name(docs, "_quality")
    return docs.withColumn(mark, quality(F.col("text"))).filter(F.col(mark)["kept"]).drop(mark)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")
