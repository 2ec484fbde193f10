"""Language identification with script ranges and Viterbi over word scores.

A word's script leaves the languages that were learned with it as candidates; hashed letter
trigrams score the word under each; Viterbi with a penalty for each switch labels the words
of a text, so that mixed texts split into spans. The text gets the language of most of its
letters, and their share as the score.

Learning: at most ``SAMPLE`` documents per language, those with the least hashes of their
ids; more than ``MAX_LANGS`` languages are an error. Both bound the model (``BUCKETS`` numbers
per language), which is what is broadcast. Prediction is a map over all rows: different words
of a slice of texts are scored once, and Viterbi steps through all its texts together.

Defined results: NULL texts and texts without a letter are ``und`` with score 0 (all texts
are where nothing was learned); words of a script no language was learned with follow
their neighbours; ties go to the first language by name; repeated rows get equal results;
very long texts are labelled in full. Results are one struct column.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from liftspark.llm.texts import struct, table

SAMPLE = 1500
MAX_LANGS = 256
BUCKETS = 1 << 14
SMOOTHING = 0.5
SLICE_CHARS = 12_000_000  # labelled together
SWITCH = 9.0  # nats a change of language costs
MIN_SCRIPT_SHARE = 0.002  # of a language's words
# First and last code point of the scripts' letters (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
WORD = re.compile(r"[^\W\d_]+")
# Numbers that are no decimal digits (fractions, circled and Roman ones) are word signs but no letters.
_NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
NUMBER = re.compile(f"[{_NUMBERS}]")
COUNTS = struct("lang string, bucket integer, n double")
LABELS = (
    StructType()
    .add("lang", StringType())
    .add("score", DoubleType())
    .add("starts", ArrayType(IntegerType()))
    .add("ends", ArrayType(IntegerType()))
    .add("langs", ArrayType(StringType()))
)


def words_of(text) -> tuple:
    """The text, with a digit for each number that is no letter, and its words; a missing text is empty."""
    text = text if isinstance(text, str) else ""
    words = WORD.findall(text)
    if not all(map(str.isalpha, words)):  # seldom, and the search is slow
        text = NUMBER.sub("0", text)
        words = WORD.findall(text)
    return text, words


def scripts_of(words: list) -> np.ndarray:
    """Script number of each word, by its first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    out = np.full(len(words), len(SCRIPT_NAMES) - 1)
    for name, low, high in SCRIPTS:
        out[(first >= low) & (first <= high)] = SCRIPT_NAMES.index(name)
    return out


def grams(words: list) -> tuple:
    """Trigram buckets of words between boundary marks, and where each word's begin."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"^{w.lower()}$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    mixed = (
        codes[:-2] * np.uint64(0x9E3779B97F4A7C15)
        + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        + codes[2:] * np.uint64(0x165667B19E3779F9)
    )
    buckets = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False
    counts = sizes - 2
    return buckets[inside[:-2]], np.concatenate(([0], np.cumsum(counts)[:-1]))


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts per language; script counts have negative buckets."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words = pd.Series([w for t in texts for w in words_of(t)[1]], dtype=object)
            if words.empty:
                continue
            codes, distinct = pd.factorize(words)
            times = np.bincount(codes)
            buckets, begins = grams(list(distinct))
            each = np.repeat(times, np.diff(np.append(begins, len(buckets))))
            n = np.bincount(buckets, weights=each, minlength=BUCKETS)
            s = np.bincount(scripts_of(list(distinct)), weights=times, minlength=len(SCRIPT_NAMES))
            at, in_script = np.flatnonzero(n), np.flatnonzero(s)
            yield pd.DataFrame(
                {
                    "lang": lang,
                    "bucket": np.concatenate((at, -1 - in_script)).astype(np.int32),
                    "n": np.concatenate((n[at], s[in_script])),
                }
            )


class Model:
    """Log probabilities (bucket, language) and the candidates of each script."""

    def __init__(self, langs: list, counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.logp = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if langs else smooth
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.candidates = share >= MIN_SCRIPT_SHARE

    def word_scores(self, words: list) -> np.ndarray:
        """Score of each word under each language, 0 for the best candidate."""
        buckets, begins = grams(words)
        scores = np.add.reduceat(self.logp[buckets], begins, axis=0)
        allowed = self.candidates[scripts_of(words)]
        scores = np.where(allowed, scores, scores.min(axis=1, keepdims=True) - SWITCH)
        scores -= scores.max(axis=1, keepdims=True)
        scores[~allowed.any(axis=1)] = 0.0
        return scores


def viterbi(scores: np.ndarray, codes: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts lie one after the other, all are stepped together."""
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    k = scores.shape[1]
    stays = np.zeros((len(codes), k), bool)
    source = np.zeros(len(codes), np.int16)
    value = np.zeros((len(sizes), k))
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    for t in range(longest):
        n = live[t]
        at = begins[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(n), best][:, None] - switch
            stay = now >= jump
            stays[at], source[at] = stay, best
            now = np.where(stay, now, jump)
        value[:n] = now + scores[codes[at]]
    labels = np.zeros(len(codes), np.int16)
    label = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = begins[:n] + t
        labels[at] = label[:n]
        if t:
            label[:n] = np.where(stays[at, label[:n]], label[:n], source[at])
    return labels


def slices(texts: pd.Series, chars: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """Runs of whole texts of about so many characters; a longer text is one of its own."""
    sizes = np.fromiter((len(t) if isinstance(t, str) else 0 for t in texts), np.int64, len(texts))
    piece = np.cumsum(sizes) // chars
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(piece)) + 1):
        yield texts.iloc[at]


def label_texts(texts: pd.Series, model: Model) -> pd.DataFrame:
    """Language, score and spans of each text of a batch."""
    texts, found = zip(*map(words_of, texts)) if len(texts) else ((), ())
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not model.langs or not sizes.sum():
        return pd.DataFrame([("und", 0.0, [], [], [])] * len(found), columns=LABELS.names)
    codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    distinct = list(distinct)
    labels = viterbi(model.word_scores(distinct), codes, sizes)
    letters = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes]
    rows, at = [], 0
    for text, n in zip(texts, sizes):
        mine, weights = labels[at : at + n], letters[at : at + n]
        at += n
        rows.append(_summary(text, mine, weights, model.langs) if n else ("und", 0.0, [], [], []))
    return pd.DataFrame(rows, columns=LABELS.names)


def _summary(text: str, labels: np.ndarray, weights: np.ndarray, langs: list) -> tuple:
    totals = np.bincount(labels, weights=weights, minlength=len(langs))
    best = int(totals.argmax())
    edges = np.flatnonzero(np.diff(labels)) + 1
    firsts, lasts = [0, *edges.tolist()], [*(edges - 1).tolist(), len(labels) - 1]
    if len(edges):
        spans = [m.span() for m in WORD.finditer(text)]
        starts, ends = [spans[i][0] for i in firsts], [spans[i][1] for i in lasts]
    else:
        starts, ends = [WORD.search(text).start()], [len(text)]
    return langs[best], float(totals[best] / totals.sum()), starts, ends, [langs[labels[i]] for i in firsts]


def train(docs: DataFrame, key: Column, text: Column, lang: Column, per_lang: int = SAMPLE) -> Model:
    """Model of the bounded sample of labelled rows."""
    rows = docs.select(F.xxhash64(key.cast("string")).alias("hash"), lang.alias("lang"), text.alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    # About twice the sample of each language, by a range of the hash; then the exact limit.
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")  # a model without some would mislabel
    wide = F.lit(False)
    for lang, n in sizes:
        top = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * per_lang // n)
        wide |= (F.col("lang") == lang) & (F.col("hash") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    near = rows.filter(wide).select("lang", "hash").withColumn("rank", rank).filter(F.col("rank") <= per_lang)
    limits = near.groupBy("lang").agg(F.max("hash").alias("limit")).orderBy("lang").collect()
    langs = [r.lang for r in limits]
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    if langs:
        chosen = F.lit(False)
        for r in limits:
            chosen |= (F.col("lang") == r.lang) & (F.col("hash") <= r.limit)
        sums = rows.filter(chosen).select("lang", "text").mapInPandas(count_grams, COUNTS)
        for lang, bucket, n in sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
            if bucket < 0:
                scripts[-1 - bucket, langs.index(lang)] = n
            else:
                counts[bucket, langs.index(lang)] = n
    return Model(langs, counts, scripts)


def identify(spark: SparkSession, model: Model):
    """Scalar function text -> struct (lang, score, starts, ends, langs)."""
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [label_texts(part, shared.value) for part in slices(texts)]
            yield pd.concat(parts, ignore_index=True)

    return F.pandas_udf(label, LABELS)


def held_out(key: Column) -> Column:
    """The quarter of the documents that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    known = docs.filter(~out & F.col("doc_id").isNotNull())
    model = train(known, F.col("doc_id"), F.col("text"), F.col("lang"))
    labelled = docs.select("doc_id", out.alias("held_out"), identify(spark, model)(F.col("text")).alias("l"))
    return labelled.select(
        "doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", F.size("l.starts").alias("n_language_spans")
    )
