"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full text and counted; each distinct text is encoded by both
tokenizers and aligned once. The alignment works on the byte offsets where tokens end: offsets
where both end cut the tokens into groups, and each stretch between neighbouring ends of either
lies in one token of both, a *link*. How often two ids are linked in the corpus is the sum over
the distinct texts, weighted by their copies. The measures of a text then go to all its rows.

NULL texts, empty texts, and texts that the tokens of either tokenizer do not spell byte by byte
have no tokens: zeros, and an empty string for the groups. Repeated rows and rows without id
stay rows of their own. Other columns are not read. An empty table gives no rows.

Equal texts are found by comparing whole texts; the measures of a text reach its rows under its
SHA-256. The links of a text stay one row: their counts come from a broadcast table for the
at most ``HOT_PAIRS`` id pairs that hold that part of all links each, and by a join for the
rest, of which none can be hot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from liftspark.llm.lookups import SHARE, lookup
from liftspark.llm.texts import sha256, table
from liftspark.sources.tables import stage
from tokenizers import Tokenizer

HOT_PAIRS = 262_144  # pairs with at least this part of all links are broadcast
SLICE_CHARS = 1_000_000  # texts aligned at a time; a longer one is a slice of its own
ID_BITS = 20  # ids below a million; a slice has fewer texts than characters

ALIGNED = StructType().add("text_no", LongType()).add("text_key", BinaryType()).add("copies", LongType())
for _name in ("n_a", "n_b", "n_groups", "n_links"):
    ALIGNED = ALIGNED.add(_name, LongType())
ALIGNED = ALIGNED.add("groups", StringType()).add("groups_sha256", StringType())
ALIGNED = ALIGNED.add("pairs", ArrayType(LongType())).add("times", ArrayType(IntegerType()))
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_characters() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 signs stand for
    themselves, the other bytes in order for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# How byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_encoder(path: str, a_bytes: list):
    """Function text -> ids of a byte-level vocabulary file, special tokens read as ordinary text.

    Where the file has nothing but a vocabulary in the order of its merges, the ranks alone give
    the same ids, and the rank encoder is three times as fast; else the file's own library runs.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    plain = plain and not split["add_prefix_space"] and not model.get("ignore_merges") and not model.get("dropout")
    plain = plain and [model["vocab"]["".join(m)] for m in pairs] == list(range(256, 256 + len(pairs)))
    if plain and len(model["vocab"]) == 256 + len(pairs):
        ranks = {a_bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


class Tokenizers:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        values = byte_characters()
        vocabulary = Tokenizer.from_file(byte_level).get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in values for c in token)
            self.a_bytes[i] = bytes(values[c] for c in token) if known else token.encode()
        if max(len(self.a_bytes), self.b.vocab_size()) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.a = byte_level_encoder(byte_level, self.a_bytes)
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        # Ids as text, by what follows them: in a group, at its end, at the end of a text.
        self.written = np.array(
            [f"{i}," for i in range(n_a)]
            + [f"{i}|" for i in range(n_a)]
            + [f"{i}," for i in range(n_b)]
            + [f"{i};" for i in range(n_b)]
            + [f"{i}\n" for i in range(n_b)],
            dtype=object,
        )
        self.starts = dict(zip(("a", "a_end", "b", "b_end", "b_last"), np.cumsum([0, n_a, n_a, n_b, n_b]).tolist()))

    def encode(self, texts: list) -> tuple[list, list]:
        """Ids of each text by both; empty lists where one does not spell the text."""
        spaced = [" " + t for t in texts]
        a = [self.a(t) for t in spaced]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(spaced):
            raw = text.encode()
            spelled = b"".join(map(self.a_bytes.__getitem__, a[i])) == raw
            if not spelled or b"".join(map(self.b_bytes.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b

    def align(self, texts: list) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups as text, linked id pairs and their counts."""
        a_lists, b_lists = self.encode(texts)
        rows = [(0, 0, 0, 0, "", [], [])] * len(texts)
        with_tokens = [i for i, ids in enumerate(a_lists) if ids]
        if not with_tokens:
            return rows
        a = np.concatenate([np.array(a_lists[i], np.int64) for i in with_tokens])
        b = np.concatenate([np.array(b_lists[i], np.int64) for i in with_tokens])
        # All texts of the slice lie one behind the other, so every text's end is an end of both.
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        n_a = np.array([len(a_lists[i]) for i in with_tokens])
        n_b = np.array([len(b_lists[i]) for i in with_tokens])
        text_ends = a_ends[np.cumsum(n_a) - 1]
        in_a, in_b = np.zeros(a_ends[-1] + 1, bool), np.zeros(a_ends[-1] + 1, bool)
        in_a[a_ends], in_b[b_ends] = True, True
        cuts, links = np.flatnonzero(in_a & in_b), np.flatnonzero(in_a | in_b)
        n_groups = np.bincount(np.searchsorted(text_ends, cuts), minlength=len(with_tokens))
        text_of = np.searchsorted(text_ends, links)
        n_links = np.bincount(text_of, minlength=len(with_tokens))
        # A link's tokens are the first ones of both that end at or after it.
        pair = (a[np.searchsorted(a_ends, links)] << ID_BITS) | b[np.searchsorted(b_ends, links)]
        coded = np.sort((text_of << 2 * ID_BITS) | pair)
        new = np.flatnonzero(np.concatenate(([True], np.diff(coded) != 0)))
        times = np.diff(np.append(new, len(coded))).astype(np.int32)
        bounds = np.searchsorted(coded[new] >> 2 * ID_BITS, np.arange(len(with_tokens) + 1))
        pairs = coded[new] & ((1 << 2 * ID_BITS) - 1)
        written = self._groups(a, b, a_ends, b_ends, cuts, text_ends).split("\n")
        for k, i in enumerate(with_tokens):
            at = slice(bounds[k], bounds[k + 1])
            rows[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), written[k], pairs[at], times[at])
        return rows

    def _groups(self, a, b, a_ends, b_ends, cuts, text_ends) -> str:
        """Groups of all texts of a slice, one text a line."""
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        a_upto, b_upto = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        code = np.empty(len(a) + len(b), np.int64)
        a_at = np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group]
        code[a_at] = a + np.where(a_ends == cuts[a_group], self.starts["a_end"], self.starts["a"])
        b_code = b + np.where(b_ends == cuts[b_group], self.starts["b_end"], self.starts["b"])
        last = np.searchsorted(b_ends, text_ends)
        b_code[last] = b[last] + self.starts["b_last"]
        code[np.arange(len(b)) + a_upto[b_group]] = b_code
        return "".join(self.written[code].tolist())


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """Both tokenizers, loaded once per worker."""
    return Tokenizers(byte_level, pieces)


def aligner(byte_level: str, pieces: str, keep_groups: bool = False):
    """Function for ``mapInArrow``: rows (text_key, copies, text) to rows of ``ALIGNED``.

    The groups themselves, longer than the text, are kept only if asked for; else their hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_level, pieces)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = np.array([len(t) for t in batch.column("text").to_pylist()], np.int64)
            slice_of = np.cumsum(sizes) // SLICE_CHARS
            edges = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(sizes)]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                columns = list(zip(*both.align(part.column("text").to_pylist())))
                if not columns:
                    continue
                arrays = [pa.array(range(number, number + part.num_rows), pa.int64())]
                arrays += [part.column("text_key"), part.column("copies")]
                number += part.num_rows
                arrays += [pa.array(c, pa.int64()) for c in columns[:4]]
                groups = columns[4]
                arrays.append(pa.array(groups if keep_groups else [None] * len(groups), pa.string()))
                arrays.append(pa.array([sha256(g) if g else "" for g in groups], pa.string()))
                arrays.append(pa.array(columns[5], pa.list_(pa.int64())))
                arrays.append(pa.array(columns[6], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=ALIGNED.names)

    return run


def text_key(text):
    """SHA-256 of a text; NULL for the empty text, which has no measures."""
    return F.when(text != "", F.unhex(F.sha2(text.cast("binary"), 256)))


def distinct_texts(docs: DataFrame, text="text") -> DataFrame:
    """(text_key, copies, text) of each distinct text that is not empty."""
    texts = docs.select(F.col(text).alias("text")).filter("text != ''")
    counted = texts.groupBy("text").agg(F.count("*").alias("copies"))
    return counted.select(text_key(F.col("text")).alias("text_key"), "copies", "text")


def aligned_texts(docs: DataFrame, byte_level: str, pieces: str, text="text", keep_groups=False) -> DataFrame:
    """Alignment of each distinct text with a number of its own, written to the shared folder."""
    run = aligner(byte_level, pieces, keep_groups)
    return stage(distinct_texts(docs, text).mapInArrow(run, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) of each linked id pair; the low bits of a pair are the second id."""
    each = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum(F.col("l.times") * F.col("copies")).alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1))  # at most one row per first id
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def link_measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(text_no, n_best, count_sum) of each text with links."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("count") * HOT_PAIRS >= total))
    links = aligned.select("text_no", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("text_no", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    rest = counts.filter(F.col("count") * HOT_PAIRS < total)

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("text_no").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("count") * F.col("times")).alias("count_sum"),
        )

    often, seldom = summed(links.join(hot, "pair")), summed(links.join(hot, "pair", "left_anti").join(rest, "pair"))
    both = often.unionByName(seldom).groupBy("text_no")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, byte_level: str, pieces: str, doc_id="doc_id", text="text") -> DataFrame:
    """Measures of every row: numbers of tokens, groups and links, groups, n_best and count_sum."""
    aligned = aligned_texts(docs, byte_level, pieces, text)
    counts = stage(pair_counts(aligned), "pairs")
    measures = aligned.drop("groups", "pairs", "times").join(link_measures(aligned, counts), "text_no", "left").drop("text_no")
    measures = stage(measures, "measures")
    total = measures.agg(F.sum("copies")).first()[0] or 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"))
    found = lookup(rows, measures, ["text_key"], F.col("copies") * SHARE >= total, F.col("doc_id"))
    numbers = [*MEASURES, "n_best", "count_sum"]
    return found.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def op11_cross_tokenizer_alignment(
    spark: SparkSession, sf_dir: str, byte_level: str | None = None, pieces: str | None = None
) -> DataFrame:
    """Alignment measures of every document."""
    return align_documents(
        table(spark, sf_dir, "documents"),
        byte_level or public_tokenizers.path("byte_bpe_50k.json"),
        pieces or public_tokenizers.path("piece_bpe_32k.model"),
    )
