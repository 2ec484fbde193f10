"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

For every prefix of a text there is exactly one last token of its encoding. An automaton over
the pieces names the pieces that end at a character; of these only one is *compatible* with
the last token of the prefix before it: the pair is its own encoding. So the table of last
tokens is filled from left to right, and the ids are recovered backwards from its end.

No piece of a usual vocabulary has a space behind another character, a line end beside one, or
a sign beside a letter; where that holds, texts are cut there, and each distinct part (a word
or a run of signs with the spaces before it) is encoded once per worker as long as a table of
bounded size remembers it. A pair of pieces is tested once as long as it is remembered, and
only where the last token of the prefix is not known yet.

NULL and empty texts have no ids and decode to the empty text. A character outside the
vocabulary becomes the pieces of its UTF-8 bytes. Repeated rows are encoded each for itself;
other columns are not read. Memory is bounded by the batch and the table of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from liftspark.llm.texts import struct, table

SPACE = "▁"  # the pieces' sign for a space
MAX_WORDS = 200_000  # encoded words in each of the two tables of a worker
MAX_PAIRS = 1_000_000  # tested pairs of pieces, and pieces with such pairs, a worker remembers
LONG_WORD = 64  # longer words are encoded each time


class Followers(dict):
    """Pieces tested behind a piece, and whether they may follow it; others are tested when asked for."""

    __slots__ = ("left", "model")

    def __init__(self, model: Pieces, left: str):
        super().__init__()
        self.model, self.left = model, left

    def __missing__(self, right: str) -> bool:
        found = self[right] = self.model.tested(self.left, right)
        return found


class Pieces:
    """Vocabulary of a merge-type model, its automaton, encoder and decoder."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        if model.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that keep their text and put a space before it are supported")
        text = {i: model.id_to_piece(i) for i in ids}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {text[i]: i for i in plain}
        self.scores = {text[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(text[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("only vocabularies with a piece for each byte are supported")
        self.is_byte = [model.is_byte(i) for i in ids]
        self.bytes = [text[i].replace(SPACE, " ").encode() for i in ids]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        for i in ids:
            if model.is_control(i) or model.is_unknown(i):
                self.bytes[i] = model.decode([i]).encode()
        self.silent = [model.is_control(i) for i in ids]
        self.controls = {i for i in ids if self.silent[i]}
        self.digits = [str(i) for i in ids]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # others never end a prefix
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.words = self._cuts()
        self.pairs: dict[str, Followers] = {}
        self.n_pairs = 0
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _cuts(self) -> re.Pattern:
        """Pattern of the parts of a text that no piece of the vocabulary reaches across."""
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            return re.compile(".+", re.DOTALL)
        within = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in within)
        lone = f"|[{alone}]" if alone else ""
        signs = "".join(map(re.escape, sorted(self._signs(within))))
        runs = f"{SPACE}*[{signs}]+|" if signs else ""
        return re.compile(f"{SPACE}*[^{SPACE}{alone}{signs}]+|{runs}{SPACE}+{lone}")

    def _signs(self, within: set) -> set:
        """Characters that are no letters and, in all pieces, stand beside others of this set only."""
        beside = {pair for piece in self.ids for pair in zip(piece.lstrip(SPACE), piece.lstrip(SPACE)[1:])}
        signs = {c for c in within if not c.isalpha()} - {SPACE}
        while mixed := {c for pair in beside if len(signs.intersection(pair)) < len(set(pair)) for c in pair} & signs:
            signs -= mixed
        return signs

    def merged(self, text: str) -> list:
        """Pieces left when the best-scored neighbours are merged, leftmost first, until none can be."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            possible = [s for s in joined if s is not None]
            if not possible:
                break
            at = joined.index(max(possible))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _remember_one(self) -> None:
        """Makes room for one more entry of the pairs; full tables are dropped."""
        if self.n_pairs >= MAX_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1

    def tested(self, left: str, right: str) -> bool:
        """Whether the text of two pieces is encoded as this very pair."""
        self._remember_one()
        return self.merged(left + right) == [left, right]

    def followers(self, left: str) -> Followers:
        found = self.pairs.get(left)
        if found is None:
            self._remember_one()
            found = self.pairs[left] = Followers(self, left)
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``."""
        return self.followers(left)[right]

    def tokens(self, text: str) -> list:
        """Tokens of a text: last token of every prefix, then backwards from the end."""
        last = [None] * (len(text) + 1)
        after = last.copy()  # what may follow the last token of each prefix
        pairs, followers = self.pairs, self.followers
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None:  # only one of the pieces that end here is compatible
                allowed = after[end - size]
                # A prefix without a token is empty or ends in a character that is in no piece.
                if allowed is None or allowed[piece]:
                    last[end] = piece
                    after[end] = pairs.get(piece) or followers(piece)
        out, at = [], len(text)
        while at:
            token = last[at] or text[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def _word_ids(self, word: str) -> tuple:
        tokens = self.tokens(word)
        ids = tuple(map(self.ids.get, tokens))
        if None not in ids:
            return ids
        out = []
        for token, i in zip(tokens, ids):
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass"))
        return tuple(out)

    def word(self, word: str) -> tuple:
        """(ids, their decimals comma-joined, the bytes they stand for) of a word.

        A full table becomes the older one; words that are met again move on to the new one, so
        only those not met for a whole table are forgotten.
        """
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            ids = self._word_ids(word)
            found = (ids, ",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids)))
        if len(word) <= LONG_WORD:
            if len(self.known) >= MAX_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str | None) -> list:
        """Ids of a text, with the space the model puts before it."""
        return [i for w in self._words(text) for i in self.word(w)[0]] if text else []

    def encode_decode(self, text: str | None) -> tuple[int, str, str]:
        """Number of the ids of a text, their comma-joined decimals, and the text they decode to."""
        if not text:
            return 0, "", ""
        word = self.word
        ids, digits, raw = zip(*[self.known.get(w) or word(w) for w in self._words(text)])
        decoded = self._decoded(b"".join(raw), ids[0][0])
        if decoded is None:
            decoded = self.decode(list(chain.from_iterable(ids)))
        return sum(map(len, ids)), ",".join(digits), decoded

    def _decoded(self, raw: bytes, first: int | None) -> str | None:
        """Text of the bytes of ids without controls; None where they are not UTF-8."""
        if first is not None and not self.is_byte[first] and self.bytes[first].startswith(b" ") and self._plain(first):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return None

    def decode(self, ids) -> str:
        """Text of any ids; the space put before the text is taken off."""
        first = next((i for i in ids if not self.silent[i]), None)
        if not self.controls.isdisjoint(ids):
            return self._repaired(ids, first)
        decoded = self._decoded(b"".join(map(self.bytes.__getitem__, ids)), first)
        return self._repaired(ids, first) if decoded is None else decoded

    def _plain(self, i: int) -> bool:
        return self.bytes[i].replace(b" ", SPACE.encode()).decode() in self.ids

    def _repaired(self, ids, first) -> str:
        """Text of ids piece by piece: a byte that is not UTF-8 with the bytes beside it is a replacement sign."""
        out, run = [], bytearray()
        strip = first is not None and not self.is_byte[first] and self._plain(first)
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes[i]
                continue
            at = 0
            while at < len(run):
                for size in range(1, 5):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                at += size
            run.clear()
            if i is not None:
                piece = self.bytes[i].decode()
                if strip and not self.silent[i]:
                    piece, strip = piece.removeprefix(" "), False
                out.append(piece)
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The vocabulary of a file that every worker can read; loaded once per worker."""
    return Pieces(path)


def encoder(path: str):
    """Scalar function text -> array of ids."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path)
        for texts in batches:
            yield pd.Series([model.encode(t) for t in texts], dtype=object)

    return encode


def decoder(path: str):
    """Scalar function array of ids -> text; NULL ids decode to the empty text."""

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(path)
        for lists in batches:
            yield pd.Series(["" if ids is None else model.decode(list(ids)) for ids in lists], dtype=object)

    return decode


DIGEST = struct("n_tokens long, ids_sha256 string, decoded_sha256 string")


def digester(path: str):
    """Scalar function text -> number and hash of its ids, hash of what they decode to."""

    @F.pandas_udf(DIGEST)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for texts in batches:
            rows = []
            for text in texts:
                n, listed, decoded = model.encode_decode(text)
                hashes = (hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (listed, decoded))
                rows.append((n, *hashes))
            yield pd.DataFrame(rows, columns=DIGEST.names)

    return digest


def op12_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    digest = digester(path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")
