"""Alignment of two tokenizers by brute force; SentencePiece against its library."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from liftspark.llm import alignment, pieces

BYTE_LEVEL, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "漢", "😀", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "▁"]
PARTS += ["0", "12", ".", "//", "====", "я", "при", "‍", "�", "\r\n", "QU", "<|endoftext|>", "'s", "'"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def some_texts(seed, n):
    draw = random.Random(seed)
    out = ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(n)]
    return out + ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 40))) for _ in range(n)]


def test_ids_equal_the_library(library, model):
    texts = some_texts(1, 4000) + [c * n for c in ("a", " ", "ab", "▁", "=", "\n", "é") for n in (1, 2, 3, 5, 17, 33, 70)]
    texts.append("".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABC0123", k=50_000)))  # one long word
    for text in texts:
        assert model.encode(text) == library.encode(text), text
        assert model.decode(library.encode(text)) == library.decode(library.encode(text)), text


def test_any_ids_decode_as_the_library_does(library, model):
    draw = random.Random(2)
    for _ in range(4000):
        kinds = (draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3), draw.randrange(259, 300))
        ids = [draw.choice(kinds) for _ in range(draw.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_pairs_are_compatible_if_they_are_their_own_encoding(model):
    assert model.compatible("▁the", "▁of") and not model.compatible("▁th", "e")
    assert model.merged("▁the") == ["▁the"]


def test_tables_of_words_and_pairs_stay_bounded(model, monkeypatch, library):
    monkeypatch.setattr(pieces, "MAX_WORDS", 10)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 10)
    small = pieces.Pieces(MODEL)
    for text in some_texts(5, 100):
        assert small.encode(text) == library.encode(text)
    assert len(small.known) <= 10 and len(small.pairs) <= 10


def test_texts_are_cut_between_letters_and_signs(model, library):
    text = "it ends, (so)...  !!wait\n#1, x_y é– “ü”"
    words = model._words(text)
    assert words[:6] == ["▁it", "▁ends", ",", "▁(", "so", ")..."] and "".join(words) == "▁" + text.replace(" ", "▁")
    assert model.encode(text) == library.encode(text)


@pytest.mark.parametrize("held, signs", [(["ab", "▁.", "..", "!?"], ".!?"), (["a.", "..", ".,", "!?"], "!?"), (["a."], "")])
def test_signs_that_a_piece_holds_beside_a_letter_are_not_cut(held, signs):
    assert pieces.Pieces._signs(SimpleNamespace(ids=dict.fromkeys(held)), set("".join(held))) == set(signs)


def test_pairs_are_tested_only_where_the_last_token_is_unknown(monkeypatch):
    fresh, asked = pieces.Pieces(MODEL), []
    merged = fresh.merged
    monkeypatch.setattr(fresh, "merged", lambda text: asked.append(text) or merged(text))
    assert fresh.tokens("▁the") == ["▁the"] and not asked  # each prefix is a piece
    tokens = fresh.tokens("▁thentionth")
    assert "".join(tokens) == "▁thentionth" and asked
    asked.clear()
    assert fresh.tokens("▁thentionth") == tokens and not asked


def test_sentencepiece_of_documents(spark, documents, library):
    texts = [None, "", "a b", "a b", " two  spaces ", "x" * 60_000, *some_texts(7, 40)]
    folder = documents([*enumerate(texts), (None, "no id")])
    rows = {r.doc_id: r for r in pieces.op12_sentencepiece(spark, folder).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.op12_sentencepiece(spark, documents([])).count() == 0


def test_ids_and_texts_as_columns(spark, library):
    df = spark.createDataFrame([("a b\nc",), (None,), ("",)], "text string")
    out = df.select("text", pieces.encoder(MODEL)(F.col("text")).alias("ids"))
    out = out.withColumn("back", pieces.decoder(MODEL)(F.col("ids"))).collect()
    assert [list(r.ids) for r in out] == [library.encode("a b\nc"), [], []]
    assert [r.back for r in out] == ["a b\nc", "", ""]


def plain_alignment(texts):
    """Measures of each text: groups and links by two pointers."""
    a_model = Tokenizer.from_file(BYTE_LEVEL)
    a_model.encode_special_tokens = True
    both = alignment.Tokenizers(BYTE_LEVEL, MODEL)

    def one(text):
        if not text:
            return None
        raw = (" " + text).encode()
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        a_parts, b_parts = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        groups, links, i, j = [], [], 0, 0
        a_end, b_end, first_a, first_b = len(a_parts[0]), len(b_parts[0]), 0, 0
        while True:
            links.append((a[i], b[j]))
            ends = (a_end, b_end)
            if ends[0] == ends[1]:
                groups.append(",".join(map(str, a[first_a : i + 1])) + "|" + ",".join(map(str, b[first_b : j + 1])))
                first_a, first_b = i + 1, j + 1
            if ends[0] <= ends[1]:
                i += 1
                if i == len(a):
                    return len(a), len(b), groups, links
                a_end += len(a_parts[i])
            if ends[1] <= ends[0]:
                j += 1
                b_end += len(b_parts[j])

    known = {t: one(t) for t in set(texts)}
    counts = Counter(link for t in texts if known[t] for link in known[t][3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for text in texts:
        if known[text] is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = known[text]
        n_best, total = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), n_best, total, sha))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot_pairs, share", [(65_536, 4096), (20, 3)])
def test_alignment_of_documents(spark, documents, monkeypatch, hot_pairs, share):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(alignment, "SHARE", share)
    texts = [None, "", None, "", "▁ is no space", "a <|endoftext|> in the text", "the of the", *some_texts(11, 60)]
    texts += ["copied text of the day"] * 200 + ["z" * 30_000, "the " * 20_000]
    folder = documents([*enumerate(texts), (None, "no id")])
    rows = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.op11_cross_tokenizer_alignment(spark, folder).collect()}
    want = plain_alignment([*texts, "no id"])
    assert len(rows) == len(want)
    for i, text in enumerate(texts):
        assert rows[i] == want[i], text
    assert rows[None] == want[-1] and rows[4][0] == 0


def test_alignment_of_no_documents(spark, documents):
    assert alignment.op11_cross_tokenizer_alignment(spark, documents([])).count() == 0
    folder = documents([(1, None), (2, "")])
    assert [r.n_a for r in alignment.op11_cross_tokenizer_alignment(spark, folder).collect()] == [0, 0]


def test_groups_as_texts(spark, documents):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    row = alignment.aligned_texts(docs, BYTE_LEVEL, MODEL, keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert sum(len(g.split("|")[0].split(",")) for g in row.groups.split(";")) == row.n_a
