"""Compression bands and decontamination against plain definitions."""

import hashlib
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from liftspark.llm import compression, decontaminate

VOCABULARY = [f"{a}{b}" for a in ("lor", "vex", "tam", "qui", "bre") for b in ("em", "or", "ant", "is", "une", "o")]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, marked = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(marked),
        n < 20 or 100 * len(marked) > 30 * n,
    )


def quality_texts():
    rng = random.Random(1)
    some = prose(rng, 300)
    return [
        None,
        "",
        " \t\n",
        "word",
        some,
        some,
        some + "\n" + some,
        "The " * 500,
        "\n".join(["a line of text", "", "a line of text", "other\x1cone   two three"] * 9),
        "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=4000)),
        prose(rng, 40000),
        "é ü ñ # * $ " * 3,
    ]


def test_counts_and_verdict(spark, documents):
    texts = quality_texts()
    got = compression.op6_compression_bands(spark, documents(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    rows = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text)
        assert not (r.base_failed and r.kept)
    assert rows[4].kept and rows[5].kept
    assert not rows[7].kept and not rows[9].kept  # repetitive, incompressible


@pytest.fixture(scope="module")
def phrases(spark):
    """Phrases of five words of clean sf0.1 documents by language, with no four words in two sentences."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", "text").collect()
    compressor, seen, out = zstandard.ZstdCompressor(level=compression.LEVEL), set(), {}
    for lang, text in rows:
        if not text or any(c in text for c in compression.SYMBOLS) or not compression.measure(text, compressor)[6]:
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            words = sentence.split()
            grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
            if grams and not grams & seen:
                seen |= grams
                out.setdefault(lang, []).extend(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    return out


def long_text(phrases, size):
    rng, parts, n = random.Random(4), [], 0
    while n < size:
        some = rng.sample(phrases, len(phrases))
        parts += some
        n += sum(map(len, some)) + len(some)
    return " ".join(parts)[:size]


@pytest.mark.parametrize("size", [40_000, 300_000, 1_000_000, 4_000_000])
@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_long_clean_prose_is_kept(phrases, lang, size):
    text = long_text(phrases[lang], size)
    row = dict(zip(compression.RESULT.names, compression.measure(text, zstandard.ZstdCompressor(level=compression.LEVEL))))
    assert not row["base_failed"] and row["bad_chunks"] <= compression.MAX_BAD_CHUNKS and row["kept"], row


def test_long_repetitive_and_random_texts_are_rejected():
    rng, compressor = random.Random(5), zstandard.ZstdCompressor(level=compression.LEVEL)
    logs = " ".join(f"{rng.choice(VOCABULARY)} signed in from {rng.choice(VOCABULARY)}" for _ in range(30000))
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(60000))
    for text in (logs, noise):
        assert len(text) > 10 * compression.SECTION and not compression.measure(text, compressor)[6]


def test_keep_good_leaves_columns_alone(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, prose(rng, 200), "x"), (2, "a " * 100, "y")], "doc_id long, text string, _quality string")
    kept = compression.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def plain_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = word.findall((text or "").translate(lower))
    hit, found = set(), set()
    for item, question in items:
        q = word.findall((question or "").translate(lower))
        size = min(len(q), 10)
        for i in range(len(q) - size + 1) if q else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == q[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def leak_tables():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(30)] + [(30, None), (31, ""), (32, "!!"), (33, "Tag One")]
    long_item = next(t for _, t in items if t and len(t.split()) == 30)
    words = long_item.split()
    docs = [None, "", "--", prose(rng, 200), long_item, long_item.upper().replace(" ", " -- "), " ".join(words[3:13])]
    docs += [" ".join(words[3:12]), f"{prose(rng, 5)} {' '.join(words[:15])} x {' '.join(words[5:])}", "tag one, tag-one TAGé one"]
    docs += [prose(rng, 20000) + " " + long_item]
    return items, docs + docs[4:5] * 20


def test_decontamination_by_brute_force(spark, documents):
    items, docs = leak_tables()
    folder = documents(list(enumerate(docs)), benchmark=(items, "item_id long, text string"))
    for r in decontaminate.op10_benchmark_decontamination(spark, folder).collect():
        want = plain_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, docs[r.doc_id][:80]


def test_small_blocks_find_the_same(spark, documents):
    items, docs = leak_tables()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    total = sum(len(w) for _, text in items for w in decontaminate.windows(decontaminate.words(text)))
    found = []
    for size in (decontaminate.MAX_NODES, total // 4):
        hits = decontaminate.with_hits(df, bench, "text", "h", size)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1  # one automaton a pass
        found.append(sorted(tuple(r) for r in hits.select("doc_id", decontaminate.digest("h").alias("d")).select("doc_id", "d.*").collect()))
    assert found[0] == found[1]


@pytest.mark.parametrize("limit", [40, 200, 1500, 10**6])
def test_blocks_hold_each_window_and_are_bounded(spark, limit):
    items, _ = leak_tables()
    items += [(1000, "x" * 300), (1001, " ".join(f"w{i}" for i in range(400))), (1002, None), (1003, "... !")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(str(i), w) for i, text in items for w in decontaminate.windows(decontaminate.words(text))}
    got = set()
    for block in decontaminate.blocks(bench, limit):
        held = {(i, w) for i, tokens in block for w in decontaminate.windows(tokens)}
        assert sum(len(w) for _, w in held) <= limit or len(held) == 1
        got |= held
    assert got == want


def test_cutting_passages(spark):
    words = [f"w{i}" for i in range(30)]
    text = "A B c D Before It. " + " ".join(words).upper() + " After, é it."
    df = spark.createDataFrame([(1, text, 5), (2, "clean é text", 6), (3, None, 7)], "doc_id long, text string, _hits long")
    bench = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    rows = {r.doc_id: r.text for r in decontaminate.cut_passages(df, bench).collect()}
    assert rows == {1: "A B c D Before It.  After, é it.", 2: "clean é text", 3: None}


@pytest.mark.parametrize("query", [compression.op6_compression_bands, decontaminate.op10_benchmark_decontamination])
def test_empty_tables(spark, documents, query):
    folder = documents([], benchmark=([], "item_id long, text string"))
    assert query(spark, folder).count() == 0
    folder = documents([(1, "some text")], benchmark=([], "item_id long, text string"))
    assert query(spark, folder).select(F.count("*")).first()[0] == 1


def test_passages_of_items_without_id_are_hit(spark, documents):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    folder = documents(
        [(1, f"before {passage} after"), (2, "nothing of it")],
        benchmark=([(None, passage), ("x", "seven eight nine")], "item_id string, text string"),
    )
    rows = {r.doc_id: r for r in decontaminate.op10_benchmark_decontamination(spark, folder).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (12, 1, True)
    assert not rows[2].contaminated
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = decontaminate.cut_passages(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert {r.doc_id: r.text for r in cut.collect()}[1] == "before  after"
