"""Mixing, url filters, archives and the pipeline."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import pytest
import __spark_entry__ as entry
from liftspark.llm import bundles, mixing, urlfilter
from liftspark.llm.texts import n_words
from pyspark.sql import functions as F
from tests.oracle_check import ordered

import duckdb

PAGES = "page_id long, url string, html string"


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL over a folder of fixtures."""
    con = duckdb.connect()
    for t in ("documents", "pages"):
        if spark._jvm.java.io.File(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    return ordered(df.columns, [tuple(r) for r in df.collect()]), ordered([d[0] for d in cur.description], cur.fetchall())


def mix_rows(seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "z", "é", "", None, "hot", "c"]
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 400]), "en", rng.choice(sources + ["hot"] * 4)) for i in range(400)]
    return rows + [(1000, None, "en", "only null"), (1001, "", "en", "empty"), (1002, "w " * 9000, "en", "a")]


def test_mix_equals_sql(spark, documents):
    got, want = against_sql(spark, documents(mix_rows()), "op2_mix_to_weights")
    assert got == want


def test_mix_comes_near_its_targets(spark, documents):
    folder = documents(mix_rows(2))
    rows = mixing.op2_mix_to_weights(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op2_mix_to_weights(spark, folder).collect()))
    by_target, biggest = {}, {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        by_target.setdefault((r.source_size, r.target), []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in by_target) - 1.5 * total) < 1e-6 * total
    for (size, target), mine in by_target.items():
        assert target <= 2 * size
        missing = target - sum(r.taken for r in mine)
        assert 0 <= missing <= max([r.size for r in mine])


def test_mix_of_repeated_rows_and_no_rows(spark, documents):
    rows = [(1, "a b c", "en", "s")] * 5 + [(None, "a b", "en", None)] * 2
    taken = mixing.op2_mix_to_weights(spark, documents(rows)).collect()
    # The copies of a row are taken one by one.
    assert len(taken) == 7 and all(r.taken in (0, r.size, 2 * r.size) for r in taken)
    assert mixing.op2_mix_to_weights(spark, documents([])).count() == 0


def test_take_leaves_columns_alone(spark):
    rows = [(i, "w " * (i + 1), "s", 7, 8) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _plan int")
    out = mixing.take(df)
    assert out.columns == [*df.columns, "copies_"]
    assert all(r.copies == 7 and r.copies_ in (1, 2) for r in out.collect())


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc ", "a\x1cb \xa0 c", "x\n\ny"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", n_words(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


URLS = [
    None,
    "",
    "no scheme",
    "http://Example.NET/en/x?q#f",
    "https://a.example.net/EN/x",
    "https://example.com/de/",
    "https://badexample.com/de/",
    "http://x.org/fr/1",
    "http://org/fr/1",
    "http://x.org#a://b.net/",
    "http://spam-farm.x.org/it/",
    "://spam-farm.example.org?x",
    "http://cheap-pills.net",
    "ftp://u@h.NET:80/p?x=/y",
    "http://É.net/é",
    "http://a\nb.net/c\nd?e",
]


def test_urls_equal_sql(spark, tables):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[10:11] * 50)]
    got, want = against_sql(spark, tables(pages=(rows, PAGES)), "op5_url_filter")
    assert got == want
    assert urlfilter.op5_url_filter(spark, tables(pages=([], PAGES))).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    keys = [f"host{i}.example" for i in range(3000)]
    inside = {k for i, k in enumerate(keys) if i % 3 == 0}
    df = spark.createDataFrame([(k, k in inside) for k in keys], "key string, listed boolean")
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)  # many false positives, many levels
    cascade = urlfilter.build_cascade(df)
    assert len(cascade.levels) > 2
    assert [k for k, found in zip(keys, cascade.listed(keys)) if found] == [k for k in keys if k in inside]
    monkeypatch.setattr(urlfilter, "SHARD_KEYS", 300)
    parts = urlfilter.cascades(df)
    assert len(parts) > 1
    got = df.withColumn("found", urlfilter.listed(spark, F.col("key"), parts)).filter("found != listed")
    assert got.count() == 0


def test_no_listed_hosts(spark, tables):
    rows = urlfilter.op5_url_filter(spark, tables(pages=([(1, "http://a.example.org/x", "")], PAGES))).collect()
    assert [(r.rule, r.verdict) for r in rows] == [(None, "allow")]


HTML = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 300000, "<p>a</p>"] + [f"<b>{i}</b>" * 50 for i in range(200)]


def page_rows():
    ids = random.Random(3).sample(range(10000), len(HTML))
    return [(i, f"http://x/{i}\n" if i % 2 else None, h) for i, h in zip(ids, HTML)]


def test_archive_round_trip(spark, tables):
    pages = page_rows()
    rows = {r.page_id: r for r in bundles.op9_warc_bundles(spark, tables(pages=(pages, PAGES))).collect()}
    assert len(rows) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        first = min(j for j, _, h in pages if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want = (len(data), digest, "response" if i == first else "revisit", None if i == first else first)
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_records_by_id_and_frames(spark, folder):
    pages = page_rows()
    bundles.write(spark.createDataFrame(pages, PAGES), f"{folder}/archive")
    html = {i: (h or "").encode() for i, _, h in pages}
    wanted = [i for i, _, h in pages if h and h.startswith("<b>")][:5]
    got = bundles.fetch(spark, f"{folder}/archive", wanted).collect()
    assert {r.page_id: bytes(r.payload) for r in got} == {i: html[i] for i in wanted}
    for r in spark.read.parquet(f"{folder}/archive").collect():
        sizes = bundles.frame_sizes(bytes(r.data))
        plain = b"".join(bundles.frame(bytes(r.data), n) for n in range(len(sizes)))
        assert sum(d for _, d in sizes) == len(plain) and plain.startswith(b"WARC/1.1\r\n")
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(bytes(r.data), read_across_frames=True)
        assert stream.read(len(plain) + 1) == plain  # a plain reader skips the seek table


def test_archive_of_repeated_rows_null_ids_and_nothing(spark, tables):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, "y"), (None, None, "y")]
    got = bundles.op9_warc_bundles(spark, tables(pages=(rows, PAGES))).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("1", "response", None)] * 2 + [("None", "response", None)] * 2 + [("None", "revisit", 1)]
    assert bundles.op9_warc_bundles(spark, tables(pages=([], PAGES))).count() == 0


def test_pipeline(spark, documents):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))

    question = prose(30)
    texts = {i: prose(150) for i in range(40)}
    texts[40] = texts[3]  # copy
    texts[41] = "spam " * 300  # junk
    texts[42] = f"{prose(80)} {question} {prose(80)}"
    texts[43] = prose(90) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(60)
    texts[44], texts[45] = None, ""
    folder = documents([(i, t, "en", f"s{i % 3}") for i, t in texts.items()], benchmark=([(1, question)], "item_id long, text string"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(range(40)) | {42, 43}
    assert question not in rows[42].text and rows[42].text.startswith(texts[42][:300])
    assert "[SECRET]" in rows[43].text and "04dbebab" not in rows[43].text
    assert all(rows[i].text == texts[i] for i in range(40)) and rows[43].n_chars == len(rows[43].text)
    mixed = corpus_pipeline.run(spark, folder)
    assert mixed.count() > 0 and {r.copies for r in mixed.collect()} <= {1, 2}
    assert corpus_pipeline.run(spark, documents([], benchmark=([], "item_id long, text string"))).count() == 0


def taken_of(spark, folder):
    rows = mixing.op2_mix_to_weights(spark, folder).collect()
    return sum(r.taken for r in rows), rows[0].target, max(r.size for r in rows), rows


@pytest.mark.parametrize("kind", ["no ids", "one id", "one text", "one text without id"])
def test_rows_that_share_an_id_or_text_are_mixed_like_others(spark, documents, kind):
    """Each comes within the largest document of the target, and a rerun agrees."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(5, 40))) for _ in range(300)]
    if kind.startswith("one text"):
        texts = ["some words of one text"] * 300
    ids = {"no ids": [None] * 300, "one id": [7] * 300, "one text": list(range(300)), "one text without id": [None] * 300}[kind]
    folder = documents([(i, t, "en", "s") for i, t in zip(ids, texts)])
    total, target, largest, rows = taken_of(spark, folder)
    assert target - largest < total <= target
    assert all(r.taken in (r.size, 2 * r.size) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, taken_of(spark, folder)[3]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = mixing.take(docs.repartition(3)).withColumn("words", F.size(F.split("text", " ")))
    assert mixed.agg(F.sum(F.col("words") * F.col("copies"))).first()[0] == total
