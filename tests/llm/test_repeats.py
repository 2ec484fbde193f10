"""Suffix-array removal and SimHash groups against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from liftspark.llm import simhash, suffixes
from liftspark.llm.components import SALTS, components, with_least


def plain_removal(docs):
    """Documents in order as (id, text) to what the contract says."""
    seen, out = set(), []
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def noise(rng, n, letters="abcdefgh é"):
    return "".join(rng.choices(letters, k=n))


def repeat_texts():
    rng = random.Random(4)
    passage, other = noise(rng, 260), noise(rng, 100)
    while len(other.encode()) != 100:
        other = noise(rng, 100, "abcdef")
    texts = [None, "", "short", noise(rng, 99), noise(rng, 2000), noise(rng, 2000) + passage + noise(rng, 50)]
    texts += [noise(rng, rng.randint(0, 90)) + passage + noise(rng, rng.randint(0, 90)) for _ in range(12)]
    texts += [texts[4]] * 5 + [other, other, other[1:], "x" + other, other + other]
    texts += ["a" * 3000, "ab" * 700, "a" * 350, "abc" * 500 + passage]
    near = list(texts[4])
    for i in range(30, len(near), 170):
        near[i] = "Z"
    texts += ["".join(near), "".join(near[40:]), passage * 4]
    return texts


def removal_rows(spark, folder):
    got = suffixes.op1_suffix_array_dedup(spark, folder).collect()
    return sorted(tuple(r) for r in got)


def test_removal_by_brute_force(spark, documents):
    texts = repeat_texts()
    ids = random.Random(5).sample(range(1000), len(texts))
    docs = sorted(zip(ids, texts))
    assert removal_rows(spark, documents(docs)) == plain_removal(docs)


def test_removal_of_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert removal_rows(spark, folder) == plain_removal(docs)


def test_repeated_and_missing_ids(spark, documents):
    rng = random.Random(6)
    a, b, c = (noise(rng, 300) for _ in range(3))
    docs = [(7, a), (7, a), (7, b), (None, c), (None, c), (8, c)]
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in suffixes.op1_suffix_array_dedup(spark, documents(docs)).collect()]
    assert sorted(got, key=key) == sorted(plain_removal(ordered), key=key)


def test_no_documents(spark, documents):
    assert removal_rows(spark, documents([])) == []
    assert simhash.op4_simhash_near_dedup(spark, documents([])).count() == 0


def run_in_process(texts, batch=7):
    """The steps of the removal without Spark, to try other limits."""

    def batches(rows, schema, size=batch):
        columns = [list(c) for c in zip(*rows)]
        for i in range(0, len(rows), size):
            part = [pa.array(c[i : i + size], f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(part, schema=schema)

    def rows_of(found):
        return [tuple(r.values()) for b in found for r in b.to_pylist()]

    source = pa.schema([("doc", pa.int64()), ("text", pa.string())])
    anchors = rows_of(suffixes._anchors(batches(list(enumerate(texts)), source)))
    anchors.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
    places = rows_of(suffixes._resolve(batches(anchors, suffixes._ANCHOR)))
    asked = {}
    for doc, gram, at in places:
        if gram is not None:
            asked.setdefault(doc, []).append({"gram": gram, "at": at})
    packed = {r[0]: r[1] for r in rows_of(suffixes._pack(batches(list(enumerate(texts)), source)))}
    kind = pa.schema([("doc", pa.int64()), ("data", pa.binary()), ("asked", pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())])))])
    cut = rows_of(suffixes._cut(batches([(d, packed[d], a) for d, a in asked.items()], kind))) if asked else []
    cut.sort(key=lambda r: r[0])
    covers = [(d, at) for d, g, at in places if g is None]
    covers += rows_of(suffixes._sort_suffixes(batches(cut, suffixes._FRAGMENT))) if cut else []
    found = {}
    for doc, at in covers:
        found.setdefault(doc, []).append(at)
    kind = pa.schema([("doc", pa.int64()), ("data", pa.binary()), ("covered", pa.list_(pa.int64()))])
    rest = rows_of(suffixes._remove(batches([(d, packed[d], found.get(d)) for d in packed], kind)))
    return sorted((d, n, gone, len(s), hashlib.sha256(k).hexdigest()) for d, n, gone, s, _, k in rest)


@pytest.mark.parametrize("hot", [1, 3, 2048])
@pytest.mark.parametrize("limit", ["SLICE", "TASK_ANCHORS", "SORT_CHUNK", None])
def test_limits_change_nothing(monkeypatch, hot, limit):
    monkeypatch.setattr(suffixes, "HOT", hot)
    if limit:
        monkeypatch.setattr(suffixes, limit, 150)
    texts = repeat_texts()
    assert run_in_process(texts) == plain_removal(list(enumerate(texts)))


def test_deep_shallow_sorts():
    rng = random.Random(7)
    data = (noise(rng, 400, "ab") + noise(rng, 300, "ab") * 3 + "a" * 300).encode()
    buffer = np.frombuffer(data + bytes(200), np.uint8)
    suffix = np.arange(len(data))
    order, label = suffixes.deep_shallow(buffer, suffix, np.zeros(len(data), np.int64))
    windows = [bytes(buffer[i : i + 100]) for i in order]
    assert windows == sorted(windows)
    same = [a == b for a, b in zip(windows, windows[1:])]
    assert same == (label[1:] == label[:-1]).tolist()


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    votes = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) * 2 > len(parts) for b in range(64)]
    return sum(1 << b for b, v in enumerate(votes) if v)


def plain_groups(prints):
    """Least position reachable over links of three bits."""
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3)
    return root


def test_simhash_by_brute_force(spark, documents):
    rng = random.Random(8)
    base = [noise(rng, 1500, "abcdefghijklm   ") for _ in range(6)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE TWO", *base, *base[:3] * 4]
    for text in base[:4]:
        for _ in range(6):
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    ids = rng.sample(range(500), len(texts))
    rows = sorted(zip(ids, texts), key=lambda r: r[0])
    prints = [plain_print(t) for _, t in rows]
    roots = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash_near_dedup(spark, documents(rows)).collect()}
    assert got == {i: (f"{p:016x}", rows[root][0]) for (i, _), p, root in zip(rows, prints, roots)}
    assert len({c for _, c in got.values()}) < len(set(prints))  # some link differs in bits


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_link_is_found_with_and_without_long_lists(spark):
    rng = random.Random(9)
    prints = {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1}
    for _ in range(20):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    want = plain_groups(prints)
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for limit in (simhash.PAIR_LIMIT, 1, 3):
        edges = simhash.links(nodes, limit)
        pairs = [(r.u & ((1 << 64) - 1), r.v & ((1 << 64) - 1)) for r in edges.collect()]
        assert all((u ^ v).bit_count() <= 3 for u, v in pairs)
        root = {r.node & ((1 << 64) - 1): r.root for r in components(edges).collect()}
        groups = pd.Series([root.get(p, f"alone {p}") for p in prints])
        assert groups.groupby(want).nunique().max() == 1 and groups.nunique() == len(set(want))


def test_position_sets_hold_every_five_once():
    import itertools

    for five in itertools.combinations(range(8), 5):
        assert sum(set(s) <= set(five) for s in simhash.POSITION_SETS) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def test_least_of_a_hot_key_is_joined_by_parts(spark):
    rows = [(1, i, i % 97 + 3) for i in range(3000)] + [(2, 7, None), (3, 8, 5), (3, 9, 4), (3, 9, 4)]
    df = spark.createDataFrame(rows, "k long, s long, v long")
    got = sorted((r.k, r.s, r.v or 0, r.m) for r in with_least(df, "k", "v", "s").collect())
    assert got == sorted((k, s, v or 0, {1: 3, 2: None, 3: 4}[k]) for k, s, v in rows)
    plan = with_least(df, "k", "v", "s")._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and f", {SALTS})" in plan


def test_keep_one_row_of_each_group(spark):
    long_text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long_text, "a"), (1, long_text, "a"), (2, long_text, "b"), (3, "other text of its own", "c"), (4, None, "d"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_keep_one_decides_by_row_where_ids_are_null_or_repeated(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue", "grey", "pink", "gold")]
    rows = [(None, texts[0], "a"), (None, texts[0], "a"), (None, texts[1], "b"), (None, texts[2], "c"), (3, texts[2], "d")]
    rows += [(1, texts[3], "e"), (2, texts[3], "f"), (2, texts[4], "g"), (4, texts[5], "h"), (4, texts[5], "i"), (None, None, "j"), (None, "", "k")]
    for n in (1, 5):
        df = spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string, _row string").repartition(n)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        got = {tuple(r) for r in kept.collect()}
        either = got & {rows[8], rows[9]}, got & {rows[10], rows[11]}
        assert kept.count() == len(got) == 7 and list(map(len, either)) == [1, 1]
        assert got - either[0] - either[1] == {rows[0], rows[2], rows[4], rows[5], rows[7]}
        first = either if n == 1 else first
        assert either == first
