"""Prefix trie of rebuilt conversations against tries built in memory."""

import hashlib
import random
import zlib

import pytest

from liftspark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, TURN_ID string, s1 string, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """All nodes, from rebuilt lists of turns."""
    originals = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            originals.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in originals.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if rebuilt[c] == path))
        out.append(
            (
                min(cs),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(cs),
                sum(len(p) == len(path) + 1 for p in below),
                len(leaves),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def drawn(seed, n_convs=60):
    """Conversations with few different turns, so that many prefixes are shared."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-20, 80), n_convs):
        for t in range(draw.choice((1, 2, 3, 9, 12))):
            turn = draw.choice((t, t, t, None, 3))
            role = draw.choice(("user", "assistant", None, ""))
            rows.append((c, turn, role, draw.choice(("a", "b", "é", "", None)), "x", "y", "z"))
    rows += rows[:5]  # equal rows
    rows += [(None, 1, "user", "no conversation", "x", "y", "z")] * 3
    draw.shuffle(rows)
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = tries.trie(df, **options)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture()
def many_partitions(spark):
    """Ranges that cut conversations, as large inputs have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_a_trie_in_memory(spark, many_partitions, monkeypatch, seed):
    monkeypatch.setattr(tries, "BLOCK", 3)  # sums go over several blocks
    monkeypatch.setattr(tries, "SHARE", 4)  # some keys are hot, some not
    rows = drawn(seed)
    assert got(spark, rows) == plain_trie(rows)


def test_one_conversation_with_most_turns(spark, many_partitions):
    rows = [(10, t, "user", f"t{t % 7}", "", "", "") for t in range(1500)]
    rows += [(c, t, "user", f"t{t % 7}", "", "", "") for c in range(11, 18) for t in range(4)]
    want = plain_trie_long(rows)
    found = got(spark, rows)
    assert len(found) == len(want) and found == want


def plain_trie_long(rows):
    """As ``plain_trie`` where all conversations go on along one line: subtree sums from the end."""
    turns = {}
    for c, t, role, text, *_ in rows:
        turns.setdefault(c, []).append((t, role, text))
    turns = {c: [x[1:] for x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {c: turns.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + ts[zlib.crc32(str(c).encode()) % 9 :] for c, ts in turns.items()}
    nodes = {(): {"members": sorted(rebuilt), "children": [], "parent": None, "last": ""}}
    keys = {c: () for c in rebuilt}
    longest = max(map(len, rebuilt.values()))
    interned = {}
    for d in range(longest):
        groups = {}
        for c, path in rebuilt.items():
            if len(path) > d:
                groups.setdefault((keys[c], path[d]), []).append(c)
        for (parent, turn), cs in groups.items():
            key = interned.setdefault((parent, turn), len(interned) + 1)
            nodes[key] = {"members": sorted(cs), "children": [], "parent": parent, "last": turn[1], "depth": d + 1}
            nodes[parent]["children"].append(key)
            for c in cs:
                keys[c] = key
    for key in sorted((k for k in nodes if k != ()), reverse=True) + [()]:
        n = nodes[key]
        n["leaves"] = sum(nodes[k]["leaves"] for k in n["children"]) or 1
        own = (len(n["members"]) - 1) * len(n["last"].encode()) if key != () else 0
        n["saved"] = own + sum(nodes[k]["saved"] for k in n["children"])
    out = []
    for key, n in nodes.items():
        d = n.get("depth", 0)
        ends = ",".join(str(c) for c in n["members"] if len(rebuilt[c]) == d)
        parent = None if key == () else nodes[n["parent"]]["members"][0]
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((n["members"][0], d, parent, len(n["members"]), len(n["children"]), n["leaves"], n["saved"], sha))
    return sorted(out, key=repr)


def test_colliding_fingerprints_are_found_and_mended(spark, monkeypatch):
    right = tries.bases
    # With base one a fingerprint forgets the order of turns.
    monkeypatch.setattr(tries, "bases", lambda seed: [1] * 4 if seed == 42 else right(seed))
    rows = [(c, t, "user", x, "", "", "") for c, path in ((100, "abc"), (105, "bac"), (110, "cab")) for t, x in enumerate(path * 4)]
    with pytest.raises(RuntimeError, match="collided"):
        tries.trie(spark.createDataFrame(rows, SCHEMA), tries=1)
    assert got(spark, rows) == plain_trie(rows)


def test_no_rows_and_turnless_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x", "", "", "")]) == []
    # Conversation 7 takes its first turns from a base that is not there.
    h = zlib.crc32(b"7") % 9
    assert h > 1
    assert got(spark, [(7, 1, "user", "x", "", "", "")]) == plain_trie([(7, 1, "user", "x")])
