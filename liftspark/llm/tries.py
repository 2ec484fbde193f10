"""Prefix trie of rebuilt conversations, from fingerprints of their turns.

A conversation ``c`` is rebuilt from the head of another one, its base, and its own later turns.
No rebuilt text is made. The fingerprint of turns x1..xn is the product of the monoid
(sum of x_j * B^j, B^n) modulo four primes: every stored turn carries the sum up to it in its own
conversation, and the fingerprint of a rebuilt prefix is the base's sum at the end of the head
plus the own turns' part, shifted by a power of B. Prefixes with equal fingerprints form a node.

That they are equal turn by turn is verified: turns of equal role and text refer to one stored
turn (found by comparing role and text themselves), and a node is sound if its members agree on
the turn referred to by their last turn and on their parent. If any node is not, another seed is
taken. So results don't hang on the fingerprints.

Conversations may be long: turns are sorted by ranges of (conversation, turn), the sums of a
range are carried over to the next, and joins on a conversation go through ``lookup``.

Turns without number come first; turns of equal number are in order of role and text; equal rows
are turns of their own. NULL role or text is empty. Rows without conv_id belong to no
conversation and are left out. Other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from liftspark.llm.lookups import SHARE, lookup
from liftspark.llm.texts import struct, table
from liftspark.sources.tables import stage

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # the four largest below 2^31
FAMILY = 5  # conversations with the same conv_id - conv_id % FAMILY share a base
HEADS = 9  # heads have fewer turns than this
BLOCK = 1024  # depths summed up by one window
CHUNK = 1000  # conv_ids joined to one text before it is hashed
KEY = ["depth", "f1", "f2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

TURNS = struct("conv_id long, part integer, local long, ref long, h1 long, h2 long, n_bytes long")
for _k in range(8):
    TURNS = TURNS.add(f"s{_k + 1}" if _k < 4 else f"t{_k - 3}", IntegerType())
TURNS = TURNS.add("role", StringType()).add("text", StringType())
CARRY = struct("conv_id long, part integer, offset long")
for _k in range(8):
    CARRY = CARRY.add(f"c{_k + 1}" if _k < 4 else f"b{_k - 3}", LongType())
CHUNKS = struct("depth long, f1 long, f2 long, first long, ids string")
ENDS = struct("depth long, f1 long, f2 long, ends_sha256 string")


def bases(seed: int) -> list[int]:
    """A base for each prime."""
    draw = random.Random(seed)
    return [draw.randrange(1 << 20, p - 1) for p in PRIMES]


class _Powers:
    """B^0, B^1, ... modulo p, as far as asked for."""

    def __init__(self, base: int, p: int):
        self.base, self.p, self.values = base, p, np.ones(1, np.int64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) <= n:
            step = pow(self.base, len(self.values), self.p)
            self.values = np.concatenate((self.values, self.values * step % self.p))
        return self.values


def summing(seed: int):
    """Function for ``mapInArrow`` over sorted turns: place and sums inside the partition's part of a conversation."""

    moduli = list(zip(bases(seed), PRIMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        powers = [_Powers(b, p) for b, p in moduli]
        conv, count, sums, row = None, 0, [0] * 4, 0  # where the last batch ended
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            h2 = batch.column("h2").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
            sizes = np.diff(np.append(starts, n))
            goes_on = conv is not None and ids[0] == conv
            local = np.arange(n) - np.repeat(starts, sizes) + 1
            if goes_on:
                local[: sizes[0]] += count
            elements = [(h1 >> 33) & 0x7FFFFFFF, h1 & 0x7FFFFFFF, (h2 >> 33) & 0x7FFFFFFF, h2 & 0x7FFFFFFF]
            columns_s, columns_t = [], []
            for k, ((_, p), x) in enumerate(zip(moduli, elements)):
                term = (1 + x % (p - 1)) * powers[k].upto(int(local.max()))[local] % p
                running = np.cumsum(term)  # below 2^31 times the rows of a batch
                before = np.repeat(running[starts] - term[starts], sizes)
                inside = running - before
                if goes_on:
                    inside[: sizes[0]] += sums[k]
                inside %= p
                columns_s.append(inside)
                columns_t.append(term)
                sums[k] = int(inside[-1])
            conv, count = ids[-1], int(local[-1])
            refs = (np.int64(part) << 40) + row + np.arange(n)
            row += n
            arrays = [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(local), pa.array(refs)]
            arrays += [batch.column(c) for c in ("h1", "h2", "n_bytes")]
            arrays += [pa.array(c.astype(np.int32)) for c in columns_s + columns_t]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("role"), batch.column("text")], names=TURNS.names)

    return run


def carrying(seed: int):
    """Function for ``applyInPandas``: what precedes each part of a conversation that lies in several partitions."""

    moduli = list(zip(bases(seed), PRIMES))

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts, rows, offset, sums = parts.sort_values("part"), [], 0, [0] * 4
        for conv_id, part, n, *own in parts[["conv_id", "part", "n", "s1", "s2", "s3", "s4"]].itertuples(index=False):
            shift = [pow(b, int(offset), p) for b, p in moduli]
            rows.append((conv_id, part, offset, *sums, *shift))
            sums = [(s + b * int(x)) % p for s, b, x, (_, p) in zip(sums, shift, own, moduli)]
            offset += int(n)
        return pd.DataFrame(rows, columns=CARRY.names)

    return run


def _mod(value: Column, p: int) -> Column:
    return F.pmod(value, F.lit(p).cast("long"))


def summed_turns(turns: DataFrame, seed: int) -> DataFrame:
    """Turns (conv_id, pos, ref, h1, h2, n_bytes, s1.., t1.., role, text): ``s`` sums up to the turn, ``t`` its own part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text")
    )
    rows = rows.select(
        "*",
        F.xxhash64(F.lit(seed), "role", "text").alias("h1"),
        F.xxhash64(F.lit(~seed), "text", "role").alias("h2"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    turn = F.col("turn").asc_nulls_first()
    # Only the beginning of a text bounds a range; within it the whole text decides.
    dealt = rows.repartitionByRange("conv_id", turn, "role", F.substring("text", 1, 64))
    rows = dealt.sortWithinPartitions("conv_id", turn, "role", "text")
    rows = stage(rows.drop("turn").mapInArrow(summing(seed), TURNS), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.max(F.struct("local", "s1", "s2", "s3", "s4")).alias("m"))
    several = parts.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    parts = parts.join(several, "conv_id").select("conv_id", "part", F.col("m.local").alias("n"), "m.s1", "m.s2", "m.s3", "m.s4")
    # At most two conversations of a partition go on in another one.
    carry = F.broadcast(parts.groupBy("conv_id").applyInPandas(carrying(seed), CARRY))
    out = rows.join(carry, ["conv_id", "part"], "left")
    columns = []
    for k, p in enumerate(PRIMES, 1):
        shift, before = F.coalesce(f"b{k}", F.lit(1)), F.coalesce(f"c{k}", F.lit(0))
        columns.append(_mod(before + _mod(shift * F.col(f"s{k}"), p), p).alias(f"s{k}"))
        columns.append(_mod(shift * F.col(f"t{k}"), p).alias(f"t{k}"))
    pos = (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos")
    return out.select("conv_id", pos, "ref", "h1", "h2", "n_bytes", *columns, "role", "text")


def with_references(turns: DataFrame) -> tuple[DataFrame, bool]:
    """Turns with ``same_as``, the first stored turn of equal role and text, and whether the hashes tell turns apart."""
    contents = turns.groupBy("role", "text").agg(
        F.min("ref").alias("same_as"), F.count("*").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2")
    )
    contents = stage(contents.select("h1", "h2", "same_as", "n"), "contents")
    apart = contents.groupBy("h1", "h2").count().filter("count > 1").isEmpty()
    total = contents.agg(F.sum("n")).first()[0] or 0
    rows = turns.drop("role", "text")
    return lookup(rows, contents, ["h1", "h2"], F.col("n") * SHARE >= total, F.col("ref")).drop("n"), apart


def _packed(columns: list[Column]) -> list[Column]:
    """Four residues in two longs."""
    one, two, three, four = columns
    return [one * (1 << 31) + two, three * (1 << 31) + four]


def _keys(sums: list[Column], terms: list[Column]) -> list[Column]:
    """Fingerprint of a prefix and of its parent."""
    parent = [_mod(s - t, p) for s, t, p in zip(sums, terms, PRIMES)]
    return [c.alias(n) for c, n in zip(_packed(sums) + _packed(parent), ("f1", "f2", "p1", "p2"))]


def members(turns: DataFrame, seed: int) -> DataFrame:
    """One row per conversation and depth of its rebuilt turns, depth 0 included."""
    heads = F.when(F.col("pos") < HEADS, F.struct("pos", *(f"s{k}" for k in range(1, 5)), *(f"t{k}" for k in range(1, 5)), "same_as", "n_bytes"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(heads)).alias("heads"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = convs.select("conv_id", "n", "heads", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = stage(convs, "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    convs = convs.join(base, "base", "left").withColumn(
        "head", F.coalesce(F.slice("base_heads", 1, F.col("h").cast("int")), F.expr("slice(heads, 1, 0)"))
    )
    taken = F.size("head").cast("long")
    convs = convs.select(
        "conv_id",
        "n",
        "h",
        "head",
        taken.alias("k"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.get("head", (taken - 1).cast("int")).alias("at"),
        F.get("heads", (F.col("h") - 1).cast("int")).alias("own"),
    )
    # Sum of a rebuilt prefix: the head's, plus what follows own turn h, shifted to follow turn k.
    shifts = [[pow(pow(b, -1, p), d, p) for d in range(HEADS)] for b, p in zip(bases(seed), PRIMES)]
    facts = []
    for i, p in enumerate(PRIMES, 1):
        shift = F.get(F.array(*[F.lit(x).cast("long") for x in shifts[i - 1]]), (F.col("h") - F.col("k")).cast("int"))
        own, at = F.coalesce(f"own.s{i}", F.lit(0)), F.coalesce(f"at.s{i}", F.lit(0))
        facts += [shift.alias(f"m{i}"), _mod(at - _mod(own * shift, p), p).alias(f"a{i}")]
    convs = stage(convs.select("conv_id", "n", "h", "k", "length", "head", *facts), "rebuilt")

    e = convs.select("conv_id", "length", F.explode("head").alias("e"))
    sums, terms = ([F.col(f"e.{x}{i}") for i in range(1, 5)] for x in "st")
    first = e.select(
        "conv_id", F.col("e.pos").alias("depth"), *_keys(sums, terms), "e.same_as", "e.n_bytes", (F.col("e.pos") == F.col("length")).alias("ends")
    )
    total = convs.agg(F.sum("n")).first()[0] or 0
    known = convs.drop("head", "length").withColumnRenamed("n", "n_turns")
    own = lookup(turns, known, ["conv_id"], F.col("n_turns") * SHARE >= total, F.col("ref")).filter("pos > h")
    sums = [_mod(F.col(f"a{i}") + _mod(F.col(f"s{i}") * F.col(f"m{i}"), p), p) for i, p in enumerate(PRIMES, 1)]
    terms = [_mod(F.col(f"t{i}") * F.col(f"m{i}"), p) for i, p in enumerate(PRIMES, 1)]
    depth = (F.col("k") + F.col("pos") - F.col("h")).alias("depth")
    then = own.select("conv_id", depth, *_keys(sums, terms), "same_as", "n_bytes", (F.col("pos") == F.col("n_turns")).alias("ends"))
    zero = F.lit(0).cast("long")
    root = convs.select(
        "conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("f1", "f2", "p1", "p2")],
        F.lit(-1).cast("long").alias("same_as"), zero.alias("n_bytes"), (F.col("length") == 0).alias("ends"),
    )
    return stage(first.unionByName(then).unionByName(root), "members")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes, and whether the members of each agree on its parent and on its last turn."""
    each = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("n_bytes").alias("n_bytes"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "same_as")],
        *[F.max(c).alias(f"{c}_max") for c in ("p1", "p2", "same_as")],
    )
    each = stage(each, "nodes")
    wrong = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"{c}_max") for c in ("p1", "p2", "same_as")])
    return each.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_bytes"), each.filter(wrong).isEmpty()


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, f1, f2, n_leaves, saved_tokens) summed over each node's subtree.

    A node belongs to its smallest member; a conversation's own nodes are the end of its path.
    So the nodes below one are the own nodes of its members, from its depth on.
    """
    weights = nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    path = rows.select("conv_id", *KEY).join(weights, ["conv_id", "depth"], "left")
    path = path.withColumn("block", F.expr(f"depth div {BLOCK}"))
    deeper = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    for c in ("leaf", "saved"):
        path = path.withColumn(c, F.sum(F.coalesce(c, F.lit(0))).over(deeper))
    # The blocks of long conversations get the sums of the blocks below them.
    long = path.filter(F.col("block") > 0).select("conv_id").distinct()
    blocks = path.join(long, "conv_id", "left_semi").groupBy("conv_id", "block")
    blocks = blocks.agg(F.max("leaf").alias("leaf"), F.max("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.sum(c).over(below).alias(f"{c}_below") for c in ("leaf", "saved")])
    path = path.join(blocks, ["conv_id", "block"], "left")
    return path.groupBy(*KEY).agg(
        *[
            F.sum(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(name)
            for c, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))
        ]
    )


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (depth, f1, f2, conv_id) to runs of conv_ids of one node."""
    for batch in batches:
        rows = []
        for key, ids in batch.groupby(KEY, sort=False)["conv_id"]:
            listed = ids.tolist()
            for at in range(0, len(listed), CHUNK):
                run = listed[at : at + CHUNK]
                rows.append((*key, run[0], ",".join(map(str, run))))
        yield pd.DataFrame(rows, columns=CHUNKS.names)


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted runs of conv_ids to one hash per node; a node may go on in the next batch."""
    key, state = None, None
    for batch in batches:
        rows = []
        for *now, ids in batch[[*KEY, "ids"]].itertuples(index=False):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(rows, columns=ENDS.names)
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=ENDS.names)


def ends_of(rows: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes where conversations end.

    A hash is sequential, so a node's conv_ids pass through one task; they come there as runs
    of up to ``CHUNK``, made where they were sorted, and are never held together.
    """
    ended = rows.filter("ends").select(*KEY, "conv_id")
    order = ["f1", "f2", "depth", "conv_id"]
    runs = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_chunks, CHUNKS)
    dealt = runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInPandas(_hash_chunks, ENDS)


def trie(conversations: DataFrame, seed: int = 42, tries: int = 8) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    for attempt in range(tries):
        turns, apart = with_references(summed_turns(conversations, seed + attempt))
        if not apart:
            continue
        rows = members(turns, seed + attempt)
        nodes, sound = nodes_of(rows)
        if sound:
            return _measured(rows, nodes)
    raise RuntimeError(f"fingerprints collided under {tries} seeds")


def _measured(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    children = below.agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes, "nodes")
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    parents = nodes.select(*[F.col(c).alias(f"of_{c}") for c in ("f1", "f2", "depth")], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of_children"))
    out = nodes.withColumns({"of_f1": F.col("p1"), "of_f2": F.col("p2"), "of_depth": F.col("depth") - 1})
    hot = F.col("of_children") * SHARE >= F.greatest(F.lit(total), F.lit(1))
    out = lookup(out, parents, ["of_f1", "of_f2", "of_depth"], hot, F.col("f2"))
    out = out.join(subtree_sums(rows, nodes), KEY, "left").join(ends_of(rows), KEY, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


# CRC-32 bit by bit; the path of a node is the list of its turns.
ORACLE_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), originals AS (
  SELECT conv_id, list(t ORDER BY pos) AS ts, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id
), bits AS (
  SELECT conv_id, digits, 1 AS k, 4294967295::BIGINT AS crc FROM originals
  UNION ALL
  SELECT conv_id, digits, k + 1, list_reduce(
      [xor(crc, ascii(substr(digits, k, 1))::BIGINT)] || [0::BIGINT for i in range(8)],
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)
  FROM bits WHERE k <= length(digits)
), heads AS (
  SELECT conv_id, xor(crc, 4294967295) % 9 AS h FROM bits WHERE k > length(digits)
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.ts[1:h], []) || c.ts[h + 1:] AS ts
  FROM originals c JOIN heads USING (conv_id) LEFT JOIN originals b ON b.conv_id = c.conv_id - c.conv_id % 5
), paths AS (
  SELECT conv_id, d AS depth, ts[1:d] AS path, d = len(ts) AS ends
  FROM rebuilt, unnest(range(0, len(ts) + 1)) AS u(d)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth > 0 THEN strlen(path[depth].text) ELSE 0 END AS n_bytes,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children,
  count(*) FILTER (u.n_children = 0) AS n_leaves,
  CAST(sum((u.n_convs - 1) * u.n_bytes) AS BIGINT) AS saved_tokens, v.ends_sha256
FROM counted v JOIN (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) u
  ON v.depth = u.above AND v.path = u.path[1:u.above]
GROUP BY v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends_sha256
"""
