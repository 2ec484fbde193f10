"""Exact removal of long repeats by a distributed sparse suffix array.

Which 100-byte strings also start earlier? Suffixes are compared to that depth only, and
only where it can matter:

1. ``_anchors``: the leftmost least hash of the ``GRAM``-byte strings inside a window of
   ``LENGTH`` bytes is its anchor. Equal windows have equal anchors at equal offsets, and
   neighbouring windows share theirs, so a text has about one anchor in 35 bytes. One row
   per anchor is shuffled: hash of the gram, hash of all bytes its windows span, place.
2. ``_resolve``: anchors are streamed in hash order. A gram that occurs once has no repeat.
   Anchors whose windows span equal bytes are one suffix with several places: all but the
   first place are covered. Grams with several different spans go on.
3. ``_cut`` fetches the spans of those, and ``_sort_suffixes`` sorts every window in them as
   a suffix, deep-shallow: multikey quicksort on eight-byte characters to ``SHALLOW`` bytes,
   then blind tries for the groups that still share a prefix: one suffix is a leaf, the
   others branch off its path at their first difference, and branches are ordered in turn.
   Suffixes that reach depth ``LENGTH`` together are equal; all but the first are covered.
4. Covered stretches are joined to the documents and cut out.

Skew: a task sends an anchor of equal bytes once however often it has it, so a passage in a
third of all documents reaches its group once per task; ``_resolve`` holds at most ``HOT``
rows of a gram; grams with more different spans are sorted window by window, dealt by
content. Joins by document carry no broadcast hint. Texts travel compressed.

Defined results: NULL and empty texts, and texts below ``LENGTH`` bytes, lose nothing. Ids
should be unique; where they are not, or are NULL or no numbers, rows are separate documents
in the order (id, text), NULL last, so a repeated row is a copy of the first. Very long
texts are read in slices and in full. Only id and text are read: other columns cannot clash.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, IntegralType, LongType, StructType

from liftspark.llm.mixing import numbered
from liftspark.llm.texts import struct, table, utf8
from liftspark.sources.tables import stage

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
SLICE = 1 << 20  # windows of a text taken at once
TASK_ANCHORS = 4 << 20  # anchors of a task compared before the shuffle
HOT = 2048
SHALLOW = 24
SORT_CHUNK = 1 << 18  # suffixes sorted at once, if their groups are no larger
_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
ANCHOR = struct("gram long, span long, doc long, at long")
PLACE = struct("doc long, gram long, at long")
FRAGMENT = struct("key long, doc long, at long").add("bytes", BinaryType())
COVER = struct("doc long, at long")
REST = (
    struct("doc long, n_bytes long, n_removed long")
    .add("starts", ArrayType(IntegerType()))
    .add("ends", ArrayType(IntegerType()))
    .add("kept", BinaryType())
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 14)
            cls.up = np.concatenate(([_ONE], np.cumprod(np.full(size - 1, _BASE))))
            cls.down = np.concatenate(([_ONE], np.cumprod(np.full(size - 1, _INVERSE))))
        return cls.up[:n], cls.down[:n]


def slice_anchors(data: np.ndarray) -> tuple:
    """Gram hashes, span hashes, anchor positions, first and last windows of a text slice."""
    n = len(data)
    up, down = _Powers.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=prefix[1:])
    grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    value, place = grams, np.arange(len(grams), dtype=np.int32)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        width += step
    edges = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], edges))
    last = np.concatenate((edges - 1, [len(place) - 1]))
    at = place[first].astype(np.int64)
    end = last + LENGTH
    span = (prefix[end] - prefix[first]) * down[first] + (at - first).astype(np.uint64)
    span = _mix(span + (end - first).astype(np.uint64) * _BASE)
    return grams[at].view(np.int64), span.view(np.int64), at, first, last


def text_anchors(data: bytes) -> list:
    """Anchors of a text, in slices of windows."""
    codes = np.frombuffer(data, np.uint8)
    out = []
    for start in range(0, len(codes) - LENGTH + 1, SLICE):
        gram, span, at, first, last = slice_anchors(codes[start : start + SLICE + LENGTH - 1])
        out.append((gram, span, ((at + start) << 16) | ((at - first) << 8) | (at - last)))
    return out


def _window_range(at: np.ndarray) -> tuple:
    """First and last window of packed anchors."""
    position = (at & ((1 << 62) - 1)) >> 16
    return position - ((at >> 8) & 255), position - (at & 255)


def merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """Stretches joined where they touch, by document."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    if not len(docs):
        return docs, starts, ends
    group = np.concatenate(([0], np.cumsum(docs[1:] != docs[:-1])))
    lift = group * (int(ends.max()) + 2)  # later documents lie beyond all earlier ends
    reach = np.maximum.accumulate(ends + lift)
    fresh = np.concatenate(([True], starts[1:] + lift[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    return docs[at], starts[at], np.maximum.reduceat(ends + lift, at) - lift[at]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LONGS = [pa.field(n, pa.int64()) for n in ("gram", "span", "doc", "at")]
_ANCHOR = pa.schema(_LONGS)
_PLACE = pa.schema([pa.field(n, pa.int64()) for n in PLACE.names])
_COVER = pa.schema([pa.field(n, pa.int64()) for n in COVER.names])
_FRAGMENT = pa.schema([pa.field(n, pa.int64()) for n in FRAGMENT.names[:3]] + [pa.field("bytes", pa.binary())])


def _emit(schema: pa.Schema, columns: list, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield _batch(schema, *(c[i : i + size] for c in columns))


def _once_per_task(gram, span, doc, at) -> Iterator[pa.RecordBatch]:
    """First place of each (gram, span); the others are covered and leave as stretches."""
    order = np.lexsort((at, doc, span, gram))
    gram, span, doc, at = gram[order], span[order], doc[order], at[order]
    again = np.concatenate(([False], (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])))
    yield from _emit(_ANCHOR, [gram[~again], span[~again], doc[~again], at[~again]])
    first, last = _window_range(at[again])
    docs, starts, ends = merged(doc[again], first, last + LENGTH)
    spread = _mix(docs.astype(np.uint64)).view(np.int64)
    for i in range(0, len(docs), 1 << 16):
        s = slice(i, i + (1 << 16))
        none = np.full(len(docs[s]), None, object)
        yield _batch(_ANCHOR, spread[s], none, docs[s], (starts[s] << 32) | ends[s])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text) to anchors, and stretches (span NULL) that repeat inside the task."""
    parts, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
            data = utf8(text.as_py())
            for gram, span, at in text_anchors(data) if len(data) >= LENGTH else ():
                parts.append((gram, span, np.full(len(at), doc, np.int64), at))
                held += len(at)
            if held >= TASK_ANCHORS:
                yield from _once_per_task(*map(np.concatenate, zip(*parts)))
                parts, held = [], 0
    if held:
        yield from _once_per_task(*map(np.concatenate, zip(*parts)))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in order of (gram, span, place) to covered stretches (gram NULL) and open anchors.

    Bit 62 of an open anchor's place marks grams with more than ``HOT`` different spans.
    """
    last = None  # gram and span of the row before
    held, hot = [], False  # different spans of the gram at the end of the rows so far
    for batch in batches:
        whole = np.asarray(batch.column("span").is_null())
        gram, doc, at = (batch.column(c).to_numpy() for c in ("gram", "doc", "at"))
        if whole.any():
            yield _batch(_PLACE, doc[whole], np.full(whole.sum(), None, object), at[whole])
        span = batch.column("span").fill_null(0).to_numpy()[~whole]
        gram, doc, at = gram[~whole], doc[~whole], at[~whole]
        if not len(gram):
            continue
        same = np.concatenate(([last == (gram[0], span[0])], (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])))
        if same.any():
            start, end = _window_range(at[same])
            yield _batch(_PLACE, doc[same], np.full(same.sum(), None, object), (start << 32) | (end + LENGTH))
        last = (gram[-1], span[-1])
        gram, doc, at = gram[~same], doc[~same], at[~same]
        if not len(gram):
            continue
        starts = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(gram)))
        # Grams inside the batch are complete.
        inner = np.repeat((sizes > 1) & (np.arange(len(sizes)) % len(sizes) > 0), sizes)
        inner[starts[-1] :] = False
        flag = np.repeat((sizes > HOT).astype(np.int64) << 62, sizes)
        if inner.any():
            yield _batch(_PLACE, doc[inner], gram[inner], (at | flag)[inner])
        # The first may go on from the batch before, the last into the next.
        for run in dict.fromkeys((0, len(sizes) - 1)):
            block = slice(starts[run], starts[run] + sizes[run])
            if held and held[0][1][0] != gram[starts[run]]:
                yield from _flush(held, hot)
                held, hot = [], False
            held.append((doc[block], gram[block], at[block]))
            if hot or sum(len(r[0]) for r in held) > HOT:
                yield from _flush(held, True)
                # Without its places, a row stays to tell the gram.
                held, hot = [(doc[:0], gram[block], at[:0])], True
    yield from _flush(held, hot)


def _flush(held: list, hot: bool) -> Iterator[pa.RecordBatch]:
    """Open anchors of a gram that has several spans."""
    if held and (hot or sum(len(r[0]) for r in held) > 1):
        doc, at = np.concatenate([r[0] for r in held]), np.concatenate([r[2] for r in held])
        if len(doc):
            gram = np.full(len(doc), held[0][1][0])
            yield _batch(_PLACE, doc, gram, at | (int(hot) << 62))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffles by document."""
    compressor = zstandard.ZstdCompressor(level=3)
    schema = pa.schema([pa.field("doc", pa.int64()), pa.field("data", pa.binary())])
    for batch in batches:
        packed = [compressor.compress(utf8(t.as_py())) for t in batch.column("text")]
        yield _batch(schema, batch.column("doc"), packed)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with open anchors to the bytes their windows span.

    Windows of hot grams leave one by one under a key of their content, once per batch.
    """
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        keys, docs, places, parts = [], [], [], []
        seen = {}
        for doc, packed, asked in zip(*(batch.column(c) for c in ("doc", "data", "asked"))):
            if len(keys) >= 1 << 15:
                yield _batch(_FRAGMENT, keys, docs, places, parts)
                keys, docs, places, parts = [], [], [], []
            doc, data = doc.as_py(), plain.decompress(packed.as_py())
            for ask in asked.as_py():
                at = np.int64(ask["at"])
                first, last = map(int, _window_range(at))
                if not at >> 62:
                    keys.append(ask["gram"])
                    docs.append(doc)
                    places.append((first << 16) | (last - first))
                    parts.append(data[first : last + LENGTH])
                    continue
                for start in range(first, last + 1):
                    window = data[start : start + LENGTH]
                    seen.setdefault(window, []).append((doc, start))
        for window, found in seen.items():
            found.sort()
            key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
            for n, (doc, start) in enumerate(found):
                keys.append(key)
                docs.append(doc)
                places.append(start << 16)
                parts.append(None if n else window)
        yield from _emit(_FRAGMENT, [keys, docs, places, parts], 1 << 14)


def _characters(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big character."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | buffer[at + i].astype(np.uint64)
    return out


def _regroup(group: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Order by (group, part), keeping the order of equals."""
    return np.lexsort((part, group))


def deep_shallow(buffer: np.ndarray, suffixes: np.ndarray, group: np.ndarray) -> tuple:
    """Sort suffixes inside their given groups to depth ``LENGTH``; (order, group of equals).

    The buffer must go on for eight bytes after the last suffix's end.
    """
    n = len(suffixes)
    order, label = np.argsort(group, kind="stable"), np.zeros(n, np.int64)
    label[1:] = np.cumsum(group[order][1:] != group[order][:-1])
    depth = np.zeros(n, np.int64)
    # Multikey quicksort: every open group parts around the character of its middle member.
    while True:
        size = np.bincount(label, minlength=n)[label]
        todo = np.flatnonzero((size > 1) & (depth < SHALLOW))
        if not len(todo):
            break
        mine, at = label[todo], suffixes[order[todo]]
        character = _characters(buffer, at + depth[todo])
        starts = np.concatenate(([0], np.flatnonzero(mine[1:] != mine[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(todo)))
        pivot = np.repeat(character[starts + sizes // 2], sizes)
        side = 1 + (character > pivot).astype(np.int8) - (character < pivot)
        sub = _regroup(mine, side)
        depth[todo] = np.where(side[sub] == 1, depth[todo][sub] + 8, depth[todo][sub])
        order[todo] = order[todo][sub]
        label = _split(label, todo, side[sub])
    # Blind tries: in every open group the first member is a leaf; the others branch off.
    leaf = np.zeros(n, bool)
    while True:
        size = np.bincount(label, minlength=n)[label]
        todo = np.flatnonzero((size > 1) & ~leaf)
        if not len(todo):
            return order, label
        mine, at = label[todo], suffixes[order[todo]]
        starts = np.concatenate(([0], np.flatnonzero(mine[1:] != mine[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(todo)))
        path = np.repeat(at[starts], sizes)
        common = _common(buffer, at, path)
        equal = common >= LENGTH
        byte = np.where(equal, 0, buffer[at + np.minimum(common, LENGTH - 1)]).astype(np.int64)
        other = np.where(equal, 0, buffer[path + np.minimum(common, LENGTH - 1)]).astype(np.int64)
        # Smaller branches come first, the earlier they branch off; larger ones last.
        after = byte > other
        rank = np.where(equal, LENGTH, np.where(after, 2 * LENGTH - common, common)) * 256 + byte
        sub = _regroup(mine, rank)
        order[todo] = order[todo][sub]
        leaf[todo] = equal[sub]
        label = _split(label, todo, rank[sub])


def _split(label: np.ndarray, todo: np.ndarray, part: np.ndarray) -> np.ndarray:
    """New group numbers after the rows ``todo`` parted."""
    fine = np.zeros(len(label), np.int64)
    fine[todo] = part
    fresh = (label[1:] != label[:-1]) | (fine[1:] != fine[:-1])
    return np.concatenate(([0], np.cumsum(fresh)))


def _common(buffer: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes two suffixes share, to ``LENGTH`` at most."""
    out = np.full(len(a), LENGTH, np.int64)
    left = np.flatnonzero(a != b)
    for depth in range(0, LENGTH, 8):
        if not len(left):
            break
        x = _characters(buffer, a[left] + depth) ^ _characters(buffer, b[left] + depth)
        differs = x != 0
        lead = np.zeros(len(left), np.int64)
        for i in range(1, 8):
            lead += (x >> np.uint64(64 - 8 * i)) == 0
        out[left[differs]] = np.minimum(depth + lead[differs], LENGTH)
        left = left[~differs]
    return out


def _sorted_covers(fragments: list) -> Iterator[pa.RecordBatch]:
    """Windows of (key, doc, place, bytes) that equal an earlier one, as stretches."""
    keys, docs, places, parts = zip(*fragments)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    buffer = np.frombuffer(b"".join(parts) + bytes(LENGTH + 8), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(parts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    suffixes = begin[owner] + step
    start = (np.array(places, np.int64) >> 16)[owner] + step
    doc = np.array(docs, np.int64)[owner]
    group = np.unique(np.array(keys, np.int64), return_inverse=True)[1][owner]
    order, label = deep_shallow(buffer, suffixes, group)
    doc, start = doc[order], start[order]
    by_place = np.lexsort((start, doc, label))
    again = np.concatenate(([False], label[by_place][1:] == label[by_place][:-1]))
    covered = by_place[again]
    docs, starts, ends = merged(doc[covered], start[covered], start[covered] + LENGTH)
    yield from _emit(_COVER, [docs, (starts << 32) | ends])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of their key; whole keys are sorted together."""
    held, n = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in FRAGMENT.names)):
            if row[3] is None:  # a copy of an earlier window of its batch
                start = row[2] >> 16
                yield _batch(_COVER, [row[1]], [(start << 32) | (start + LENGTH)])
                continue
            if n >= SORT_CHUNK and row[0] != held[-1][0]:
                yield from _sorted_covers(held)
                held, n = [], 0
            held.append(row)
            n += len(row[3]) - LENGTH + 1
    if held:
        yield from _sorted_covers(held)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their covered stretches to what is left of them."""
    plain = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    schema = pa.schema([pa.field(n, k) for n, k in zip(REST.names, kinds)])
    for batch in batches:
        rows = []
        for doc, packed, covered in zip(*(batch.column(c) for c in ("doc", "data", "covered"))):
            data = plain.decompress(packed.as_py())
            at = np.array(covered.as_py() or [], np.int64)
            _, starts, ends = merged(np.zeros(len(at), np.int64), at >> 32, at & 0xFFFFFFFF)
            kept, reach = [], 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.append(data[reach:a])
                reach = b
            kept.append(data[reach:])
            rows.append((doc.as_py(), len(data), int((ends - starts).sum()), starts, ends, b"".join(kept)))
        if rows:
            yield _batch(schema, *zip(*rows))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple:
    """(doc, id, text) with a number that orders the documents, and whether it is the id."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        if rows.groupBy("id").count().filter("id IS NULL OR count > 1").isEmpty():
            return rows.withColumn("doc", F.col("id").cast("long")), True
    ranked = numbered(rows, F.col("id").isNull(), F.col("id"), F.col("text"))
    return stage(ranked.withColumnRenamed("rank", "doc"), "numbered"), False


def covered(docs: DataFrame) -> tuple:
    """Packed documents (doc, data), and stretches (doc, at) of their repeated bytes."""
    shape = StructType().add("doc", LongType()).add("data", BinaryType())
    packed = docs.select("doc", "text").mapInArrow(_pack, shape)
    anchors = docs.select("doc", "text").mapInArrow(_anchors, ANCHOR)
    ordered = anchors.repartition("gram").sortWithinPartitions("gram", "span", "doc", "at")
    places = stage(ordered.mapInArrow(_resolve, PLACE), "places")
    asked = places.filter("gram IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("gram", "at")).alias("asked"))
    fragments = packed.join(asked, "doc").select("doc", "data", "asked").mapInArrow(_cut, FRAGMENT)
    fragments = fragments.repartition("key").sortWithinPartitions("key")
    found = fragments.mapInArrow(_sort_suffixes, COVER)
    return packed, places.filter("gram IS NULL").select("doc", "at").union(found)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, ends, kept) of every document; offsets in bytes."""
    keyed, is_id = _keyed(docs, doc_id, text)
    packed, covers = covered(keyed)
    stretches = covers.groupBy("doc").agg(F.collect_list("at").alias("covered"))
    rest = packed.join(stretches, "doc", "left").select("doc", "data", "covered").mapInArrow(_remove, REST)
    if is_id:
        return rest.withColumnRenamed("doc", "doc_id")
    return rest.join(keyed.select("doc", F.col("id").alias("doc_id")), "doc").drop("doc")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated bytes every document loses."""
    rest = remove_repeats(table(spark, sf_dir, "documents"))
    return rest.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
