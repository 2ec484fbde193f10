"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding a few whole WARC records,
and a skippable frame with the seek table: compressed and plain size of every frame. An
index maps a record to its bundle, frame and offset inside the plain frame, so one record
costs one frame to read. Bundles are cells of a Parquet table of at most ``BUNDLE_BYTES``
of records (one record beyond that is a bundle of its own), so any store Spark can write to
will do, and commits and retries are Spark's.

Equal payloads: the record with the smallest id is the response, the others are revisits
without payload. Payload digests are grouped with a map-side minimum and joined back by
digest; a payload shared by a third of the pages is a skewed sort-merge join, which AQE
splits. Packing is a map over partitions that holds one open bundle.

Defined results: NULL payload is empty; NULL ids rank last, and rows with the smallest id
of their payload are all responses (so repeated rows are, and rows of NULL ids where no
other id has the payload); an empty table gives an empty archive. Only the named columns
are read, so others cannot clash.
"""

import base64
import hashlib
import struct as packing
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from liftspark.llm.texts import struct, table
from liftspark.session import scratch_path

FRAME_BYTES = 64 << 10
BUNDLE_BYTES = 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format
LEVEL = 3
END = b"\r\n\r\n"

BUNDLE = (
    StructType()
    .add("data", BinaryType())
    .add("ids", ArrayType(LongType()))
    .add("frames", ArrayType(IntegerType()))
    .add("offsets", ArrayType(IntegerType()))
)
RECORD = struct(
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
).add("payload", BinaryType())


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(pairs) -> bytes:
    """Named fields; line breaks in values would end a field and become spaces."""
    return b"".join(
        name.encode() + b": " + str(value).replace("\r", " ").replace("\n", " ").encode("utf-8", "surrogatepass") + b"\r\n"
        for name, value in pairs
        if value is not None
    )


def record(page_id, url, payload: bytes, first) -> bytes:
    """One WARC record; a revisit where the payload's response has another id."""
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\n" + _header((("Content-Type", "text/html"), ("Content-Length", len(payload)))) + b"\r\n"
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _header(
        (
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", None if page_id is None else f"<urn:page:{page_id}>"),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", f"<urn:page:{first}>" if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        )
    )
    return head + b"\r\n" + block + END


def _fields(lines: bytes) -> dict:
    rows = (line.partition(b": ") for line in lines.split(b"\r\n")[1:])
    return {name.decode(): value.decode("utf-8", "surrogatepass") for name, _, value in rows if name}


def parse(data: bytes, at: int) -> tuple:
    """Fields of the record at an offset, and the offset after it; checks the digest."""
    end = data.index(END, at)
    head = _fields(data[at:end])
    begin = end + len(END)
    size = int(head["Content-Length"])
    block = data[begin : begin + size]
    if data[:5] != b"WARC/" or data[begin + size : begin + size + 4] != END:
        raise ValueError(f"broken WARC record at {at}")
    http, _, payload = block.partition(END)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload digest differs at {at}")
    number = lambda field: int(head[field].strip("<>").rsplit(":", 1)[1]) if field in head else None
    return (
        number("WARC-Record-ID"),
        int(_fields(http)["Content-Length"]),
        digest,
        kind,
        number("WARC-Refers-To"),
        head.get("WARC-Target-URI"),
        payload if kind == "response" else None,
    ), begin + size + len(END)


def seek_table(sizes: list) -> bytes:
    """Skippable frame with the compressed and plain size of every frame."""
    entries = b"".join(packing.pack("<II", c, d) for c, d in sizes)
    footer = packing.pack("<IBI", len(sizes), 0, SEEKABLE)
    return packing.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frame_sizes(bundle: bytes) -> list:
    """Sizes of the frames, from the footer."""
    n, flags, magic = packing.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    entries = bundle[-9 - 8 * n : -9]
    return [packing.unpack_from("<II", entries, 8 * i) for i in range(n)]


def frame(bundle: bytes, number: int) -> bytes:
    """One frame, decompressed; no other is touched."""
    sizes = frame_sizes(bundle)
    at = sum(c for c, _ in sizes[:number])
    size, plain = sizes[number]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=plain)


class _Packer:
    """Collects records into frames, and frames into a bundle."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.reset()

    def reset(self):
        self.parts, self.sizes, self.open, self.filled, self.total = [], [], [], 0, 0
        self.ids, self.frames, self.offsets = [], [], []

    def add(self, page_id, data: bytes):
        if self.open and self.filled + len(data) > FRAME_BYTES:
            self.close_frame()
        self.ids.append(page_id)
        self.frames.append(len(self.sizes))
        self.offsets.append(self.filled)
        self.open.append(data)
        self.filled += len(data)
        self.total += len(data)

    def close_frame(self):
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def bundle(self) -> dict:
        self.close_frame()
        out = dict(
            data=b"".join(self.parts) + seek_table(self.sizes),
            ids=self.ids,
            frames=self.frames,
            offsets=self.offsets,
        )
        self.reset()
        return out


def _batch(bundle: dict) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    arrays = [pa.array([bundle[f]], kind) for f, kind in zip(BUNDLE.names, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=BUNDLE.names)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, payload, first) to bundles."""
    packer = _Packer()
    for batch in batches:
        for page_id, url, payload, first in zip(*(batch.column(i) for i in range(4))):
            data = record(page_id.as_py(), url.as_py(), payload.as_py() or b"", first.as_py())
            if packer.ids and packer.total + len(data) > BUNDLE_BYTES:
                yield _batch(packer.bundle())
            packer.add(page_id.as_py(), data)
    if packer.ids:
        yield _batch(packer.bundle())


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles to their records, frame by frame."""
    for batch in batches:
        for data in batch.column("data"):
            bundle = data.as_py()
            for number in range(len(frame_sizes(bundle))):
                yield _records(frame(bundle, number))


def _records(plain: bytes) -> pa.RecordBatch:
    rows, at = [], 0
    while at < len(plain):
        row, at = parse(plain, at)
        rows.append(row)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=RECORD.names)


def with_first(pages: DataFrame, page_id: Column, url: Column, payload: Column) -> DataFrame:
    """(page_id, url, payload, first): the smallest id of each payload."""
    rows = pages.select(
        page_id.cast("long").alias("page_id"),
        url.cast("string").alias("url"),
        F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # The payloads stay out of this shuffle; most are alone, and their join has one row each.
    firsts = pages.select(
        page_id.cast("long").alias("page_id"),
        F.unhex(F.sha1(F.coalesce(payload.cast("binary"), F.lit(b"")))).alias("digest"),
    )
    firsts = firsts.groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(firsts, "digest").select("page_id", "url", "payload", "first")


def write(pages: DataFrame, path: str, page_id="page_id", url="url", payload="html") -> None:
    """Write the archive: bundles with the ids, frames and offsets of their records."""
    rows = with_first(pages, F.col(page_id), F.col(url), F.col(payload))
    bundles = rows.mapInArrow(pack, BUNDLE)
    bundles.withColumn("bundle", F.monotonically_increasing_id()).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive."""
    return spark.read.parquet(path).select("data").mapInArrow(unpack, RECORD)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, bundle, frame, offset) of every record; the bundles themselves are not read."""
    rows = spark.read.parquet(path).select("bundle", F.explode(F.arrays_zip("ids", "frames", "offsets")).alias("r"))
    return rows.select(
        F.col("r.ids").alias("page_id"), "bundle", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset")
    )


def fetch(spark: SparkSession, path: str, page_ids: Iterable[int]) -> DataFrame:
    """Records by id: only their frames are decompressed."""
    wanted = index(spark, path).filter(F.col("page_id").isin(list(page_ids)))
    wanted = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("at"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("data"), batch.column("at")):
                for place in places.as_py():
                    plain = frame(data.as_py(), place["frame"])
                    row, _ = parse(plain, place["offset"])
                    yield from _one(row)

    def _one(row):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=RECORD.names)

    return spark.read.parquet(path).join(wanted, "bundle").select("data", "at").mapInArrow(one, RECORD)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Group i of five bits lies in the eight bits from hexadecimal digit 5 * i // 4 on.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (('0x' || substr(h, 1 + 5 * i // 4, 2))::INTEGER >> (3 - 5 * i % 4)) % 32, 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
