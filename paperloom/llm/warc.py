"""WARC archives in seekable Zstandard bundles.

A bundle is a run of WARC records in independent Zstandard frames, closed by a seek table in a skippable frame (the
public seekable format: one entry per frame with its compressed and decompressed size, then a footer). The index maps a
record to its frame and its offset within the frame's decompressed bytes, so one record is read by decompressing one
frame. Bundles are kept as binary rows of a table: executors write and read them through Spark alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import materialize

#: Fixed values of the seekable format: skippable frame, footer magic, size of the footer and of an entry.
SKIPPABLE = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
#: Equal payloads of fewer bytes are stored again.
REVISIT_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_BUNDLE = "bundle_id string, archive binary, n_records long, entries array<struct<record_id:long,frame:int,offset:long,length:long>>"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, whole boolean"


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _id_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; without a payload it is a revisit that names the response."""
    revisit = payload is None
    block = _HTTP + (payload or b"")
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is None:
        head.append("X-No-Target: 1")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; `whole` tells whether a response's payload has the digest that its header gives."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block[len(_HTTP) :]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "page_id": _id_of(fields["WARC-Record-ID"]),
        "url": None if "X-No-Target" in fields else url,
        "record_type": fields["WARC-Type"],
        "refers_to": _id_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": digest if revisit else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload": payload,
        "whole": revisit or hashlib.sha256(payload).hexdigest() == digest,
    }


class Bundle:
    """Collects records into frames; finish() gives the archive with its seek table."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open = bytearray()
        self.raw = 0

    def add(self, record_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close()
        self.entries.append({"record_id": record_id, "frame": len(self.sizes), "offset": len(self.open), "length": len(record)})
        self.open += record
        self.raw += len(record)

    def _close(self) -> None:
        frame = self.compress(bytes(self.open))
        self.parts.append(frame)
        self.sizes.append((len(frame), len(self.open)))
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(ENTRY.pack(*x) for x in self.sizes) + FOOTER.pack(len(self.sizes), 0, FOOTER_MAGIC)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    count, flags, magic = FOOTER.unpack_from(archive, len(archive) - FOOTER.size)
    if magic != FOOTER_MAGIC or flags:
        raise ValueError("not a seekable archive")
    at, table, start = len(archive) - FOOTER.size - count * ENTRY.size, [], 0
    for i in range(count):
        packed, size = ENTRY.unpack_from(archive, at + i * ENTRY.size)
        table.append((start, packed, size))
        start += packed
    return table


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=max(size, 1))


def _bundle_batches(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    part, made, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part:06d}-{made:06d}"]),
                pa.array([bundle.finish()], pa.binary()),
                pa.array([len(bundle.entries)], pa.int64()),
                pa.array([bundle.entries], pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
            ],
            ["bundle_id", "archive", "n_records", "entries"],
        )

    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            for row in whole.slice(at, 128).to_pylist():
                bundle.add(row["page_id"], record_bytes(row["page_id"], row["url"], row["payload"], row["size"], row["digest"], row["refers_to"]))
                if bundle.raw >= bundle_bytes:
                    yield out()
                    made, bundle = made + 1, Bundle(frame_bytes)
    if bundle.entries:
        yield out()


def write_bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle_id, archive, n_records, entries) for a table of pages (page_id, url, html).

    Digests are grouped on narrow rows: of equal payloads of at least 100 bytes, the one with the smallest page_id is the
    response and the others revisit it. Rows are dealt out by page_id, so copies of one page are spread over all tasks.
    A null html is an empty payload; a row without page_id is stored under "none", and revisits a response if there is
    one with an id, else it is a response; rows that repeat the response's page_id and payload are responses too.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = materialize(rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest"))
    copied = materialize(
        narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    )
    # a null page_id is turned into a key of its own, so that the join needs no null-safe comparison
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none "), F.col("digest")))
    later = narrow.join(copied, "digest").where("page_id IS NULL OR page_id != first_id").select(key.alias("_key"), "digest", "first_id").distinct()
    marked = rows.withColumn("_key", key).join(later, ["_key", "digest"], "left")
    stored = marked.select(
        "page_id",
        "url",
        F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("size"),
        "digest",
        F.col("first_id").alias("refers_to"),
    )
    return stored.mapInArrow(lambda it: _bundle_batches(it, frame_bytes, bundle_bytes), _BUNDLE)


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle_id, frame, offset, length): offset is relative to the frame's decompressed bytes."""
    return bundles.select("bundle_id", F.explode("entries").alias("e")).select("e.record_id", "bundle_id", "e.frame", "e.offset", "e.length")


def _record_batches(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "whole"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    for batch in batches:
        for i in range(batch.num_rows):
            archive, entries = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            table, at = seek_table(archive), 0
            for n, frame in enumerate(table):
                data, found = read_frame(archive, frame), []
                while at < len(entries) and entries[at]["frame"] == n:
                    e = entries[at]
                    found.append(parse_record(data[e["offset"] : e["offset"] + e["length"]]))
                    if not keep_payload:
                        found[-1]["payload"] = None
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds, strict=True)], names)


def read_bundles(bundles: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Every record of the bundles, found through seek table and index; digests are computed from the stored payloads."""
    return bundles.select("archive", "entries").mapInArrow(lambda it: _record_batches(it, keep_payload), _RECORD)


def read_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named in wanted (record_id long): only the frames that hold them are decompressed.

    Unknown, null and repeated ids add nothing; no bundles give no records.
    """
    places = record_index(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    chosen = places.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length"))).alias("entries"))
    return bundles.select("bundle_id", "archive").join(chosen, "bundle_id").select("archive", "entries").mapInArrow(_seek_batches, _RECORD)


def _seek_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "whole"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    for batch in batches:
        for i in range(batch.num_rows):
            archive = batch.column(0)[i].as_py()
            table, held, data = seek_table(archive), -1, b""
            for e in batch.column(1)[i].as_py():
                if e["frame"] != held:
                    held, data = e["frame"], read_frame(archive, table[e["frame"]])
                r = parse_record(data[e["offset"] : e["offset"] + e["length"]])
                yield pa.RecordBatch.from_arrays([pa.array([r[k]], t) for k, t in zip(names, kinds, strict=True)], names)
