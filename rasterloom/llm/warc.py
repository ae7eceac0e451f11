"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole records, ended
by a seek table in a skippable frame (the public seekable format): sizes of all frames, so
that a reader finds any frame from the file's last bytes alone.  The index maps a record
identifier to its bundle, frame and offset within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store

#: Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEVEL = 3


class BundleWriter:
    """Frames of whole records in one file; keeps only the frame being filled and the frame sizes."""

    def __init__(self, sink):
        self._sink, self._frame, self._sizes = sink, bytearray(), []
        self._compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self._frame and len(self._frame) + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self._sizes), len(self._frame)
        self._frame += record
        return place

    def _flush(self) -> None:
        packed = self._compress(bytes(self._frame))
        self._sizes.append((len(packed), len(self._frame)))
        self._sink.write(packed)
        self.written += len(packed)
        self._frame = bytearray()

    def close(self) -> None:
        if self._frame:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes)
        body = table + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        self._sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self._sink.close()


class BundleReader:
    """Random access to a bundle's frames."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 8 * n, 8 * n)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts, at = [], 0
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed

    def _at(self, offset: int, n: int) -> bytes:
        self._source.seek(offset)
        return self._source.read(n)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], packed), max_output_size=size)


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None, own_id: object, refers_own: object) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but states its length and digest."""
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"{name}: {quote(str(value))}" for name, value in (("X-Page-ID", own_id), ("X-Refers-To-Page-ID", refers_own)) if value is not None]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(data: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record at ``offset``."""
    end = data.index(b"\r\n\r\n", offset)
    head = data[offset:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in head[1:])
    n = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + n], end + 8 + n


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _roles(pages: DataFrame, minimum: int) -> DataFrame:
    """page_id, url, body, turn (of repeated rows), top (page_id of the response), response, by one shuffle of the html.

    Digests are counted first, so a payload that a third of all pages share is never
    gathered: only (digest, greatest page_id) meets the pages again, and by the same key
    that numbers repeated rows.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = F.concat(F.when(F.col("page_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = pages.select("page_id", "url", body.alias("body"), own.alias("own")).withColumn("digest", F.sha1("body"))
    alike = rows.where(F.octet_length("body") >= minimum)
    groups = alike.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").select("digest", "top")
    ids = alike.select("own", "digest").distinct().join(groups, "digest").withColumn("grouped", F.lit(True))
    named = rows.withColumn("turn", F.row_number().over(W.partitionBy("own", "digest").orderBy("url")))
    joined = named.join(ids, ["own", "digest"], "left")
    response = F.col("grouped").isNull() | (F.col("page_id").eqNullSafe(F.col("top")) & (F.col("turn") == 1))
    return joined.select("page_id", "url", "body", "turn", F.when(~response, F.col("top")).alias("top"), response.alias("response"))


def write_archives(pages: DataFrame, folder: str, minimum: int = 0) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)``; returns the index.

    Of records with equal payloads (UTF-8 of html, null being empty) of at least
    ``minimum`` bytes the one with the largest page_id is the response, the others revisit
    it; a null page_id counts as smallest.  Of repeated rows with that page_id one is the
    response.  Bundles appear under their final name only when complete, so a task that
    runs twice leaves an unlisted file at most.  Index: page_id, record_id, bundle, frame,
    offset, length.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        writer = name = temporary = None
        rows: list[tuple] = []

        def close():
            writer.close()
            fs.move(temporary, f"{base}/{name}")
            out = [pa.array([r[i] for r in rows], t) for i, t in enumerate([id_type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()])]
            return pa.RecordBatch.from_arrays(out, ["page_id", "record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for page, url, body, turn, top, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    temporary = f"{base}/.{name}.part"
                    writer, rows = BundleWriter(fs.open_output_stream(temporary)), []
                body = bytes(body)
                digest = _base32(body)
                own = _record_id(page, digest, turn)
                refers = None if response else _record_id(top, digest, 1)
                data = record("response" if response else "revisit", own, " ".join((url or "").split()), body, digest, refers, page, top)
                frame, offset = writer.add(data)
                rows.append((page, own, name, frame, offset, len(data)))
                if writer.written >= BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return map_arrow(_roles(pages, minimum), run, f"page_id {kind}, record_id string, bundle string, frame int, offset long, length long")


def _record_id(page, digest: str, turn: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{turn}')}"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` lists back from the bundles, each frame once: page_id,
    payload_bytes, payload_digest, record_type, refers_to, record_id, as the records state
    them; a response's digest and length are computed anew and must agree."""
    kind = index.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        name = number = reader = data = None
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for bundle, frame, offset, record_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, number, reader = bundle, None, BundleReader(fs.open_input_file(f"{base}/{bundle}"))
                if frame != number:
                    number, data = frame, reader.frame(frame)
                headers, body, _ = parse(data, offset)
                if headers["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"another record at {bundle}, {frame}, {offset}")
                digest, n, what = headers["WARC-Payload-Digest"][5:], int(headers["X-Payload-Length"]), headers["WARC-Type"]
                if what == "response" and (len(body) != n or _base32(body) != digest):
                    raise ValueError(f"payload differs at {bundle}, {frame}, {offset}")
                page, refers = (None if x is None else unquote(x) for x in map(headers.get, ("X-Page-ID", "X-Refers-To-Page-ID")))
                row = (page, n, digest, what, refers, record_id)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])

    asked = index.select("bundle", "frame", "offset", "record_id").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    read = map_arrow(asked, run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string")
    return read.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def round_trip(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Write the archives and their index to the shared folder, then read every record back."""
    folder = store.new_path(pages.sparkSession, "warc")
    index = store.written(write_archives(pages, folder, minimum), "warc-index")
    return read_archives(index, folder)
