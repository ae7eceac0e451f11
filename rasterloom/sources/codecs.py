"""PNG and raw raster codecs in numpy and zlib, and the compressed run-length string."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import map_arrow

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 3: 2, 4: 6}
CHANNELS = {0: 1, 2: 3, 6: 4}
RAW = b"RAWF"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pack_image(a: np.ndarray) -> bytes:
    """bool to 1-bit PNG, uint8 and uint16 to PNG, float16 and float32 to a tagged raw buffer; 1, 3 or 4 channels."""
    a = np.asarray(a)
    a = a[..., None] if a.ndim == 2 else a
    h, w, c = a.shape
    if c not in COLOUR:
        raise ValueError(f"{c} channels")
    if a.dtype in (np.float16, np.float32):
        return RAW + struct.pack("<IIIc", h, w, c, b"e" if a.dtype == np.float16 else b"f") + zlib.compress(np.ascontiguousarray(a).tobytes())
    if a.dtype == bool:
        if c != 1:
            raise ValueError("1-bit images have one channel")
        depth, rows = 1, np.packbits(a[..., 0], axis=1)
    elif a.dtype == np.uint8:
        depth, rows = 8, a.reshape(h, -1)
    elif a.dtype == np.uint16:
        depth, rows = 16, np.ascontiguousarray(a.astype(">u2")).view(np.uint8).reshape(h, -1)
    else:
        raise ValueError(f"{a.dtype} pixels")
    body = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", w, h, depth, COLOUR[c], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, 9)) + _chunk(b"IEND", b"")


def unpack_image(data: bytes) -> np.ndarray:
    """Height x width (x channels) array; all PNG row filters are read."""
    if data[:4] == RAW:
        h, w, c, kind = struct.unpack("<IIIc", data[4:17])
        a = np.frombuffer(zlib.decompress(data[17:]), np.float16 if kind == b"e" else np.float32).reshape(h, w, c)
        return a[..., 0] if c == 1 else a
    if data[:8] != SIGNATURE:
        raise ValueError("neither PNG nor raw")
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if interlace or colour not in CHANNELS:
                raise ValueError("unsupported PNG")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    c = CHANNELS[colour]
    stride, step = (w * c * depth + 7) // 8, max(1, c * depth // 8)
    raw = zlib.decompress(body)
    rows = np.zeros((h, stride), np.uint8)
    above = bytearray(stride)
    for y in range(h):
        how, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        _unfilter(how, line, above, step)
        rows[y] = np.frombuffer(bytes(line), np.uint8)
        above = line
    if depth == 1:
        return np.unpackbits(rows, axis=1)[:, :w].astype(bool)
    a = rows.reshape(h, w, c) if depth == 8 else rows.view(">u2").reshape(h, w, c).astype(np.uint16)
    return a[..., 0] if c == 1 else a


def _unfilter(how: int, line: bytearray, above: bytearray, step: int) -> None:
    for i in range(len(line) if how else 0):
        left = line[i - step] if i >= step else 0
        up, corner = above[i], above[i - step] if i >= step else 0
        if how == 1:
            guess = left
        elif how == 2:
            guess = up
        elif how == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        line[i] = (line[i] + guess) & 255


def pack_counts(counts: list[int]) -> str:
    """Run lengths as printable text: differences to the run two before, 5 bits a character, low bits first."""
    out = []
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out.append(chr(48 + (c | 32 if more else c)))
    return "".join(out)


def unpack_counts(text: str) -> list[int]:
    counts: list[int] = []
    x = shift = 0
    for ch in text:
        c = ord(ch) - 48
        x |= (c & 31) << shift
        shift += 5
        if not c & 32:
            if c & 16:
                x -= 1 << shift
            counts.append(x + counts[-2] if len(counts) > 2 else x)
            x = shift = 0
    return counts


def with_text_counts(rle: DataFrame, image: str) -> DataFrame:
    """(image, text) of ``rle(image, counts)``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack_counts(c) for c in b.column(1).to_pylist()], pa.string())], [image, "text"])

    kind = rle.schema[image].dataType.simpleString()
    return map_arrow(rle.select(image, "counts"), run, f"{image} {kind}, text string")


def from_text_counts(coded: DataFrame, image: str) -> DataFrame:
    """(image, counts) of ``coded(image, text)``; null stays null."""

    def run(batches):
        for b in batches:
            counts = [None if t is None else unpack_counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.list_(pa.int32()))], [image, "counts"])

    kind = coded.schema[image].dataType.simpleString()
    return map_arrow(coded.select(image, "text"), run, f"{image} {kind}, counts array<int>")
