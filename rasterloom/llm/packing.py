"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Lengths are at most ``limit``, so the whole corpus is described by a histogram of at most
``limit`` counts, however many documents there are.  The driver packs that histogram: a
bin is filled greedily with the longest documents that fit, then its smallest document
gives way to two unpacked ones that fill the expanded gap more tightly, and the finished
bin is repeated as often as the counts allow.  Documents then find their places by their
rank among those of equal length, which many tasks number together.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store

#: Rows that one task numbers among equal lengths.
RANK_ROWS = 8192
#: Chunks kept in a worker's token cache.
CACHED_CHUNKS = 400_000


class Encoder:
    """Token ids (uint32, little-endian bytes) of texts, equal to those of ``tokenizers``.

    Texts whose words are parted by single spaces or line ends are encoded word by word
    through a cache, as a byte-level pre-tokenizer never joins text across such a place.
    New words go to the same vocabulary as ranks; anything unusual goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._other_space = re.compile(r"[^\S \n]")
        self._chunks = _Chunks(self._encode)
        self._fast = self._ranks(path)

    def _ranks(self, path: str):
        """The vocabulary as ranks, if it is a byte-level BPE whose ids follow its merges; else None."""
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = set(self._added)
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for probe in ("it's  a\n\n test, Überfluß 12345!?", " x\t y ", "naïve 日本語 thonreingwhtion"):
            if fast.encode_ordinary(probe) != self._tokenizer.encode(probe, add_special_tokens=False).ids:
                return None
        return fast

    def _encode(self, text: str) -> bytes:
        if self._fast is not None:
            for added in self._added:
                if added in text:
                    break
            else:
                return array("I", self._fast.encode_ordinary(text)).tobytes()
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._fast is None or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or self._other_space.search(text):
            return self._encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._encode(first) + b"".join(map(self._chunks.__getitem__, rest))


class _Chunks(dict):
    """Ids of words that follow a space, or that begin with a line end and follow none."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = self._encode(chunk if chunk[0] == "\n" else " " + chunk)
        if len(self) < CACHED_CHUNKS:
            self[chunk] = out
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_bounds(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have ``limit`` ids."""
    first = (n - 1) % limit + 1
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def tokenised(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids as bytes.

    Null text counts as empty (the end id alone); a null doc_id stays null.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        encode, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, limit)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def pack_histogram(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times): best-two-fit over a histogram of lengths.

    Each round uses up a length or leaves fewer of it than the bin took, so there are at
    most ``sum(1 + limit / s for s in lengths)`` rounds: about 8,700 for 1024, whatever the counts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    have = sum(1 << s for s in left)
    bins: list[tuple[list[int], int]] = []

    def longest(mask: int, most: int) -> int:
        return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1

    while have:
        used: Counter[int] = Counter()
        free, room, taken = have, limit, []

        def take(s: int) -> None:
            nonlocal free, room
            used[s] += 1
            room -= s
            taken.append(s)
            if used[s] == left[s]:
                free &= ~(1 << s)

        while room and (s := longest(free, room)) > 0:
            take(s)
        while room and taken:
            smallest = min(taken)
            gap, best = room + smallest, (smallest, 0, 0)
            x = longest(free, gap - 1)
            while x > 0 and 2 * x > best[0]:
                mask = free if left[x] - used[x] > 1 else free & ~(1 << x)
                y = longest(mask, min(x, gap - x))
                if y > 0 and x + y > best[0]:
                    best = (x + y, x, y)
                    if x + y == gap:
                        break
                x = longest(free, x - 1)
            if best[0] == smallest:
                break
            taken.remove(smallest)
            used[smallest] -= 1
            room += smallest
            free |= 1 << smallest
            take(best[1])
            take(best[2])
        used = +used
        times = min(left[s] // k for s, k in used.items())
        bins.append((sorted(taken, reverse=True), times))
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                have &= ~(1 << s)
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Of each run of ranks of one length: its bins' first sequence id, first offset, and copies a bin."""
    rows, seen, sequence = [], Counter(), 0
    for lengths, times in bins:
        offset = 0
        for s, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((s, seen[s], sequence, offset, k))
            seen[s] += k * times
            offset += s * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "first", "sequence", "offset", "copies"))}


def packed(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a written table with a ``length`` of at most ``limit``).

    Empty input gives an empty result.  Equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(pack_histogram(counts, limit)))
    names = pieces.columns
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in names]
    buckets = max(1, -(-sum(counts.values()) // RANK_ROWS))
    bucket = F.expr(f"pmod(xxhash64({', '.join(order)}), {buckets})")
    ranked = store.with_rank(pieces, ["length"], bucket, [F.col(c) for c in order], "__rank")

    def run(batches: Iterable[pa.RecordBatch]):
        t = table.value
        keys = (t["length"] << 48) + t["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            turn = rank - t["first"][at]
            sequence = t["sequence"][at] + turn // t["copies"][at]
            offset = t["offset"][at] + turn % t["copies"][at] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return map_arrow(ranked, run, schema)


def pack(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise and pack ``docs(doc_id, text)``; see :func:`tokenised` and :func:`packed`."""
    return packed(store.written(tokenised(docs, path, limit, end_id), "pieces"), limit)
