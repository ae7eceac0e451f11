"""Substring deduplication by parsing documents against indexed reference blocks.

A window of ``width`` words that starts in more than one place is a duplicate.  Reference
blocks are stretches of text around anchors: the least hash among the short grams of a
window, so that equal windows have equal anchors at equal places.  Two counts over the
whole input, of anchors and of the windows under repeated ones, leave the pieces of blocks
whose windows may repeat.  The index maps a piece, and for anchors with differing pieces
every window in them, to its first occurrence, the reference: counting by it decides.
Each document is then parsed greedily: a factor takes up every piece that follows one
reference without a gap; windows at the boundary of a factor, inside pieces that match no
other as a whole, are looked up by themselves, so cutting at boundaries loses none.
Factors of ``width`` words or more are duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store
from .words import Windows, gram_hashes, key_bits, repeated_keys, short_keys, slices, split_words, word_ids

#: Words of an anchor.
ANCHOR = 16


def anchors(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, windows) of each maximal run of windows with one anchor place."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(ANCHOR, width)
    grams, span = gram_hashes(ids, k), width - k + 1
    least, place, step = grams, np.arange(len(grams)), 1

    def leftmost(low: slice, high: slice):
        later = least[high] < least[low]
        return np.where(later, least[high], least[low]), np.where(later, place[high], place[low])

    while 2 * step <= span:  # minima of runs of doubling length
        least, place = leftmost(slice(0, len(least) - step), slice(step, len(least)))
        step *= 2
    _, place = leftmost(slice(0, n), slice(span - step, span - step + n))
    first = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
    return grams[place[first]], first, np.diff(np.append(first, n))


def pieces(ids: np.ndarray, width: int, anchored: Callable, repeated: Callable):
    """(anchor, first window, windows, hash of all its words, hashes of its windows) of each maximal run of windows
    that have one anchor place, whose anchor is in ``anchored`` and whose hashes are all in ``repeated``."""
    anchor, start, n = anchors(ids, width)
    keep = anchored(anchor)
    if not keep.any():
        return [], [], [], [], []
    hashes, at = Windows(ids), np.arange(len(ids) - width + 1)
    every = hashes(at, at + width)
    kept = np.repeat(keep, n)
    kept[kept] = repeated(every[kept])
    block = np.repeat(np.arange(len(n)), n)
    begins = kept & np.concatenate(([True], ~kept[:-1] | (block[1:] != block[:-1])))
    ends = kept & np.concatenate((~kept[1:] | (block[1:] != block[:-1]), [True]))
    first, last = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return anchor[block[first]], first, last - first, hashes(first, last + width - 1), [every[a:b] for a, b in zip(first, last, strict=True)]


def _filters(docs: DataFrame, width: int) -> tuple[Callable, Callable]:
    """Two tests of uint64 keys: whether an anchor, and whether a window of such anchors, may occur twice."""
    bits, texts = key_bits(docs), docs.select("text")

    def test(keys: DataFrame) -> Callable:
        found = store.written(keys.select("key"), "repeated")
        shared = docs.sparkSession.sparkContext.broadcast(store.repeated_bitmap(found, found.count()))
        store.discard(found)
        store.tidy(docs.sparkSession)
        return lambda k: store.in_bitmap(shared.value, short_keys(k, bits))

    def windows(text: str | None) -> np.ndarray:
        ids = word_ids(split_words(text))
        found = pieces(ids, width, anchored, lambda k: np.ones(len(k), bool))[4]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    anchored = test(repeated_keys(texts, lambda t: anchors(word_ids(split_words(t)), width)[0], bits))
    return anchored, test(repeated_keys(texts, windows, bits))


def _blocks(docs: DataFrame, width: int, anchored: Callable, repeated: Callable, keep_text: bool) -> DataFrame:
    """Per row: word count and, if it has no piece, its digest; else its text and pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "n_words", "kept_sha256", "text", "anchor", "start", "windows", "block", "hashes"]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in slices(batches):
            out: list[list] = [[] for _ in names[2:]]
            for text in batch.column(2).to_pylist():
                words = split_words(text)
                anchor, start, n, block, hashes = pieces(word_ids(words), width, anchored, repeated)
                row: list = [len(words), None, text, None, None, None, None, None]
                if len(start):
                    row[3:] = [anchor.view(np.int64), start, n, block.view(np.int64), [h.view(np.int64) for h in hashes]]
                elif not keep_text:
                    row[1:3] = [hashlib.sha256(b" ".join(words)).hexdigest(), None]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.string(), pa.string(), longs, pa.list_(pa.int32()), pa.list_(pa.int32()), longs, pa.list_(longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    schema = f"rid long, doc_id {kind}, n_words long, kept_sha256 string, text string, anchor array<long>, start array<int>, windows array<int>, block array<long>, hashes array<array<long>>"
    return map_arrow(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), run, schema)


def _marks(table: DataFrame) -> DataFrame:
    """(rid, start, windows, ref_rid, ref_start): runs of duplicate windows with a reference each."""
    some = table.where("start is not null")
    zipped = F.explode(F.arrays_zip("start", "windows", "anchor", "block"))
    rows = some.select("rid", zipped.alias("b")).select("rid", "b.*")
    key = ["anchor", "block", "windows"]
    index = store.written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start")).alias("ref")), "blocks")
    store.tidy(table.sparkSession)
    whole = rows.join(index.where("n > 1"), key).select("rid", "start", "windows", F.col("ref.rid").alias("ref_rid"), F.col("ref.start").alias("ref_start"))

    mixed = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("anchor")
    wanted = index.join(mixed, "anchor").select(F.col("ref.rid").alias("rid"), F.col("ref.start").alias("start"), (F.col("n") == 1).alias("single"))
    full = some.select("rid", F.explode(F.arrays_zip("start", "anchor", "hashes")).alias("b")).select("rid", "b.*")
    single = full.join(wanted, ["rid", "start"]).select("rid", "start", "anchor", "single", F.posexplode("hashes").alias("i", "hash"))
    windows = store.written(single.select("rid", (F.col("start") + F.col("i")).alias("start"), "anchor", "hash", "single"), "windows")
    store.tidy(table.sparkSession)
    again = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start")).alias("ref")).where("n > 1")
    parts = windows.where("single").join(again, ["anchor", "hash"]).select("rid", "start", F.lit(1).alias("windows"), F.col("ref.rid").alias("ref_rid"), F.col("ref.start").alias("ref_start"))
    return whole.union(parts)


def factors(marks: list[tuple[int, int, int, int]], width: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of marks (start, windows, ref_rid, ref_start): factors (start, words, ref_rid, ref_start).

    A factor takes up every next run that follows the same reference without a gap.
    """
    out: list[list[int]] = []
    for start, n, rid, ref in sorted(marks):
        if out and out[-1][2] == rid and ref - start == out[-1][3] - out[-1][0] and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
        else:
            out.append([start, n, rid, ref])
    return [(s, n + width - 1, r, p) for s, n, r, p in out]


def substring_dedup(docs: DataFrame, width: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors of every row of ``docs(doc_id, text)``.

    Every word inside a window of ``width`` words (``[^\\x20\\x09-\\x0D]+``, unchanged) whose
    sequence also starts anywhere else in the input, the same row included, is removed;
    ``factors`` lists (start, words, ref_row, ref_start), with ``keep_text`` the kept words
    are returned too.  Null, empty and short texts keep everything.  Repeated rows are each
    other's duplicates; doc_id is only carried and may be null.
    """
    spark = docs.sparkSession
    table = store.written(_blocks(docs, width, *_filters(docs, width), keep_text), "parse")
    store.tidy(spark)
    marks = _marks(table).groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "ref_rid", "ref_start")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    open_rows = table.where("kept_sha256 is null").select("rid", "doc_id", "n_words", "text").join(marks, "rid", "left").drop("rid")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            removed, digests, spans, texts = [], [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = split_words(text)
                parse = factors([(m["start"], m["windows"], m["ref_rid"], m["ref_start"]) for m in found or ()], width)
                dead = bytearray(len(words))
                for s, n, _, _ in parse:
                    dead[s : s + n] = b"\1" * n
                kept = b" ".join([w for w, d in zip(words, dead, strict=True) if not d])
                removed.append(sum(dead))
                digests.append(hashlib.sha256(kept).hexdigest())
                spans.append([dict(zip(("start", "words", "ref_row", "ref_start"), f, strict=True)) for f in parse])
                texts.append(kept.decode() if keep_text else None)
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "ref_row", "ref_start")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, span), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept_text"])

    spans = "array<struct<start:long,words:long,ref_row:long,ref_start:long>>"
    parsed = map_arrow(open_rows, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, factors {spans}, kept_text string")
    plain = table.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.expr(f"cast(array() as {spans})").alias("factors"), F.lit(None).cast("string").alias("kept_text"))
    out = plain.unionByName(parsed)
    return out if keep_text else out.drop("kept_text")
