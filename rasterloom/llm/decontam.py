"""Benchmark decontamination by SimHash over item-sized windows.

Texts are lower-cased words (runs of letters, digits and other non-space characters
without ASCII punctuation).  An item's fingerprint is the SimHash of its weighted word
shingles.  A document is read through windows of each item's own size; windows that
share no shingle with any item have similarity 0 and are passed over.  The other
windows' fingerprints are looked up in a multi-index: of 8 blocks of 8 bits, two
fingerprints within 23 bits agree in one block to 2 bits, so a table per block, filled
with all values within 2 bits of each item's, finds every item within the radius.
Candidates within the radius are then compared exactly by weighted shingle Jaccard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import map_arrow
from .words import gram_hashes, word_ids

#: Fingerprint bits that may differ: 8 blocks of 2 bits more each, less one.
RADIUS = 23
#: Items and characters of items whose tables one pass holds; more take more passes over the documents.
ITEMS_A_PASS = 16_384
CHARS_A_PASS = 16 << 20
#: Characters between words, besides white space: fixed ASCII punctuation.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BALL = [i for i in range(256) if _BITS[i] <= 2]


def words_of(text: str | None) -> np.ndarray:
    return word_ids(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else [])


def shingles_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-word shingles in order; a shorter text is one shingle."""
    return gram_hashes(ids, min(n, len(ids))) if len(ids) else np.empty(0, np.uint64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    return 2 * bits - 1


def simhash(shingles: np.ndarray) -> np.ndarray:
    """64-bit SimHash, as 8 bytes; a shingle weighs as often as it occurs."""
    return np.packbits(_signs(shingles).sum(axis=0) > 0)


class Index:
    """Items by size, with the multi-index tables of each size."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.n = n
        self.ids, self.shingles, sizes = [], [], []
        for item, text in items:
            ids = words_of(text)
            if len(ids):
                self.ids.append(item)
                self.shingles.append(np.sort(shingles_of(ids, n)))
                sizes.append(len(ids))
        self.sizes = np.array(sizes, np.int64)
        self.prints = np.array([simhash(s) for s in self.shingles], np.uint8).reshape(-1, 8)
        # seeds: each shingle with the sizes of the items that have it; short items look for shorter grams
        self.seeds: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for k in sorted({min(n, s) for s in sizes}):
            by: dict[int, set[int]] = {}
            for s, size in zip(self.shingles, sizes, strict=True):
                if min(n, size) == k:
                    for h in s.tolist():
                        by.setdefault(h, set()).add(size)
            self.seeds[k] = (np.array(sorted(by), np.uint64), {h: sorted(v) for h, v in by.items()})
        self.tables = {}
        for size in set(sizes):
            members = np.nonzero(self.sizes == size)[0]
            table = np.zeros((8, 256, len(members)), bool)
            for j, i in enumerate(members):
                for block in range(8):
                    for near in _BALL:
                        table[block, int(self.prints[i, block]) ^ near, j] = True
            self.tables[size] = (members, table)

    def _windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Size -> starts of the windows that share a shingle with an item of that size."""
        reach: dict[int, np.ndarray] = {}
        for k, (seeds, sizes) in self.seeds.items():
            grams = gram_hashes(ids, k)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
            for place in np.nonzero(seeds[at] == grams)[0].tolist():
                for size in sizes[int(grams[place])]:
                    last = max(0, len(ids) - size)
                    starts = reach.setdefault(size, np.zeros(last + 1, bool))
                    starts[max(0, min(place + k - size, last)) : min(place, last) + 1] = True
        return {size: np.nonzero(starts)[0] for size, starts in reach.items()}

    def matches(self, text: str | None, threshold: float) -> dict[int, tuple[float, int, int]]:
        """Place of an item -> (similarity, first word, words) of its best window at or above the threshold."""
        ids = words_of(text)
        found: dict[int, tuple[float, int, int]] = {}
        for size, starts in self._windows(ids).items():
            k = min(self.n, size)
            grams = gram_hashes(ids, k)
            count = max(1, min(size, len(ids)) - k + 1)
            members, table = self.tables[size]
            for part in np.split(starts, range(512, len(starts), 512)):
                lo, hi = int(part[0]), int(part[-1]) + count
                if len(part) * 4 < hi - lo:  # far apart: sum each window by itself
                    sums = np.stack([_signs(grams[s : s + count]).sum(axis=0) for s in part])
                else:
                    run = np.zeros((hi - lo + 1, 64), np.int32)
                    np.cumsum(_signs(grams[lo:hi]), axis=0, out=run[1:])
                    sums = run[part - lo + count] - run[part - lo]
                prints = np.packbits(sums > 0, axis=1)
                near = np.zeros((len(part), len(members)), bool)
                for block in range(8):
                    near |= table[block, prints[:, block]]
                for w, j in zip(*np.nonzero(near), strict=True):
                    i = members[j]
                    if int(_BITS[prints[w] ^ self.prints[i]].sum()) > RADIUS:
                        continue
                    start = int(part[w])
                    s = weighted_jaccard(np.sort(grams[start : start + count]), self.shingles[i])
                    if s >= threshold and s > found.get(int(i), (0.0,))[0]:
                        found[int(i)] = (s, start, min(size, len(ids) - start))
        return found


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of sorted multisets."""
    keys = np.union1d(a, b)
    x = np.searchsorted(a, keys, "right") - np.searchsorted(a, keys)
    y = np.searchsorted(b, keys, "right") - np.searchsorted(b, keys)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _passes(benchmark: DataFrame, n: int) -> Iterable[Callable[[], Index]]:
    """For each bounded block of ``benchmark(item_id, text)`` a function that gives its index in a worker."""
    spark, held, size = benchmark.sparkSession, [], 0

    def index(block: list) -> Callable[[], Index]:
        shared, cache = spark.sparkContext.broadcast(block), []

        def get() -> Index:
            if not cache:
                cache.append(Index(shared.value, n))
            return cache[0]

        return get

    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if len(held) >= ITEMS_A_PASS or size >= CHARS_A_PASS:
            yield index(held)
            held, size = [], 0
    if held:
        yield index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word, words for every document and benchmark item that match.

    ``docs(doc_id, text)`` is read once for each ITEMS_A_PASS items or CHARS_A_PASS
    characters of ``benchmark(item_id, text)``; workers and driver hold one such block of
    items at a time.  Null and empty texts and items match nothing; items shorter than
    ``n`` words are one shingle; repeated rows of either table return repeatedly.
    """
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word int, words int"

    def one_pass(index: Callable[[], Index]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                rows: list[list] = [[] for _ in range(5)]
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for i, (s, start, words) in index().matches(text, threshold).items():
                        for column, value in zip(rows, (doc, index().ids[i], s, start, words), strict=True):
                            column.append(value)
                types = [batch.schema.field(0).type, item_type, pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "words"])

        return map_arrow(docs.select("doc_id", "text"), run, schema)

    found = [one_pass(index) for index in _passes(benchmark, n)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that match no item, each judged by its own text: rows that share a
    doc_id with a leaking row, or have none, stay if they are clean.  Rows pass through whole
    and are not exchanged."""
    text = docs.columns.index("text")

    def clean(index: Callable[[], Index]):
        def run(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                yield batch.filter(pa.array([not index().matches(t, threshold) for t in batch.column(text).to_pylist()], pa.bool_()))

        return run

    out = docs
    for index in _passes(benchmark, n):
        out = map_arrow(out, clean(index), docs.schema)
    return out
