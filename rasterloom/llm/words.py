"""Words of whole texts as 64-bit ids, and hashes of word sequences (numpy, Python workers)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..runtime import map_arrow

_RNG = np.random.Generator(np.random.PCG64(20240229))
_COEFFICIENTS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits on just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; empty if there are fewer."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = ids[:m] * _COEFFICIENTS[0]
    for j in range(1, n):
        out += ids[j : j + m] * _COEFFICIENTS[j]
    return mix(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Windows:
    """Hashes of any word ranges of one text in constant time each."""

    def __init__(self, ids: np.ndarray):
        up, self._down = _powers(len(ids) + 1)
        self._sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(ids * up[: len(ids)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct n-word shingles of the ASCII-lower-cased text as sorted uint64; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = word_ids(words)
    if len(ids) < n:
        return mix(gram_hashes(ids, len(ids)) + np.uint64(len(ids)))
    grams = np.sort(gram_hashes(ids, n))
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def key_bits(df: DataFrame) -> int:
    """Bits of the bucket number of :func:`repeated_keys`: 8 to 16 buckets a partition."""
    return min(30, (8 * df.rdd.getNumPartitions()).bit_length())


def short_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` + 32 bits of uint64 keys."""
    return keys >> np.uint64(32 - bits)


def repeated_keys(texts: DataFrame, keys_of: Callable[[str | None], np.ndarray], bits: int) -> DataFrame:
    """(key, n) of the short keys that occur n > 1 times over all of ``texts(text)``.

    Tasks send sorted 4-byte rests by bucket, so counting moves a few bytes for each key;
    a bucket that is counted holds the keys of a fraction of one input partition.
    """
    cut, rest = np.uint64(64 - bits), np.uint64(32 - bits)

    def send(batches: Iterable[pa.RecordBatch]):
        def blobs(held: list[np.ndarray]):
            keys = np.sort(np.concatenate(held))
            bucket = (keys >> cut).astype(np.int64)
            starts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
            rests = ((keys >> rest) & np.uint64(0xFFFFFFFF)).astype("<u4")
            blob = [rests[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blob, pa.binary())], ["bucket", "blob"])

        held, size = [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(keys_of(text))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield blobs(held)
                    held, size = [], 0
        if size:
            yield blobs(held)

    def count(batches: Iterable[pa.RecordBatch]):
        def close(bucket: int, held: list[bytes]):
            keys, times = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
            keys = keys[times > 1].astype(np.int64) | (bucket << 32)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times[times > 1].astype(np.int64))], ["key", "n"])

        bucket, held = None, []
        for batch in batches:
            for b, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if held:
                        yield close(bucket, held)
                    bucket, held = b, []
                held.append(blob)
        if held:
            yield close(bucket, held)

    sent = map_arrow(texts, send, "bucket long, blob binary")
    return map_arrow(sent.repartition("bucket").sortWithinPartitions("bucket"), count, "key long, n long")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts at once."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
