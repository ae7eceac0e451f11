"""Toxicity by compression distance.

Two Zstandard dictionaries are trained on labelled text.  The ordinary one is trained on
windows of ordinary documents.  The toxic one is trained on windows of toxic documents
without their background: of each text only the words that stand out against ordinary
documents are left, as trained on whole windows both dictionaries would hold the same
common words and their chance differences would drown the toxic ones.  The toxic
compressor has the ordinary dictionary behind its own, so that a window of ordinary words
compresses alike with both and only toxic matches make it shorter.  Both are used as raw
content, without entropy tables, for the same reason.  Per document the gains of all
windows give the largest, the mean and the total gain, and a logistic curve calibrated on
labelled documents apart from those of the dictionaries turns them into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import map_arrow

#: Bounds of the labelled sample, by class: rows for the dictionaries and for the curve.
DICTIONARY_ROWS = {1: 2000, 0: 4000}
CURVE_ROWS = {1: 800, 0: 3200}
#: Bytes of sampled texts of one class and use; what is beyond, in the order of a hash of the doc_id, is not sampled.
SAMPLE_BYTES = 24 << 20
WINDOW_WORDS = 24
#: Sizes of the trained dictionaries.
ORDINARY_BYTES = 96 * 1024
TOXIC_BYTES = 2 * 1024
LEVEL = 9
#: A word stands out if its count in toxic documents exceeds expectation by so many deviations, and so many times.
DEVIATIONS = 10.0
TIMES = 4.0
_BETWEEN = re.compile(r"[^\w]+")


def windows(text: str | None, words: int = WINDOW_WORDS) -> list[bytes]:
    parts = _BETWEEN.sub(" ", text.lower()).split() if text else []
    return [(" " + " ".join(parts[i : i + words]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(parts), words)]


def _fresh(texts: list[str]) -> Iterable[list[str]]:
    """Word lists without near copies of earlier ones, which would make chance words stand out."""
    seen: set[tuple[int, int]] = set()
    for text in texts:
        parts = _BETWEEN.sub(" ", (text or "").lower()).split()
        grams = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
        keys = [(s, min(xxhash.xxh3_64_intdigest(g, s) for g in grams)) for s in range(3)]
        if not any(k in seen for k in keys):
            yield parts
        seen.update(keys)


@dataclass
class Model:
    """Dictionaries and curve; ``score`` is pure Python and travels to the workers."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def _compressors(self):
        out = []
        for content in (self.ordinary, self.toxic):
            kept = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out

    def features(self, text: str | None) -> list[float]:
        if "_c" not in self.__dict__:
            self._c = self._compressors()
        ordinary, toxic = self._c
        gains = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
        if not gains:
            return [1.0, 0.0, 0.0, 0.0]
        return [1.0, float(max(gains)), sum(gains) / len(gains), float(np.log1p(max(0, sum(gains))))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_c"}


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    bad: Counter[str] = Counter()
    good: Counter[str] = Counter()
    n = m = 0
    for parts in _fresh(toxic):
        n += 1
        bad.update(set(parts))
    for parts in _fresh(ordinary):
        m += 1
        good.update(w for w in set(parts) if w in bad)
    m = max(1, m)

    def stands_out(w: str) -> bool:
        expected = good[w] * n / m
        return bad[w] - expected >= min(DEVIATIONS, 0.5 + n / 4) * (expected + 1) ** 0.5 and bad[w] >= TIMES * expected

    picked = {w for w in bad if stands_out(w)}
    marked = (" ".join(w for w in parts if w in picked) for parts in _fresh(toxic))
    own = _trained([w for t in marked for w in windows(t)], TOXIC_BYTES)
    base = _trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    return base, own + base


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8, steps=4).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from rows of ``docs(doc_id, text)`` with a label in ``labels(doc_id, toxic)`` outside the held-out fold.

    The sample is bounded by DICTIONARY_ROWS, CURVE_ROWS and SAMPLE_BYTES, taken in the
    order of a hash of the doc_id.  A doc_id labelled twice counts as toxic if either label
    says so, and of rows that share a doc_id the smallest text counts; null labels, null
    doc_ids and null texts are left out.  Without toxic rows every score is
    the share of toxic rows, kept within (0, 1).
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    known = known.withColumn("side", F.when(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0, "curve").otherwise("dictionary"))
    sample = None
    for side, bounds in (("dictionary", DICTIONARY_ROWS), ("curve", CURVE_ROWS)):
        for toxic, most in bounds.items():
            part = known.where((F.col("side") == side) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            sample = part if sample is None else sample.union(part)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "side", "toxic").agg(F.min("text").alias("text"))
    upto = W.partitionBy("side", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(upto)).where(F.col("bytes") <= SAMPLE_BYTES).select("side", "toxic", "text", "doc_id")

    def run(batches: Iterable[pa.RecordBatch]):
        model = _learn([r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([model.ordinary], pa.binary()), pa.array([model.toxic], pa.binary()), pa.array([model.weights], pa.list_(pa.float64()))], ["ordinary", "toxic", "weights"])

    # the bounded sample is learnt from in one task, the driver gets the dictionaries alone
    found = map_arrow(rows.repartition(1), run, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(found["ordinary"]), bytes(found["toxic"]), list(found["weights"])) if found else _learn([])


def _learn(rows: list[tuple[str, int, str, object]]) -> Model:
    """The model of sampled rows (side, toxic, text, doc_id)."""
    rows = sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(str(r[3])), str(r[3])))
    of = lambda side, toxic: [r[2] for r in rows if r[0] == side and r[1] == toxic]
    model = Model(*_dictionaries(of("dictionary", 1), of("dictionary", 0)))
    curve = [r for r in rows if r[0] == "curve"]
    if sum(r[1] for r in curve) < 5:
        curve = rows
    y = np.array([r[1] for r in curve], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.05
        model.weights = [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]
        return model
    model.weights = _curve(np.array([model.features(r[2]) for r in curve]), y)
    return model


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, whole and in place, whatever their other columns' names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]):
        score = shared.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (score >= threshold).

    Only the text is read: null and empty texts score as a document without any gain.
    Repeated rows score alike.  Columns of those names in ``docs`` are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]):
        score = shared.value.score
        for batch in batches:
            s = pa.array([score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    out = map_arrow(docs, run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
