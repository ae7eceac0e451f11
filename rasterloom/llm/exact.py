"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store

#: Bytes of the text that splitters compare before its hash; the sort itself compares whole texts.
SPLITTER_BYTES = 24
#: Rows in a batch of results, about.
ROWS = 10_000


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs(doc_id, text)``.

    Texts are equal when identical (null counts as empty); of each group the row with the
    smallest or largest doc_id stays.  Sampled splitters range-partition the rows on the
    beginning of the text, its hash and the doc_id, so a group of any size spreads over
    tasks; an external sort places equal texts next to each other, and neighbours are
    compared in full.  A task counts each run of equal texts once and gives its rows the
    size and the first doc_id; only runs of a task's first and last hash, which may cross a
    splitter, meet again by digest, two hashes a task.  Of repeated rows with one doc_id exactly one stays;
    a null doc_id stays only if the group has no other.
    """
    sign = -1 if keep == "largest" else 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    turn = F.col("doc_id").desc_nulls_last() if sign < 0 else F.col("doc_id").asc_nulls_last()
    rows = docs.select("doc_id", text.alias("text")).withColumn("head", F.substring("text", 1, SPLITTER_BYTES)).withColumn("hash", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "head", "hash", turn).sortWithinPartitions("head", "hash", "text", turn)

    def whole_runs(batches: Iterable[pa.RecordBatch]):
        """Digest, doc_ids and whether it may cross a splitter, of each run."""
        opened = last = hashed = None
        held: list = []  # the runs of the present hash
        for batch in batches:
            ids, texts, hashes = batch.columns
            if not len(texts):
                continue
            new = [0, *(i for i, same in enumerate(pc.equal(texts[1:], texts[:-1]).to_pylist(), 1) if not same)]
            for start, end in zip(new, [*new[1:], len(texts)], strict=True):
                text, h = texts[start].as_py(), hashes[start].as_py()
                if h != hashed:
                    yield from ((d, pa.concat_arrays(parts), hashed == opened) for d, parts in held)
                    opened = h if hashed is None else opened
                    hashed, held, last = h, [], None
                if text != last:
                    held.append((hashlib.sha256(text.encode()).hexdigest(), []))
                held[-1][1].append(ids.slice(start, end - start))
                last = text
        yield from ((d, pa.concat_arrays(parts), True) for d, parts in held)

    def rows_of(parts: list) -> pa.RecordBatch:
        ids, digests, heads, borders, sizes, firsts = zip(*parts, strict=True)
        lengths = [len(x) for x in ids]
        of = pa.array(np.repeat(np.arange(len(ids)), lengths))
        head = np.zeros(sum(lengths), bool)
        head[np.cumsum([0, *lengths[:-1]])] = heads
        columns = [pa.array(digests).take(of), pa.array(head), pa.array(borders).take(of), pa.array(sizes, pa.int64()).take(of), pa.array(firsts, ids[0].type).take(of)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["doc_id", "text_sha256", "head", "border", "run_size", "run_id"])

    def run(batches: Iterable[pa.RecordBatch]):
        parts, n = [], 0
        for digest, ids, border in whole_runs(batches):
            first = ids[0].as_py()  # the order makes it the extreme one
            for at in range(0, len(ids), ROWS):
                parts.append((ids.slice(at, ROWS), digest, at == 0, border, len(ids), first))
                n += len(parts[-1][0])
                if n >= ROWS:
                    yield rows_of(parts)
                    parts, n = [], 0
        if parts:
            yield rows_of(parts)

    schema = f"doc_id {kind}, text_sha256 string, head boolean, border boolean, run_size long, run_id {kind}"
    runs = map_arrow(ordered.select("doc_id", "text", "hash"), run, schema)
    runs = store.written(runs.withColumn("task", F.spark_partition_id()), "runs")
    pick = F.max("run_id") if sign < 0 else F.min("run_id")
    ends = runs.where("border and head").groupBy("text_sha256").agg(F.sum("run_size").alias("size"), pick.alias("id"), F.min("task").alias("first"))
    joined = runs.join(F.broadcast(ends.withColumn("border", F.lit(True))), ["text_sha256", "border"], "left")
    size, keep_id = F.coalesce("size", "run_size"), F.when(F.col("size").isNull(), F.col("run_id")).otherwise(F.col("id"))
    kept = F.col("head") & (F.col("first").isNull() | (F.col("task") == F.col("first")))
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")
