"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import store

#: Rows of a shard that one task permutes.
BLOCK_ROWS = 16_384


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard.

    Row sums are the partitions' sizes, column sums the shards' (at most one apart), and
    the matrix is drawn as a uniform random permutation of all rows would draw it.
    """
    rng = np.random.default_rng(seed)
    total = sum(rows)
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows):
        left = int(room.sum())
        for j in range(shards):  # marginals in turn, each exact
            if n <= 0:
                break
            rest = left - int(room[j])
            take = _hypergeometric(rng, int(room[j]), rest, n)
            out[i, j] = take
            n -= take
            left = rest
        room -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw by inversion, to double precision, for populations of any size.

    Weights relative to the mode come from the ratio of neighbours; beyond 12 deviations
    and 40 places they are below 1e-30 of the whole.
    """
    low, high, total = max(0, n - bad), min(good, n), good + bad
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 40 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs(doc_id, text)``.

    The law is ``rows``: shard sizes differ by one row at most, and every assignment of
    rows to (shard, slot) is equally likely up to the hash that stands for random numbers.
    Partitions permute their rows, send the drawn counts, and each shard permutes what it
    got; slots count from 0 without gaps.  Size is the text's UTF-8 bytes plus 8, null
    text having none.  Rows count one by one: equal texts and repeated rows may part.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = store.written(rows, "rows")
    sizes = [(r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    total = sum(n for _, n in sizes)
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    table = spark.createDataFrame([(p, [int(x) for x in e]) for (p, _), e in zip(sizes, ends, strict=True)], "part int, ends array<long>")
    local = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")) - 1
    sent = rows.withColumn("turn", local).join(table, "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("turn")))).drop("ends", "turn", "part")
    sent = store.written(sent.withColumn("key", F.xxhash64(F.lit(seed + 1), "rid")), "sent")
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    bucket = F.expr(f"cast(floor((cast(key as decimal(20,0)) + 9223372036854775808) * {blocks} / 18446744073709551616) as int)")
    placed = store.with_rank(sent, ["shard"], bucket, [F.col("key"), F.col("rid")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
