"""Shared scratch tables and bucketed ranking."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key's second bit is chosen by its bits from here on.
SECOND = 14


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master (tests); a cluster
    without one is an error, since executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that only finished, written steps used: it does so once the
    driver's garbage is collected, which a long job with little garbage may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def with_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column], rank: str) -> DataFrame:
    """Add ``rank``: the gapless 0-based place of each row in its group, ordered by bucket, then ``order``.

    A group of any size is numbered by many tasks: rows are numbered within (group,
    bucket) and moved up by the sizes of the buckets before.  ``df`` is read twice, so
    pass a written table.
    """
    b, first = f"__b_{rank}", f"__f_{rank}"
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn(first, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    keys = [*group, b]
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    other = starts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], first)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = numbered.join(other, on)
    return joined.withColumn(rank, F.col(rank) + F.col(first)).drop(b, first, *[f"__k_{k}" for k in keys])


def repeated_bitmap(keys: DataFrame, rows: int, max_bits: int = 1 << 28) -> np.ndarray:
    """A bit set of the int64 column ``key``; false positives only, and a size bound of ``max_bits``.

    A key sets two bits.  The set has 16 bits a row or more, between 2**16 and
    ``max_bits`` (32 MB); beyond that it fills up and lets more keys through, which costs
    work in proportion to the input and changes no result.
    """
    bits = 1 << 16
    while bits < min(max_bits, 16 * rows):
        bits *= 2
    both = keys.select(F.explode(F.array("key", F.expr(f"shiftright(key, {SECOND})"))).alias("key"))
    cell = F.expr(f"shiftright(key & {bits - 1}L, 6)").alias("cell")
    one = F.expr("shiftleft(1L, cast(key & 63 as int))").alias("one")
    got = both.select(cell, one).groupBy("cell").agg(F.expr("bit_or(one)").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 ``keys`` may be in the set."""

    def one(low: np.ndarray) -> np.ndarray:
        low = low & np.uint64(bitmap.size * 64 - 1)
        return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0

    return one(keys) & one(keys >> np.uint64(SECOND))
