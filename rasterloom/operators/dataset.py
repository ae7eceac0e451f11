"""Dataset views: dense index, shard, gather, replicate, random order, sub-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dense_index(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Add the 0-based place in the given order without a single-task sort: buckets between splitters
    are numbered by themselves and moved up by the sizes of those before (one count a bucket).
    Splitters come from one value for each of 4096 hash classes of the first column, the same on every run."""
    n, first = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(order[0])
    chosen = df.select(first.alias("v")).where("v is not null").groupBy(F.pmod(F.xxhash64("v"), F.lit(4096))).agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    values = sorted(r["v"] for r in chosen.collect())
    splitters = sorted({values[len(values) * i // n] for i in range(1, n)}) if values else []
    bucket = F.lit(0)
    for s in splitters:
        bucket = bucket + F.coalesce((first >= F.lit(s)).cast("int"), F.lit(0))
    dealt = df.withColumn("__p", bucket)
    counts = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}
    starts, at = [], 0
    for p in range(len(splitters) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__p") + 1)
    within = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn(name, within + before).drop("__p")


def part(df: DataFrame, total: int, index: int, name: str = "row_idx") -> DataFrame:
    """Strided shard."""
    return df.where(F.col(name) % total == index)


def subset(df: DataFrame, indices: DataFrame, name: str = "row_idx") -> DataFrame:
    """Positional gather: ``indices(pos, idx)`` keeps order and duplicates in ``pos``."""
    return indices.join(df, indices["idx"] == df[name]).drop("idx")


def replicate(df: DataFrame, times: int, name: str = "view_idx") -> DataFrame:
    """Every row ``times`` times, numbered."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def random_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A sort key that shuffles rows the same way on every run."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))


def sub_batch(df: DataFrame, size: int, name: str = "row_idx") -> DataFrame:
    """Batch number and place within it."""
    return df.withColumn("batch", F.expr(f"{name} div {size}")).withColumn("in_batch", F.col(name) % size)
