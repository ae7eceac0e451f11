"""Depth maps in long form: alignment, normalisation, encodings, discontinuities, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def align(px: DataFrame, group: list[str], reference: str, moved: str, mask: Column) -> DataFrame:
    """Scale ``moved`` by the ratio of masked means, per group; null where no pixel is masked."""
    ratio = F.try_divide(F.avg(F.when(mask, F.col(reference))), F.avg(F.when(mask, F.col(moved)))).alias("ratio")
    return px.join(px.groupBy(*group).agg(ratio), group).withColumn(moved, F.col(moved) * F.col("ratio")).drop("ratio")


STATISTICS = {
    "median": lambda v: F.expr(f"percentile_disc(0.5) within group (order by {v})"),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
}


def normalise(px: DataFrame, group: list[str], value: str, by: str) -> DataFrame:
    """Divide by the group's statistic (the median is the lower one); null for zero."""
    stat = px.groupBy(*group).agg(STATISTICS[by](value).alias("stat"))
    return px.join(stat, group).withColumn(value, F.try_divide(F.col(value), F.col("stat"))).drop("stat")


def min_max(px: DataFrame, group: list[str], value: str) -> DataFrame:
    stat = px.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    return px.join(stat, group).withColumn(value, scaled).drop("lo", "hi")


def near_plane(px: DataFrame, group: list[str], value: str, mask: Column) -> DataFrame:
    return px.groupBy(*group).agg(F.least(F.min(F.when(mask, F.col(value)).otherwise(1e10)), F.lit(1.0)).alias("near"))


def z_buffer(value: Column, near: Column, far: float = 5.0) -> Column:
    z = (1.0 / near - 1.0 / value) / (1.0 / near - 1.0 / far)
    return F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0))


def discontinuity(px: DataFrame, image: str, value: str, atol: float = 0.2, rtol: float = 0.2, most: int = 3) -> DataFrame:
    """Count, over the 8 neighbours, jumps in both depth and inverse depth; ``smooth`` if fewer than ``most``."""
    v = F.greatest(F.col(value), F.lit(1e-6))
    px = px.withColumn("__v", v).withColumn("__s", F.col("x") + F.col("y")).withColumn("__d", F.col("x") - F.col("y"))
    flags = F.lit(0)
    for line in ("y", "x", "__s", "__d"):
        w = W.partitionBy(image, line).orderBy("x" if line != "x" else "y")
        for step in (F.lag("__v"), F.lead("__v")):
            other = step.over(w)
            jump = (F.abs(F.col("__v") - other) > atol) & (F.abs(1.0 / F.col("__v") - 1.0 / other) > rtol)
            flags = flags + F.when(jump, 1).otherwise(0)
    return px.withColumn("flags", flags).withColumn("smooth", F.col("flags") < most).drop("__v", "__s", "__d")


def metrics(px: DataFrame, group: list[str], truth: str, guess: str) -> DataFrame:
    """a1 a2 a3, abs_rel, sq_rel, rmse, rmse_log, silog, log_10 of positive depths."""
    g, p = F.col(truth), F.col(guess)
    ratio, e = F.greatest(g / p, p / g), F.ln(p) - F.ln(g)
    share = [F.avg((ratio < 1.25**k).cast("double")).alias(f"a{k}") for k in (1, 2, 3)]
    spread = F.sqrt(F.greatest(F.avg(e * e) - F.avg(e) * F.avg(e), F.lit(0.0))) * 100
    return px.groupBy(*group).agg(
        *share,
        F.avg(F.abs(g - p) / g).alias("abs_rel"),
        F.avg((g - p) * (g - p) / g).alias("sq_rel"),
        F.sqrt(F.avg((g - p) * (g - p))).alias("rmse"),
        F.sqrt(F.avg(e * e)).alias("rmse_log"),
        spread.alias("silog"),
        F.avg(F.abs(F.log10(g) - F.log10(p))).alias("log_10"),
    )


#: Evaluation crops as (top, bottom, left, right); shares of the size, or pixels.
CROPS = {
    "garg": (0.40810811, 0.99189189, 0.03594771, 0.96405229),
    "eigen_kitti": (0.3324324, 0.91351351, 0.0359477, 0.96405229),
    "eigen_nyu": (45, 471, 41, 601),
}


def in_crop(name: str, height: int, width: int) -> Column:
    top, bottom, left, right = (int(v) if name == "eigen_nyu" else int(v * s) for v, s in zip(CROPS[name], (height, height, width, width), strict=True))
    return (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)


def valid(truth: Column, least: float, most: float) -> Column:
    return (truth > least) & (truth < most)


def clamp_prediction(guess: Column, least: float, most: float) -> Column:
    """Infinite to the greatest, NaN and too small to the least."""
    return F.when(F.isnan(guess), least).otherwise(F.greatest(F.least(guess, F.lit(most)), F.lit(least)))
