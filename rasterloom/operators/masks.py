"""Binary masks in long form (image, y, x, flag): boxes, areas, run lengths, stability, morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import codecs


def mask_boxes(px: DataFrame, image: str, flag: Column) -> DataFrame:
    """Inclusive x1, y1, x2, y2 and area per image; an empty mask has zeros."""
    edge = lambda f, c: F.coalesce(f(F.when(flag, F.col(c))), F.lit(0)).cast("int")
    return px.groupBy(image).agg(edge(F.min, "x").alias("x1"), edge(F.min, "y").alias("y1"), edge(F.max, "x").alias("x2"), edge(F.max, "y").alias("y2"), F.count_if(flag).alias("area"))


def stability(px: DataFrame, image: str, logit: Column, threshold: float = 0.0, offset: float = 1.0) -> DataFrame:
    """Pixels above threshold + offset over pixels above threshold - offset; null if there are none."""
    high, low = F.count_if(logit > threshold + offset), F.count_if(logit > threshold - offset)
    return px.groupBy(image).agg(F.try_divide(high.cast("double"), low.cast("double")).alias("stability"))


def rle_encode(px: DataFrame, image: str, flag: Column, height: int) -> DataFrame:
    """Column-major run lengths; the first counts zeros and is 0 if the first pixel is set.
    Runs are islands of equal flags, found from each image's sorted pixels in one array."""
    item = F.struct((F.col("x") * height + F.col("y")).alias("p"), F.coalesce(flag, F.lit(False)).alias("f"))
    bits = px.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["f"]).alias("b"))
    starts = "filter(sequence(0, size(b) - 1), i -> if(i = 0, true, b[i] != b[greatest(i - 1, 0)]))"
    runs = bits.select(image, F.col("b"), F.expr(f"concat({starts}, array(size(b)))").alias("s"))
    counts = F.expr("zip_with(slice(s, 2, size(s) - 1), slice(s, 1, size(s) - 1), (a, b) -> a - b)")
    return runs.select(image, F.when(F.expr("b[0]"), F.concat(F.array(F.lit(0)), counts)).otherwise(counts).alias("counts"))


def rle_decode(rle: DataFrame, image: str, height: int) -> DataFrame:
    """(image, y, x) of every set pixel."""
    runs = rle.select(image, F.posexplode("counts").alias("i", "n"))
    ends = runs.withColumn("end", F.sum("n").over(W.partitionBy(image).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    p = ends.where("i % 2 = 1 and n > 0").select(image, F.explode(F.expr("sequence(end - n, end - 1)")).alias("p"))
    return p.select(image, F.expr(f"p % {height}").alias("y"), F.expr(f"p div {height}").alias("x"))


def from_annotations(records: DataFrame, image: str, json: str, height: int) -> DataFrame:
    """(image, y, x) of every set pixel of masks in annotation JSON, whose run lengths are text."""
    segmentation = F.from_json(json, "segmentation struct<size:array<int>,counts:string>")["segmentation"]
    return rle_decode(codecs.from_text_counts(records.select(image, segmentation["counts"].alias("text")), image), image, height)


def object_measures(px: DataFrame, image: str, flag: Column, disparity: str) -> DataFrame:
    """x, y, w, h of an image's mask, and its mean disparity over the image's largest."""
    edge = lambda f, c: f(F.when(flag, F.col(c)))
    near = F.avg(F.when(flag, F.col(disparity))) / F.max(disparity)
    sides = [(edge(F.max, c) - edge(F.min, c) + 1).alias(n) for c, n in (("x", "w"), ("y", "h"))]
    return px.groupBy(image).agg(edge(F.min, "x").alias("x"), edge(F.min, "y").alias("y"), *sides, near.alias("near"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0), lambda a, c: a + c)


def _pool(px: DataFrame, image: str, value: str, radius: int, f) -> DataFrame:
    """Square window extremum, one axis after the other."""
    for line, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy(image, line).orderBy(along).rowsBetween(-radius, radius)
        px = px.withColumn(value, f(value).over(w))
    return px


def dilate(px: DataFrame, image: str, value: str, radius: int) -> DataFrame:
    return _pool(px, image, value, radius, F.max)


def erode(px: DataFrame, image: str, value: str, radius: int) -> DataFrame:
    """Outside the image counts as set."""
    return _pool(px, image, value, radius, F.min)


def contained_nms(masks: DataFrame, image: str, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """``masks(image, mask_id, pixels)``: by falling area, then id, a mask stays unless more than the
    threshold of its own pixels lies in a kept one.  Columns to ``carry`` come with the masks that stay."""
    carry = carry or []
    item = F.struct((-F.size("pixels")).alias("s"), F.col("mask_id").alias("k"), F.col("pixels").alias("px"), *carry)
    folded = masks.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("a"))
    inside = "coalesce(try_divide(cast(size(array_intersect(q.px, b.px)) as double), size(b.px)), 0D)"
    keep = F.expr(f"aggregate(a, slice(a, 1, 0), (acc, b) -> if(exists(acc, q -> {inside} > {threshold}D), acc, concat(acc, array(b))))")
    return folded.select(image, F.explode(keep).alias("b")).select(image, F.col("b.k").alias("mask_id"), *[f"b.{c}" for c in carry])
