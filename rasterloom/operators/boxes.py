"""Boxes, crops, point grids and their filters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def xyxy_to_xywh(x1, y1, x2, y2) -> list[Column]:
    return [F.col(x1).alias("x"), F.col(y1).alias("y"), (F.col(x2) - F.col(x1)).alias("w"), (F.col(y2) - F.col(y1)).alias("h")]


def uncrop(box: list[str], x0: Column, y0: Column) -> list[Column]:
    return [(F.col(c) + (x0 if i % 2 == 0 else y0)).alias(c) for i, c in enumerate(box)]


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], tolerance: float = 20.0) -> Column:
    """True if any side lies within the tolerance of the crop's edge and not of the image's."""
    hit = F.lit(False)
    for b, c, o in zip(box, crop, image, strict=True):
        hit = hit | ((F.abs(b - c) <= tolerance) & ~(F.abs(b - o) <= tolerance))
    return hit


def is_background(w: Column, h: Column, width: Column, height: Column, ratio: float = 0.8) -> Column:
    return (h > height * ratio) & (w > width * ratio)


def crop_boxes(spark: SparkSession, width: int, height: int, layers: int, overlap: float) -> DataFrame:
    """(layer, x1, y1, x2, y2): the whole image, then 4**(i+1) overlapping crops for each layer."""
    layer = spark.range(layers).select(F.col("id").alias("i")).withColumn("n", F.expr("cast(power(2, i + 1) as int)"))
    short = min(width, height)
    layer = layer.withColumn("ov", F.expr(f"cast({overlap}D * {short} * (2D / n) as int)"))
    for c, size in (("cw", width), ("ch", height)):
        layer = layer.withColumn(c, F.expr(f"cast(ceil((ov * (n - 1) + {size}) / n) as int)"))
    cells = layer.withColumn("kx", F.expr("explode(sequence(0, n - 1))")).withColumn("ky", F.expr("explode(sequence(0, n - 1))"))
    cells = cells.select((F.col("i") + 1).cast("int").alias("layer"), F.expr("(cw - ov) * kx").alias("x1"), F.expr("(ch - ov) * ky").alias("y1"), "cw", "ch")
    cells = cells.select("layer", "x1", "y1", F.least(F.col("x1") + F.col("cw"), F.lit(width)).alias("x2"), F.least(F.col("y1") + F.col("ch"), F.lit(height)).alias("y2"))
    whole = spark.createDataFrame([(0, 0, 0, width, height)], "layer int, x1 int, y1 int, x2 int, y2 int")
    return whole.union(cells)


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """(idx, x, y) of n by n cell centres, x fastest."""
    return spark.range(n * n).select(F.col("id").alias("idx"), ((F.col("id") % n + 0.5) / n).alias("x"), ((F.expr(f"id div {n}") + 0.5) / n).alias("y"))


def longest_side(h: Column, w: Column, target: int) -> list[Column]:
    scale = F.lit(float(target)) / F.greatest(h, w)
    return [(v * scale + 0.5).cast("int").alias(n) for v, n in ((h, "new_h"), (w, "new_w"))]


def to_multiple(value: Column, multiple: int, least: int = 0, most: int | None = None) -> Column:
    """Nearest multiple, half to even; floored if above ``most``, raised if below ``least``."""
    out = F.bround(value / multiple) * multiple
    if most is not None:
        out = F.when(out > most, F.floor(value / multiple) * multiple).otherwise(out)
    return F.when(out < least, F.ceil(value / multiple) * multiple).otherwise(out).cast("int")


def iou(a: str, b: str) -> str:
    """SQL text of the IoU of two structs with x1, y1, x2, y2."""
    inter = f"greatest(0D, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0D, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda s: f"({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1)"
    return f"coalesce(try_divide({inter}, {area(a)} + {area(b)} - {inter}), 0D)"


def nms(boxes: DataFrame, image: str | list[str], threshold: float, score: str = "score", key: str = "mask_id") -> DataFrame:
    """Greedy non-maximum suppression per image: by falling score, then key, a box stays unless its IoU
    with a kept one exceeds the threshold.  A group is folded as one array: images hold few boxes."""
    by = [image] if isinstance(image, str) else image
    item = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    folded = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("a"))
    keep = F.expr(f"aggregate(a, slice(a, 1, 0), (acc, b) -> if(exists(acc, q -> {iou('q', 'b')} > {threshold}D), acc, concat(acc, array(b))))")
    return folded.select(*by, F.explode(keep).alias("b")).select(*by, F.col("b.k").alias(key))


def nms_across_crops(boxes: DataFrame, image: str, crop: str, area: str, threshold: float, key: str = "mask_id") -> DataFrame:
    """Suppression over all crops of an image, in the image's coordinates: boxes of smaller crops come first.
    An image whose boxes are all of one crop keeps them."""
    several = F.size(F.collect_set(crop).over(W.partitionBy(image))) > 1
    marked = boxes.withColumn("__several", several).withColumn("__score", 1.0 / F.col(area))
    met = nms(marked.where("__several"), image, threshold, "__score", key)
    return met.unionByName(marked.where("not __several").select(image, key))


def nms_after_cleanup(boxes: DataFrame, image: str, changed: str, threshold: float, key: str = "mask_id") -> DataFrame:
    """Suppression once small regions are gone: boxes of masks that did not change come first."""
    return nms(boxes.withColumn("__score", F.when(F.col(changed), 0.0).otherwise(1.0)), image, threshold, "__score", key)


def large_object(boxes: DataFrame, image: str, area: str, order: Column, ratio: float = 0.5) -> DataFrame:
    """One box per image among those of at least ``ratio`` of its largest, picked by ``order``."""
    largest = boxes.groupBy(image).agg(F.max(area).alias("__m"))
    kept = boxes.join(largest, image).where(F.col(area) >= ratio * F.col("__m")).drop("__m")
    return kept.groupBy(image).agg(F.min_by(F.struct(*[c for c in boxes.columns if c != image]), order).alias("b")).select(image, "b.*")


def object_box_ok(x: Column, y: Column, w: Column, h: Column, height: int, width: int, least: int, slack: int = 0) -> Column:
    """Whether an object's box is large enough and keeps a 32nd of the image to every border (``slack`` more to the right and below)."""
    right, bottom = width * 31 // 32 + slack, height * 31 // 32 + slack
    at_border = (x < width // 32) | (y < height // 32) | (x + w > right) | (y + h > bottom)
    return ~(F.greatest(w, h) < least) & ~at_border
