"""Crops, points and candidate masks: windows, coordinates, choices, sizes and batches of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from . import boxes


def centre_crop(width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 of the largest centred square of even side, from whole halves."""
    half = F.floor(F.least(width, height) / 2)
    cx, cy = F.floor(width / 2), F.floor(height / 2)
    return [(c + s * half).cast("int").alias(n) for n, c, s in (("x1", cx, -1), ("y1", cy, -1), ("x2", cx, 1), ("y2", cy, 1))]


def window_round(x: Column, y: Column, w: Column, h: Column, width: int, height: int, margin: int) -> list[Column]:
    """x1, y1, x2, y2 of a box with a margin, cut off at the image's border."""
    low = lambda v: F.greatest(F.lit(0), v - margin)
    high = lambda v, most: F.least(F.lit(most), v + margin)
    return [low(x).alias("wx1"), low(y).alias("wy1"), high(x + w, width).alias("wx2"), high(y + h, height).alias("wy2")]


def object_crop(box: list[Column], width: Column, height: Column, size: int, key: Column, seed: str) -> list[Column]:
    """side, left, top of a random square around a box (x1, y1, x2, y2), all within the image and uniform over the integers allowed.

    The side is between the box's (or ``size``) and four times it, within the image; the
    square holds the box if it is large enough, else lies within the box's reach.
    """
    x1, y1, x2, y2 = box
    short, long = F.least(width, height), F.greatest(y2 - y1, x2 - x1)
    least = F.least(F.greatest(long, F.lit(size)), short)
    most = F.greatest(F.least(4 * long, short), F.lit(size))
    draw = lambda low, high, name: (low + F.floor(uniform(key, seed + name) * (high - low + 1))).cast("int")
    side = draw(least, most, "size")

    def offset(a, b, extent, name):
        return draw(F.least(F.greatest(F.lit(0), b - side), a), F.greatest(F.least(a, extent - side), b - side), name)

    return [side.alias("side"), offset(x1, x2, width, "left").alias("left"), offset(y1, y2, height, "top").alias("top")]


def in_crop(box: list[Column], left: Column, top: Column, side: Column) -> list[Column]:
    """A box in units of the crop, cut off at its border."""
    x1, y1, x2, y2 = box
    low = lambda v, at: F.greatest(F.lit(0), v - at) / side
    high = lambda v, at: F.least(side, v - at) / side
    return [low(x1, left).alias("bx1"), low(y1, top).alias("by1"), high(x2, left).alias("bx2"), high(y2, top).alias("by2")]


def layer_grids(spark: SparkSession, n: int, layers: int, scale: int) -> DataFrame:
    """(layer, idx, x, y): the point grid of each crop layer, n / scale**layer points a side."""
    out = None
    for layer in range(layers + 1):
        grid = boxes.point_grid(spark, int(n / scale**layer)).withColumn("layer", F.lit(layer))
        out = grid if out is None else out.union(grid)
    return out.select("layer", "idx", "x", "y")


def crop_points(crops: DataFrame, grids: DataFrame) -> DataFrame:
    """Points of every crop(layer, x1, y1, x2, y2) by its layer's grid, in the crop (px, py) and in the image (ix, iy)."""
    met = crops.join(F.broadcast(grids), "layer")
    px, py = F.col("x") * (F.col("x2") - F.col("x1")), F.col("y") * (F.col("y2") - F.col("y1"))
    return met.select("layer", "x1", "y1", "idx", px.alias("px"), py.alias("py"), (px + F.col("x1")).alias("ix"), (py + F.col("y1")).alias("iy"))


def uncrop_raster(px: DataFrame, image: str, value: str, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """A crop's pixels at their places in the whole raster, zeros around: arrays of rows, no exchange of pixels beyond one per image."""
    cell = F.struct(((F.col("y") + y0) * width + F.col("x") + x0).cast("int").alias("p"), F.col(value).alias("v"))
    whole = px.groupBy(image).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    every = whole.select(image, "m", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p"))
    return every.select(image, F.expr(f"p div {width}").alias("y"), (F.col("p") % width).alias("x"), F.coalesce(F.try_element_at("m", "p"), F.lit(0.0)).alias(value))


def select_mask(scores: Column, points: Column, weight: float = 1000.0) -> Column:
    """0-based place of the best mask: with more than two points the first counts less by ``weight`` a point, else more."""
    first = scores[0] + (points - 2.5) * weight
    changed = F.transform(scores, lambda s, i: F.when(i == 0, first).otherwise(s))
    return (F.array_position(changed, F.array_max(changed)) - 1).cast("int")


def multimask(masks: Column, several: Column) -> Column:
    """All masks but the first, or the first alone."""
    return F.when(several, F.slice(masks, F.lit(2), F.greatest(F.size(masks) - 1, F.lit(0)))).otherwise(F.slice(masks, 1, 1))


def resize_size(height: Column, width: Column, size: int, mode: str) -> list[Column]:
    """new_w, new_h, truncated, by the ``shorter`` or ``longer`` side, or ``square``."""
    if mode == "square":
        return [F.lit(size).alias("new_w"), F.lit(size).alias("new_h")]
    if mode not in ("shorter", "longer"):
        raise ValueError(f"unknown mode {mode}")
    scale = F.lit(float(size)) / (F.least if mode == "shorter" else F.greatest)(height, width)
    return [(v * scale).cast("int").alias(n) for n, v in (("new_w", width), ("new_h", height))]


def pad_offsets(height: Column, width: Column, target_h: int, target_w: int, mode: str = "none") -> list[Column]:
    """new_w, new_h, left, top, right, bottom; ``max_fit`` scales first, ``none`` is an error for larger images."""
    h, w = height, width
    if mode == "max_fit":
        scale = F.least(F.lit(float(target_h)) / h, F.lit(float(target_w)) / w)
        h, w = (height * scale).cast("int"), (width * scale).cast("int")
    else:
        small = (h <= target_h) & (w <= target_w)
        h, w = (F.when(small, v).otherwise(F.raise_error(F.lit("image is larger than the target")).cast("int")) for v in (h, w))
    left, top = F.floor((target_w - w) / 2).cast("int"), F.floor((target_h - h) / 2).cast("int")
    return [w.alias("new_w"), h.alias("new_h"), left.alias("left"), top.alias("top"), (target_w - w - left).alias("right"), (target_h - h - top).alias("bottom")]


def pad_square(values: Column, height: int, width: int, side: int) -> Column:
    """A row-major raster with zeros at the right and below."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.concat(F.slice(values, y * width + 1, width), F.array_repeat(F.lit(0.0), side - width)))
    return F.concat(F.flatten(rows), F.array_repeat(F.lit(0.0), (side - height) * side))


def with_alpha(values: Column, mask: Column) -> Column:
    """Each value with its mask as a further channel."""
    return F.arrays_zip(values.alias("value"), mask.alias("alpha"))


def composite(original: Column, generated: Column, hidden: Column) -> Column:
    """Generated where hidden, else the original."""
    return F.when(hidden, generated).otherwise(original)


def take(rows: DataFrame, key: str, indices: list[int]) -> DataFrame:
    """Rows by a list of row numbers ``key``, in the list's order as ``pos``, repeated as listed."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(indices)), "pos int, __key long")
    return rows.join(F.broadcast(wanted), rows[key] == F.col("__key")).drop("__key")


def concatenate(batches: list[DataFrame]) -> DataFrame:
    """Batches with the same columns in any order, one after the other, numbered by ``batch``."""
    out = None
    for i, b in enumerate(batches):
        b = b.withColumn("batch", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out


def accepted(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that are in ``names``."""
    return df.select(*[c for c in df.columns if c in names])


def checked(value: Column, choices: list[str]) -> Column:
    """The value, an error if it is none of the choices."""
    return F.when(value.isin(choices), value).otherwise(F.raise_error(F.concat(F.lit("not a choice: "), value)).cast("string"))
