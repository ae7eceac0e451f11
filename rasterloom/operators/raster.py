"""Rasters in long form: resize, blur, padding, windows, overlays, colours; numpy kernels for the rest."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def resize_nearest(px: DataFrame, image: str, value: str, old: int, new: int) -> DataFrame:
    """Nearest-exact on a square raster: source index floor((i + 0.5) old / new), the inverse as an equi-join."""
    spark = px.sparkSession
    side = spark.range(new).select(F.col("id").cast("int").alias("n"), F.floor((F.col("id") + 0.5) * old / new).cast("int").alias("o"))
    ys, xs = side.select(F.col("n").alias("ny"), F.col("o").alias("y")), side.select(F.col("n").alias("nx"), F.col("o").alias("x"))
    out = px.join(F.broadcast(ys), "y").join(F.broadcast(xs), "x")
    return out.select(image, F.col("ny").alias("y"), F.col("nx").alias("x"), value)


def axis_weights(old: int, new: int) -> list[tuple[int, int, float]]:
    """(new, old, weight) of bilinear resampling along one axis, edges clamped."""
    out = []
    for i in range(new):
        at = max((i + 0.5) * old / new - 0.5, 0.0)
        lo = min(int(at), old - 1)
        hi, f = min(lo + 1, old - 1), at - lo
        out += [(i, lo, 1 - f)] + ([(i, hi, f)] if f > 0 and hi != lo else [])
    return out


def resize_bilinear(px: DataFrame, image: str, value: str, old: int, new: int) -> DataFrame:
    """One weight-table join and sum per axis; the table has at most two rows per output index."""
    for axis, other in (("y", "x"), ("x", "y")):
        table = px.sparkSession.createDataFrame(axis_weights(old, new), f"n int, {axis} int, w double")
        px = px.join(F.broadcast(table), axis).groupBy(image, F.col("n").alias(axis), other).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return px


def blur(px: DataFrame, image: str, value: str, sigma: float = 0.6) -> DataFrame:
    """3-tap Gaussian along each axis, borders repeated."""
    side = math.exp(-0.5 / sigma**2)
    a, b = side / (1 + 2 * side), 1 / (1 + 2 * side)
    for line, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy(image, line).orderBy(along)
        v = F.col(value)
        px = px.withColumn(value, a * F.coalesce(F.lag(value).over(w), v) + b * v + a * F.coalesce(F.lead(value).over(w), v))
    return px


def flip_average(px: DataFrame, image: str, value: str, mirrored: str, width: int) -> DataFrame:
    """Mean of a prediction and the flipped prediction of the flipped image."""
    other = px.select(image, "y", (width - 1 - F.col("x")).alias("x"), F.col(mirrored).alias("__m"))
    return px.join(other, [image, "y", "x"]).withColumn(value, (F.col(value) + F.col("__m")) / 2).drop("__m")


def partition_windows(px: DataFrame, size: int) -> DataFrame:
    """Window number and place in it; a raster that size does not divide ends in partial windows."""
    return px.withColumn("wy", F.expr(f"y div {size}")).withColumn("wx", F.expr(f"x div {size}")).withColumn("iy", F.col("y") % size).withColumn("ix", F.col("x") % size)


def reflect_index(i: Column, n: int) -> Column:
    """Source index of a reflected border."""
    j = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(j >= n, 2 * (n - 1) - j).otherwise(j)


def overlay_point(px: DataFrame, u: Column, v: Column, height: int, width: int, value: str, colour: float) -> DataFrame:
    r = max(1, min(height, width) // 128)
    cx, cy = F.floor(u * width), F.floor(v * height)
    return px.withColumn(value, F.when(F.col("x").between(cx - r, cx + r) & F.col("y").between(cy - r, cy + r), colour).otherwise(F.col(value)))


def overlay_box(px: DataFrame, box: list[Column], value: str, colour: float, thick: int = 2) -> DataFrame:
    x1, y1, x2, y2 = box
    inside = F.col("x").between(x1, x2) & F.col("y").between(y1, y2)
    core = F.col("x").between(x1 + thick, x2 - thick) & F.col("y").between(y1 + thick, y2 - thick)
    return px.withColumn(value, F.when(inside & ~core, colour).otherwise(F.col(value)))


def quantise(value: Column) -> Column:
    """[0, 1] to a byte, truncated."""
    return F.greatest(F.least(value * 255, F.lit(255.0)), F.lit(0.0)).cast("int")


#: Channel means and deviations of two common preprocessors.
CHANNELS = {"imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), "bytes": ((123.675, 116.28, 103.53), (58.395, 57.12, 57.375))}


def standardise(value: Column, channel: int, table: str = "imagenet") -> Column:
    mean, std = CHANNELS[table]
    return (value - mean[channel]) / std[channel]


def destandardise(value: Column, channel: int, table: str = "imagenet") -> Column:
    mean, std = CHANNELS[table]
    return value * std[channel] + mean[channel]


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _bicubic(x: np.ndarray) -> np.ndarray:
    """The cubic kernel with slope -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((2.5 - 0.5 * x) * x - 4) * x + 2, 0.0))


#: Resampling kernels and how far they reach.
KERNELS = {"lanczos": (_lanczos, 3.0), "bicubic": (_bicubic, 2.0)}


def resample_matrix(old: int, new: int, kind: str) -> np.ndarray:
    """new x old weights along one axis: the kernel, widened when shrinking, over the old pixels it reaches, summing to 1."""
    kernel, reach = KERNELS[kind]
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * scale
    at = np.arange(old)[None, :]
    near = (at >= np.floor(centre - reach * wide + 0.5)) & (at < np.floor(centre + reach * wide + 0.5))
    weights = np.where(near, kernel((at + 0.5 - centre) / wide), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(image: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """A raster (y, x) or (y, x, channel) at another size."""
    rows, columns = resample_matrix(image.shape[0], height, kind), resample_matrix(image.shape[1], width, kind)
    return np.einsum("ij,jk...,lk->il...", rows, image.astype(float), columns)


def signed_distance(mask: np.ndarray, radius: int = 10) -> np.ndarray:
    """Steps to the mask's edge, negative inside, in half steps and cut off beyond the radius."""
    mask, cross = mask.astype(bool), ellipse(3)
    field = np.where(mask, -radius - 0.5, radius + 0.5)
    near = _spread_out(mask, cross, np.maximum, False) != _spread_out(mask, cross, np.minimum, True)
    seen = np.zeros_like(mask)
    for step in range(radius):
        fresh = near & ~seen
        field[fresh] = np.where(mask[fresh], -step - 0.5, step + 0.5)
        seen |= near
        near = _spread_out(near, cross, np.maximum, False)
    return field


def soften(mask: np.ndarray, radius: int = 10) -> np.ndarray:
    """A soft mask in [0, 1]: the blurred distance field, clipped about its zero; borders are reflected."""
    taps = np.arange(-radius, radius + 1)
    weights = np.exp(-(taps**2) / (2 * (0.3 * (radius - 1) + 0.8) ** 2))
    field, weights = signed_distance(mask, radius), weights / weights.sum()
    for axis in (0, 1):
        n = field.shape[axis]
        place = np.abs(np.arange(n)[:, None] + taps) % max(1, 2 * (n - 1))
        place = np.where(place >= n, 2 * (n - 1) - place, place)
        field = np.moveaxis((np.moveaxis(field, axis, 0)[place] * weights.reshape(1, -1, 1)).sum(axis=1), 0, axis)
    return np.clip(0.5 - field, 0, 1)


def label_regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components by union-find over runs: labels from 1, and their number."""
    h, w = mask.shape
    labels, parent = np.zeros((h, w), np.int64), [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(h):
        x = 0
        while x < w:
            if not mask[y, x]:
                x += 1
                continue
            end = x
            while end < w and mask[y, end]:
                end += 1
            above = labels[y - 1, max(0, x - 1) : end + 1] if y else np.empty(0, np.int64)
            roots = {find(int(v)) for v in np.unique(above[above > 0])}
            root = min(roots) if roots else len(parent)
            if not roots:
                parent.append(root)
            for r in roots:
                parent[r] = root
            labels[y, x:end] = root
            x = end
    roots = np.array([find(i) for i in range(len(parent))])
    names = np.unique(roots[labels[mask.astype(bool)]]) if mask.any() else np.empty(0, np.int64)
    out = np.zeros_like(labels)
    if len(names):
        out[mask.astype(bool)] = np.searchsorted(names, roots[labels[mask.astype(bool)]]) + 1
    return out, len(names)


def remove_small_regions(mask: np.ndarray, area: int, mode: str) -> tuple[np.ndarray, bool]:
    """Fill holes or drop islands below the area; if all islands are small the largest stays."""
    work = ~mask.astype(bool) if mode == "holes" else mask.astype(bool)
    labels, n = label_regions(work)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    large = sizes >= area  # a flag for each label; 0 is what is not looked at
    if large[1:].all():
        return mask.astype(bool), False
    if mode == "holes":
        large[0] = True
        return mask.astype(bool) | ~large[labels], True
    large[0] = False
    if not large.any():
        large[1 + np.argmax(sizes[1:])] = True
    return large[labels], True


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def ellipse(size: int) -> np.ndarray:
    """A round footprint of odd size whose rows end at the rounded circle."""
    r = size // 2
    reach = np.rint(np.sqrt(r * r - np.arange(-r, r + 1) ** 2.0))
    return np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]


def _around(values: np.ndarray, footprint: np.ndarray, ys: np.ndarray, xs: np.ndarray, border: float) -> np.ndarray:
    """Values under the footprint round each place, one row a place; ``border`` outside the raster."""
    r = footprint.shape[0] // 2
    dy, dx = np.nonzero(footprint)
    return np.pad(values, r, constant_values=border)[ys[:, None] + dy, xs[:, None] + dx]


def _spread_out(values: np.ndarray, footprint: np.ndarray, f, border: float) -> np.ndarray:
    """``f`` (np.maximum or np.minimum) over the footprint round every place."""
    r, (h, w) = footprint.shape[0] // 2, values.shape
    padded, out = np.pad(values, r, constant_values=border), None
    for dy, dx in zip(*np.nonzero(footprint), strict=True):
        view = padded[dy : dy + h, dx : dx + w]
        out = view if out is None else f(out, view)
    return out


def contour_ratios(mask: np.ndarray, disparity: np.ndarray, radius: int, edge: float = 0.05) -> tuple[float, float]:
    """Shares of an object's contour whose surroundings lie clearly in front of it and clearly behind it; NaN without contour.

    The contour holds the mask's pixels that closing by slightly more than its dilation
    takes away.  Own depth is the (upper) median, in 255 steps, of masked pixels within the
    radius; the surroundings' is the nearest one around that is outside the dilated mask.
    """
    mask = mask.astype(bool)
    wide = ellipse(2 * radius + 5)
    grown = _spread_out(mask, ellipse(2 * radius + 1), np.maximum, False)
    ys, xs = np.nonzero(mask & ~_spread_out(grown, wide, np.minimum, True))
    if not len(ys):
        return float("nan"), float("nan")
    steps = np.where(mask, (disparity * 255).astype(np.uint8).astype(np.int64), 256)
    ranked = np.sort(_around(steps, disk(radius), ys, xs, 256), axis=1)
    own = ranked[np.arange(len(ys)), (ranked < 256).sum(axis=1) // 2] / 255
    other = _around(np.where(grown, 0.0, disparity), wide, ys, xs, 0.0).max(axis=1)
    return float((other - own > edge).mean()), float((own - other > edge).mean())
