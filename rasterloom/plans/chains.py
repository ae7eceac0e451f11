"""Whole chains of operators over frames of images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import boxes, masks, predict
from ..runtime import map_arrow
from ..sources import codecs

BOX = ["x1", "y1", "x2", "y2"]


def numbered_crops(spark, width: int, height: int, layers: int, overlap: float) -> DataFrame:
    """The crops of an image with a number from 0 by layer, row and column; a handful of rows, whatever the images."""
    crops = boxes.crop_boxes(spark, width, height, layers, overlap)
    turn = F.row_number().over(W.orderBy("layer", "y1", "x1")) - 1
    return crops.select(turn.alias("crop"), *[F.col(c).alias(f"c{c}") for c in BOX])


def generate_masks(
    images: DataFrame, width: int, height: int, layers: int, overlap: float, threshold: float, least: float = 0.88, edge: float = 20.0, iou: float = 0.7
) -> DataFrame:
    """(id, crop, mask_id, area, x1, y1, x2, y2, score) of the objects in every image of ``images(id long, values)``.

    Each image is cut into overlapping crops, each crop segmented (a stub: regions above the
    threshold); masks with a score (their share of the box) below ``least`` and those cut off
    by a crop's edge go; overlapping boxes are suppressed within each crop by score, then, in
    the image's coordinates, across crops in favour of the smaller crop.  Only boxes are
    exchanged, by image.  An image without masks has no row.
    """
    count = 1 + sum(4 ** (i + 1) for i in range(layers))
    crops = F.broadcast(numbered_crops(images.sparkSession, width, height, layers, overlap))
    cut = f"transform(sequence(0, {width * height - 1}), p -> if(p % {width} < cx2 - cx1 and p div {width} < cy2 - cy1, get(values, cast((p div {width} + cy1) * {width} + p % {width} + cx1 as int)), {threshold}D))"
    parts = images.crossJoin(crops).select((F.col("id") * count + F.col("crop")).alias("id"), F.expr(cut).alias("values"))
    found = predict.segment(parts, height, width, threshold)
    found = found.withColumn("crop", (F.col("id") % count).cast("int")).withColumn("id", F.expr(f"id div {count}")).join(crops, "crop")
    found = found.withColumn("score", F.col("area") / ((F.col("w") + 1) * (F.col("h") + 1))).where(F.col("score") >= least)
    inside = [("x1", F.col("x")), ("y1", F.col("y")), ("x2", F.col("x") + F.col("w")), ("y2", F.col("y") + F.col("h"))]
    whole = found.withColumns({n: v + F.col("cx1" if n[0] == "x" else "cy1") for n, v in inside})
    limits = [F.lit(v) for v in (0, 0, width, height)]
    whole = whole.where(~boxes.near_crop_edge([F.col(c) for c in BOX], [F.col(f"c{c}") for c in BOX], limits, edge))
    whole = whole.withColumn("mask_id", F.col("crop") * (width * height) + F.col("mask_id"))
    whole = whole.withColumn("crop_area", (F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")))
    within = whole.join(boxes.nms(whole, ["id", "crop"], iou), ["id", "crop", "mask_id"])
    kept = boxes.nms_across_crops(within, "id", "crop", "crop_area", iou)
    return within.join(kept, ["id", "mask_id"]).select("id", "crop", "mask_id", "area", *BOX, "score")


def decode(text: str, height: int, width: int) -> np.ndarray:
    """A mask out of its run lengths as text, by columns."""
    counts = codecs.unpack_counts(text)
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return flat.reshape(width, height).T


def fitted(a: np.ndarray, side: int) -> np.ndarray:
    """A raster scaled by nearest pixels until its longer side is ``side``, with zeros around it."""
    h, w = (max(1, round(n * side / max(a.shape))) for n in a.shape)
    pick = lambda old, new: ((np.arange(new) + 0.5) * old / new).astype(int)
    out, top, left = np.zeros((side, side), a.dtype), (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = a[np.ix_(pick(a.shape[0], h), pick(a.shape[1], w))]
    return out


OBJECT = "mask_id long, wx1 int, wy1 int, wx2 int, wy2 int, pixels array<int>, value array<double>, alpha array<boolean>"


def extract_objects(
    images: DataFrame, records: DataFrame, height: int, width: int, side: int, margin: int = 8, least: int = 32, radius: int = 11, contained: float = 0.7, **limits
) -> DataFrame:
    """(id, mask_id, area, window, value, alpha) of the objects that ``records(id, mask_id, json)`` mark in ``images(id, values)``.

    Disparity is predicted once an image (a stub); each annotation is decoded and tried by
    the object tests (``limits`` are those of ``predict.failed_test``); of masks inside each
    other the larger stays; the window around a kept mask, ``margin`` pixels wider, is cut out
    of the image with the mask as a further channel, both scaled to ``side``.  Null records, others
    that are no JSON, masks of another size and images without records give no row.
    Images are exchanged once, by id, and masks once more, after the tests, as windows.
    """
    seen = predict.predict(images.select("id", "values"), "disparity", height, width).withColumnRenamed("values", "disparity")
    parsed = F.from_json("json", "segmentation struct<size:array<int>,counts:string>")["segmentation"]
    marks = records.select("id", "mask_id", parsed.alias("s")).where((F.col("s.size") == F.array(F.lit(height), F.lit(width))) & F.col("s.counts").isNotNull())
    rows = images.select("id", "values").join(seen, "id").join(marks.select("id", F.col("mask_id").cast("long").alias("mask_id"), "s.counts"), "id")
    names = [c.split()[0] for c in OBJECT.split(", ")]
    longs, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
    types = [pa.int64(), *[pa.int32()] * 4, longs, floats, pa.list_(pa.bool_())]

    def run(batches):
        for b in batches:
            keep, out = [], [[] for _ in names]
            for i, (values, disparity, key, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                mask = decode(text, height, width)
                near = np.array(disparity, float).reshape(height, width)
                if predict.failed_test(mask, near / (near.max() or 1.0), radius, least, **limits):
                    continue
                y, x = np.nonzero(mask)
                x1, y1, x2, y2 = max(0, x.min() - margin), max(0, y.min() - margin), min(width, x.max() + 1 + margin), min(height, y.max() + 1 + margin)
                part = np.array(values, float).reshape(height, width)[y1:y2, x1:x2]
                keep.append(i)
                row = (key, x1, y1, x2, y2, y * width + x, fitted(part, side).ravel(), fitted(mask[y1:y2, x1:x2], side).ravel())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["id", *names])

    found = map_arrow(rows.select("id", "values", "disparity", "mask_id", "counts"), run, f"id {images.schema['id'].dataType.simpleString()}, {OBJECT}")
    kept = masks.contained_nms(found.withColumn("area", F.size("pixels")), "id", contained, ["area", *names[1:5], *names[6:]])
    window = F.struct(*[F.col(f"w{c}").alias(c) for c in BOX])
    return kept.select("id", "mask_id", "area", window.alias("window"), "value", "alpha")
