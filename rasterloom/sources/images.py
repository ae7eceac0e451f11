"""Image and annotation directories as DataFrames, and the proxies over the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One mask record of an annotation file.
ANNOTATION = T.ArrayType(
    T.StructType(
        [
            T.StructField("segmentation", T.StructType([T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("counts", T.StringType())])),
            T.StructField("bbox", T.ArrayType(T.DoubleType())),
            T.StructField("area", T.LongType()),
            T.StructField("predicted_iou", T.DoubleType()),
            T.StructField("point_coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("stability_score", T.DoubleType()),
            T.StructField("crop_box", T.ArrayType(T.DoubleType())),
        ]
    )
)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]+$", "$1")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """filename, content of ``root/images``; content is not read unless used."""
    return spark.read.format("binaryFile").load(f"{root}/images").select(stem(F.col("path")).alias("filename"), "content")


def scan_annotated(spark: SparkSession, root: str) -> DataFrame:
    """Images joined to ``root/annotations`` on the stem; bbox and crop_box as integers, also as JSON text.

    An image without annotations keeps a null list; :func:`missing` lists those.
    """
    files = spark.read.format("binaryFile").load(f"{root}/annotations")
    schema = T.StructType([T.StructField("annotations", ANNOTATION)])
    parsed = files.select(stem(F.col("path")).alias("filename"), F.from_json(F.col("content").cast("string"), schema)["annotations"].alias("annotations"))
    cast = F.transform("annotations", lambda a: a.withField("bbox", a["bbox"].cast("array<int>")).withField("crop_box", a["crop_box"].cast("array<int>")))
    out = scan_images(spark, root).join(parsed.withColumn("annotations", cast), "filename", "left")
    return out.withColumn("annotations_json", F.to_json("annotations"))


def load_images(spark: SparkSession, root: str, size: int, normalize: bool = False) -> DataFrame:
    """filename, image (row-major size x size x 3, in [0, 1] or [-1, 1]) of the PNG files of ``root/images``.

    The largest centred square is cut out and resampled by the Lanczos kernel.  Grey images
    get three channels, alpha is dropped, 16 bits count as their upper 8.
    """
    from ..operators.raster import resample
    from ..runtime import map_arrow
    from .codecs import unpack_image

    def square(data: bytes) -> np.ndarray:
        a = unpack_image(data)
        a = a[..., None] if a.ndim == 2 else a
        a = a * 255 if a.dtype == bool else a >> 8 if a.dtype == np.uint16 else a
        a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]
        half, cy, cx = min(a.shape[:2]) // 2, a.shape[0] // 2, a.shape[1] // 2
        out = resample(a[cy - half : cy + half, cx - half : cx + half], size, size)
        out = np.clip(np.rint(out), 0, 255) / 255
        return out * 2 - 1 if normalize else out

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([square(one.column(1)[0].as_py()).ravel()], pa.list_(pa.float64()))], ["filename", "image"])

    return map_arrow(scan_images(spark, root), run, "filename string, image array<double>")


def missing(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations, "filename", "left_anti")


DATASETS = {"images": scan_images, "annotated": scan_annotated}


def dataset(name: str):
    """A registered scan, or one named ``module.function``."""
    if name in DATASETS:
        return DATASETS[name]
    import importlib

    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters: img, label, p, y, x, v."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("img"), "label", F.posexplode("embedding").alias("p", "v"))
    return rows.select("img", "label", "p", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of an image (the order): img, mask_id, x1, y1, x2, y2, w, h, score."""
    from pyspark.sql import Window as W

    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    turn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    b = line.select(
        F.col("l_orderkey").alias("img"), turn.alias("mask_id"), (F.col("l_partkey") % 20).cast("double").alias("x1"), (F.col("l_suppkey") % 20).cast("double").alias("y1"),
        (1 + F.col("l_quantity")).cast("double").alias("w"), (5.0 * F.col("l_linenumber")).alias("h"), F.col("l_extendedprice").alias("score"),
    )
    return b.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))
