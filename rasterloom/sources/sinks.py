"""Columnar sinks: one row per view or per image, key-value archives, contact sheets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .codecs import pack_image


def single_view(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the named columns; a missing one is an error when the plan is built."""
    return df.select(*columns)


def write_views(df: DataFrame, path: str, columns: list[str], by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write exactly the named columns as Parquet, one folder for each value of ``by``."""
    single_view(df, columns).write.mode(mode).partitionBy(*(by or [])).parquet(path)


def multi_view(df: DataFrame, key: str, once: list[str], per_view: list[str], view: str = "view_idx") -> DataFrame:
    """One row per image: first values of ``once``, arrays over views in order of the rest."""
    folded = df.groupBy(key).agg(*[F.first(c).alias(c) for c in once], F.array_sort(F.collect_list(F.struct(view, *per_view))).alias("__v"))
    return folded.select(key, *once, *[F.col("__v")[c].alias(c) for c in per_view])


def stretch_scalar(length: Column, area: Column) -> Column:
    return F.when(area < 0, length).otherwise(F.lit(0.0))


def depth16(depth: Column) -> Column:
    """Depth times 256 as an unsigned 16-bit value."""
    return F.greatest(F.least((depth * 256).cast("int"), F.lit(65535)), F.lit(0))


def sheet_position(place: Column, columns: int) -> list[Column]:
    return [F.floor(place / columns).cast("int").alias("row"), (place % columns).cast("int").alias("col")]


def encode_rasters(rows: DataFrame, height: int, width: int) -> DataFrame:
    """``rows(id, values array<double> in [0, 1])`` -> id and an 8-bit PNG."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            images = [pack_image(np.clip(np.array(v).reshape(height, width) * 255, 0, 255).astype(np.uint8)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["id", "png"])

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, png binary")


def archive(df: DataFrame, key: str) -> DataFrame:
    """Key, path, value rows of a row's columns: the entries of a zip, kept columnar."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in df.columns if c != key]))
    return df.select(key, entries.alias("e")).select(key, "e.*")
