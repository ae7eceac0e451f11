"""Making the package importable in Python workers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions pickled by name load there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
        context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` whose function may live in this package.  Workers outlive their tasks, so each
    task gives freed memory back when it ends."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Return this process's free memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def shared_file(spark: SparkSession, path: str, most: int = 64 << 20):
    """The bytes of one file, read once by Spark's readers and broadcast; a larger file than ``most`` is an error."""
    file = spark.read.format("binaryFile").load(path)
    length = file.select("length").first()["length"]
    if length > most:
        raise ValueError(f"{path} has {length} bytes, more than {most}")
    return spark.sparkContext.broadcast(bytes(file.select("content").first()["content"]))
