"""New image files through the same batch nodes, by file-source streaming.

An extension: the batch nodes are unchanged and each micro-batch of files is one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.pipeline import Pipeline


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def run_available(stream: DataFrame, pipeline: Pipeline, out: str, checkpoint: str) -> None:
    """Process what is there, once: each batch goes to its own folder, so a repeated batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
