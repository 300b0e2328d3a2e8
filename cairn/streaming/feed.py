"""The change feed as a stream: each micro-batch is projected and written as a generation of changes.

The reference has no streams; this is how incremental builds look on Spark. State is a dedup of change
ids within the watermark; a batch is idempotent, as its folder is named by the batch id.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.rules import git_status

DELTAS = "change_id bigint, ts timestamp, code string, path string, old_path string"


def read_changes(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Changes from Parquet files, each id once within the watermark."""
    x = spark.readStream.schema(DELTAS).parquet(folder)
    return x.withWatermark("ts", late).dropDuplicatesWithinWatermark(["change_id"]).withColumn("status", git_status(F.col("code")))


def windowed_counts(changes: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Changes by status and window."""
    return changes.groupBy(F.window("ts", length), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def write_generations(changes: DataFrame, files: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Maps each batch to known files (by path, else by old path) and writes it under batch=N."""
    by_path = files.select(F.col("relative_path").alias("path"), F.col("id").alias("file_id"))
    by_old = files.select(F.col("relative_path").alias("old_path"), F.col("id").alias("old_id"))

    def one(batch: DataFrame, n: int) -> None:
        x = batch.join(by_path, "path", "left").join(by_old, "old_path", "left").withColumn("file_id", F.coalesce("file_id", "old_id")).drop("old_id")
        x.write.mode("overwrite").parquet(os.path.join(folder, f"batch={n}"))

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
