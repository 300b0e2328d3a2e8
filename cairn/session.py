"""Tables of a folder, and frames that are pinned to files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset and Spark is one process: a folder that goes with the process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: whatever reads it sees the same rows, and lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
