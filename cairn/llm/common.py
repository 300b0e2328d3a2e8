"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What Spark has where nobody chose.
DEFAULT_BYTES = ("67108864b", "67108864", "64MB")
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, and get texts in small batches.

    Both hold for the session; a batch size that somebody set stays.
    """
    if spark.conf.get(BATCH_BYTES, None) in (None, *DEFAULT_BYTES):
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.

    Where it is unset and Spark is one process (tests): a folder of our own, which goes with the process.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def id_kind(df: DataFrame, name: str) -> str:
    """The type in which an operator carries an id: bigint for whole numbers, else string (UUIDs, URLs and the like)."""
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    return "bigint" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"


class Columns:
    """A frame whose columns go by position, so that no input name can clash with one of ours."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def has(self, name: str) -> bool:
        return name in self.names

    def at(self, name: str) -> str:
        if name not in self.names:
            raise ValueError(f"there is no column {name!r} among {self.names}")
        return f"c{self.names.index(name)}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self.at(name))

    def pick(self, *names: str) -> DataFrame:
        """Only these columns, under their own names."""
        return self.df.select(*[self[n].alias(n) for n in names])

    def restore(self, df: DataFrame, **added: Column | str) -> DataFrame:
        """The input's columns under their own names again, then the added ones.

        An input column with the name of an added one (in any case) gives way to it.
        """
        taken = {k.lower() for k in added}
        kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*kept, *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in added.items()])


def lean(run: Callable) -> Callable:
    """A task function that gives its memory back at its end: workers live on and would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (a longer text is a part of its own)."""
    col = batch.column(text)
    n = batch.num_rows
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + n + 1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(ends, int(ends[start]) + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.ListArray:
    """A list column from flat values and the length of each list; where valid is false the list is null."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
    if valid is not None and not valid.all():
        bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        out = pa.ListArray.from_buffers(pa.list_(kind), len(sizes), [bits, out.buffers()[1]], children=[out.values])
    return out
