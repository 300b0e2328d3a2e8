"""Sharding by sampled splitters.

Records get an order-preserving key. A sample is drawn with a chance in proportion to a record's size,
`OVERSAMPLE` records for each shard to be; the sample's weighted quantiles are the splitters. Records are
counted against them, and a range that turned out larger than `SLACK` times the target is subdivided at
exact running sums. Then every record goes to its range's shard, sorted by key within.

Until the last step only keys and sizes move, and weights are whole numbers, so that borders don't depend on the order of a sum.
What the driver holds and broadcasts is one key for each shard (`MOST_SHARDS` of them at most: beyond, it asks for a larger
target). The last step is the one shuffle of the records, straight to the partition of their shard (no second sampling).

Defined results:
* shards are disjoint, ordered ranges of (source, doc_id): shard_id rises with the key; nulls come first;
* rows of equal (source, doc_id), null ids among them, go on by a hash of the text, so many of them are split too; only rows that
  agree in all of these stay in one shard, which can exceed the target by them; a record larger than the target is in one
  shard with its neighbours' rest;
* an empty text counts its overhead only, as does a null one; an empty table gives an empty table;
* all columns are kept; an input column called shard_id gives way to the result's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cairn.llm.common import Columns, cut_lineage, ready

TARGET_BYTES, OVERSAMPLE, SLACK, OVERHEAD = 32 << 20, 64, 1.25, 64
#: Shards beyond so many share partitions, in order.
MOST_PARTITIONS = 20_000
MOST_SHARDS = 2_000_000
SEED = 11


def order_key(c: Columns, names: tuple[str, ...]) -> Column:
    """One string that sorts as the columns do, nulls first."""
    parts = []
    for n in names:
        kind = c.df.schema[c.at(n)].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            text = F.lpad((c[n].cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
        else:
            text = F.translate(c[n].cast("string"), "\x00", "\x01")
        parts.append(F.coalesce(F.concat(F.lit("1"), text), F.lit("0")))
    return F.concat_ws("\x00", *parts)


def cut_keys(rows: DataFrame, step: int) -> list[str]:
    """Keys at which the running sum of weight, in key order, passes a multiple of step.

    Range-partitioned: each partition's sum, the sums before it, and a running sum within.
    """
    rows = cut_lineage(rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("pid", F.spark_partition_id()))
    sums = rows.groupBy("pid").agg(F.sum("weight").alias("s"))
    ahead = sums.select(F.col("pid").alias("a_pid"), F.coalesce(F.sum("s").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # Equal keys have one running sum, so it doesn't matter which of them comes first.
    until = F.sum("weight").over(W.partitionBy("pid").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    x = rows.groupBy("pid", "key").agg(F.sum("weight").alias("weight")).withColumn("inner", until).join(F.broadcast(ahead), F.col("pid") == F.col("a_pid"))
    x = x.withColumn("end", F.col("ahead") + F.col("inner"))
    passed = x.where(F.expr(f"end div {step} > (end - weight) div {step}"))
    return gathered(passed.select("key"))


def gathered(keys: DataFrame) -> list[str]:
    """Distinct keys in order, of which there is one for each shard."""
    out = sorted(r.key for r in keys.distinct().limit(MOST_SHARDS + 1).collect())
    if len(out) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards: give a larger target")
    return out


def _place(splitters: Broadcast):
    @F.pandas_udf("int")
    def run(key: pd.Series) -> pd.Series:
        cuts = splitters.value
        return pd.Series([bisect_left(cuts, k) for k in key], dtype="int32")

    return run


def _sizes(splitters: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = splitters.value
        total: dict[int, int] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = bisect_left(cuts, k)
                total[i] = total.get(i, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array(list(total.values()), type=pa.int64())], ["r", "n"])

    return run


def splitters(narrow: DataFrame, target: int) -> list[str]:
    """Sorted keys: shard i holds the keys above splitter i - 1, up to splitter i. narrow: (key, size), whole sizes."""
    sc = narrow.sparkSession.sparkContext
    # A record of `least` bytes or more is drawn for certain and stands for itself, a smaller one with chance size / least and stands for `least`.
    least = max(1, target // OVERSAMPLE)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 53)).cast("double") * F.lit(least / (1 << 53))
    sample = narrow.where(draw < F.col("size")).select("key", F.greatest(F.col("size"), F.lit(least)).cast("bigint").alias("weight"))
    keys = cut_keys(sample, target)
    shared = sc.broadcast(keys)
    sizes = narrow.mapInArrow(_sizes(shared), "r int, n bigint").groupBy("r").agg(F.sum("n").alias("n"))
    limit = int(SLACK * target)
    # As many rows at most as there are shards.
    over = sizes.where(F.col("n") > limit).select("r", F.expr(f"n div ((n + {target} - 1) div {target}) + 1").alias("step"))
    over = cut_lineage(over)
    if over.isEmpty():
        return keys
    # Only the keys of these ranges, cut at exact running sums; equal keys have equal sums.
    rows = narrow.withColumn("r", _place(shared)("key")).join(F.broadcast(over), "r").groupBy("r", "step", "key").agg(F.sum("size").alias("size"))
    rows = rows.withColumn("end", F.sum("size").over(W.partitionBy("r").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
    cut = rows.where(F.expr("end div step > (end - size) div step"))
    return sorted({*keys, *gathered(cut.select("key"))})


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, keys: tuple[str, ...] = ("source", "doc_id"), text_col: str = "text") -> DataFrame:
    """The documents and their shard_id, each shard whole and in key order within one partition."""
    ready(docs.sparkSession)
    c = Columns(docs)
    key = F.concat_ws("\x00", order_key(c, keys), F.hex(F.xxhash64(c[text_col])))
    size = (F.coalesce(F.octet_length(c[text_col]), F.lit(0)) + OVERHEAD).cast("bigint")
    narrow = cut_lineage(c.df.select(key.alias("key"), size.alias("size")))
    cuts = splitters(narrow, target_bytes)
    n = len(cuts) + 1
    parts = min(n, MOST_PARTITIONS)
    d = c.df.withColumn("s_key", key).withColumn("s_id", _place(docs.sparkSession.sparkContext.broadcast(cuts))("s_key"))
    d = d.repartitionById(parts, F.expr(f"int(s_id * {parts}L div {n}L)")).sortWithinPartitions("s_key")
    return c.restore(d, shard_id="s_id")
