"""Relational building blocks: numbering, first and last of a group, nearest folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.session import pinned


#: Bytes of the files behind a range partition: rows as Spark holds them take some ten times as much.
PART_BYTES = 8 << 20


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Range partitions by the keys, as many as the files behind the frame ask for, so that a partition's sort stays in memory."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Up to the session's number, partitions are Spark's to merge.
    return df.repartitionByRange(n, *keys) if (n := min(-(-size // PART_BYTES), 20_000)) > most else df.repartitionByRange(*keys)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds 1, 2, ... in a total order, without bringing the rows to one task."""
    return numbered_parts(ranged(df, *order), name, *order)


def numbered_parts(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Numbers the rows of range partitions: one sort within each, and no shuffle.

    Rows are written in order with their partition's number and their place in it; the partitions' counts in these files, summed
    over those before, are their offsets. Range bounds are sampled and partitions may be coalesced, so another execution could
    cut elsewhere: places and counts both come from the files.
    """
    parts = pinned(df.sortWithinPartitions(*order).withColumn("n_m", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("n_m", 33), F.col("n_m").bitwiseAND((1 << 33) - 1)
    sizes = dict(parts.groupBy(part.alias("p")).agg(F.max(place) + 1).collect())  # as many rows as there are partitions
    ahead, n = [], 0
    for p in range(max(sizes, default=0) + 1):
        ahead.append(F.lit(n).cast("bigint"))
        n += sizes.get(p, 0)
    return parts.withColumn(name, F.element_at(F.array(*ahead), part.cast("int") + 1) + place + 1).drop("n_m")


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each group, the first in order."""
    return df.withColumn("f_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("f_rn = 1").drop("f_rn")


def folders(path: Column) -> Column:
    """All enclosing folders of a path, '' for the root included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nearest_folder(paths: DataFrame, path: str, keys: list[str], owners: DataFrame, folder: str) -> DataFrame:
    """Left join of each path to the owner with the longest enclosing folder: an equi-join on exploded folders."""
    up = paths.select(*keys, F.explode(folders(F.col(path))).alias("n_f"))
    hit = up.join(owners.withColumnRenamed(folder, "n_o"), F.col("n_f") == F.col("n_o")).withColumn("n_len", F.length("n_f"))
    best = first_of(hit, keys, [F.desc("n_len")]).drop("n_f", "n_o", "n_len")
    return paths.join(best, keys, "left")
