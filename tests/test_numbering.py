"""Numbers in a total order, however the range partitions are cut."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.operators.common import numbered
from cairn.sources.projection import PRELUDE, Graph

LARGE = "/root/testdata/sf0.1"


@pytest.fixture
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_are_dense_and_in_order(spark, small_partitions):
    n = 300_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("wide"), 20).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"))
    out = numbered(df, "n", "k")
    got = out.agg(F.count(F.lit(1)), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n, 1, n)
    # Only these columns are asked for, which must not change the numbers.
    rows = out.select("k", "n").orderBy("n").toPandas()
    assert rows.k.is_monotonic_increasing


def test_relation_ids_equal_sql_at_sf_0_1(spark, small_partitions):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGE}/{t}.parquet'")
    sums = "count(*), count(DISTINCT id), max(id), sum(id * (source_id % 1009)), sum(id * (target_id % 1013)), sum(id * length(kind))"
    want = con.execute(f"{PRELUDE} SELECT {sums} FROM relations").fetchone()
    got = Graph(spark, LARGE).relations.selectExpr(*[x.strip() for x in sums.split(", ")]).first()
    assert tuple(map(int, got)) == tuple(map(int, want)) and got[0] == got[1] == got[2]
