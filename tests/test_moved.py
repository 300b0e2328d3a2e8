"""What queries move: one join and one shuffle of edges for numbered relations, and no table that isn't asked for."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import generations, recursion, traverse
from cairn.plans import catalog
from cairn.sources import projection
from cairn.sources.projection import EDGES, Graph

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_join_lines_once_and_equal_the_sql(spark):
    g = Graph(spark, SMALL)
    want = g.sql(EDGES, entities=g.entities)
    assert want.columns == g.edges.columns
    assert g.edges.exceptAll(want).isEmpty() and want.exceptAll(g.edges).isEmpty()
    assert plan(g.edges).count("/lineitem.parquet") == 1


def test_upserts_need_no_shuffle_after_the_ranges(spark):
    from cairn.operators.common import ranged

    e = spark.range(1000).select((F.col("id") % 7).alias("source_id"), (F.col("id") % 5).alias("target_id"), F.format_string("d%d", F.col("id") % 2).alias("domain"), F.format_string("k%d", F.col("id") % 3).alias("kind"), F.lit("x").alias("dispatch_kind"), F.lit(1).alias("file_id"), F.lit(1).alias("start_line"), F.col("id").alias("start_column"), F.lit(2).alias("end_column"))
    for up in (generations.upsert_relations, generations.upsert_evidence):
        assert plan(up(ranged(e, *generations.EDGE_KEY))).count("Exchange") == 1


def test_representative_evidence_joins_nothing_to_its_ids(spark):
    text = plan(catalog.queries()["representative_evidence"](spark, SMALL))
    assert "Join" not in text and "Window" not in text


@pytest.mark.parametrize("name", ["entity_search", "entity_search_kinds"])
def test_searches_build_no_relations(spark, monkeypatch, name):
    monkeypatch.setattr(projection, "_BUILT", {})
    monkeypatch.setattr(Graph, "edges", property(lambda self: pytest.fail("edges are asked for")))
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_owners_of_a_few_equal_those_of_all(spark):
    e = Graph(spark, SMALL).entities
    few = e.where("id % 37 = 0").select("id")
    want = recursion.ownership(e).join(few, "id", "left_semi")
    got = recursion.ownership(e, few)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_capped_edges_are_written_once(spark):
    r = spark.range(1, 101).select("id", F.col("id").alias("source_id"))
    some, cut = traverse.capped(r, 10)
    assert cut and [x.id for x in some.orderBy("id").collect()] == list(range(1, 11)) and "Range" not in plan(some)


def test_members_meet_implementations_before_registrations(spark):
    from cairn.operators.extract import registration_edges

    n = 3000  # registrations of one service, each of which would meet all its members
    r = spark.range(n).select(F.lit(1).cast("bigint").alias("service_id"), F.col("id").alias("implementation_id"))
    m = spark.range(n).select(F.lit(1).cast("bigint").alias("service_id"), F.col("id").alias("member_id"))
    i = spark.range(n).select(F.col("id").alias("member_id"), F.col("id").alias("implementation_id"), F.col("id").alias("method_id"))
    out = registration_edges(r, m.union(m), i.union(i))
    assert out.groupBy("kind").count().collect() and out.count() == 2 * n
    text = plan(out)
    assert "LeftSemi" in text


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_pairs_in_a_project_are_dealt_to_tasks(spark, monkeypatch, most):
    from cairn.operators import bound_facts

    monkeypatch.setattr(bound_facts, "TASK_PAIRS", 500)
    monkeypatch.setattr(bound_facts, "MOST_SENT", most)
    m = spark.range(50).select(F.col("id").alias("m_id"), (F.col("id") % 2).alias("project_id"))
    e = spark.range(200).select(F.col("id").alias("e_id"), (F.col("id") % 2).alias("project_id"))
    x = bound_facts._in_project(m, e, "e_id")
    assert sorted(map(tuple, x.select("m_id", "e_id").collect())) == [(a, b) for a in range(50) for b in range(200) if a % 2 == b % 2]
    if most:
        assert x.select(F.spark_partition_id()).distinct().count() == 10
