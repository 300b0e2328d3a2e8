"""Batches of claims against a small generation."""

import pytest

from cairn.operators import decorate, ledger

UPDATES = "claim_id string, stable_key string, entity_id bigint, expected_kind string, expected_name string, update_kind string, update string, requested_status string, confidence double"
EVIDENCE = "claim_id string, ordinal int, kind string, source_key string, target_key string, relation_kind string, path string, ref_claim string, reason string"
DEPENDENCIES = "claim_id string, ordinal int, kind string, key string, expected string, expected_generation int"
ALIAS = '{"kind":"add_alias","alias":"x","aliasKind":"acronym"}'


@pytest.fixture(scope="module")
def now(spark):
    make = spark.createDataFrame
    return decorate.Current(
        3,
        make([(1, "class:a", "class", "A", "fa"), (2, "method:b", "method", "A.B", "fb")], "id bigint, stable_key string, kind string, qualified_name string, fingerprint string"),
        make([(7, "class:a", "method:b", "contains", "fr")], "id bigint, source_key string, target_key string, kind string, fingerprint string"),
        make([("file:x", "src/x.cs", "h1")], "stable_key string, relative_path string, content_hash string"),
        make([("old",)], "claim_id string"),
        make([("roslyn", "4")], "name string, version string"),
    )


def frames(spark, updates, evidence=(), dependencies=()):
    return spark.createDataFrame(list(updates), UPDATES), spark.createDataFrame(list(evidence), EVIDENCE), spark.createDataFrame(list(dependencies), DEPENDENCIES)


def test_a_good_batch(spark, now):
    updates = [("c1", "class:a", None, "class", "A", "add_alias", ALIAS, "accepted", 0.9), ("c2", None, 2, None, None, "add_alias", ALIAS, "accepted", 0.9)]
    evidence = [("c1", 0, "relation", "class:a", "method:b", "contains", None, None, None), ("c1", 1, "source_location", None, None, None, "src/x.cs", None, None), ("c1", 2, "claim", None, None, None, None, "old", None), ("c2", 0, "manual", None, None, None, None, None, "seen it")]
    dependencies = [("c2", 0, "analyzer", "roslyn", "4", None), ("c2", 1, "relation", "7", None, 3), ("c2", 2, "file", "src/x.cs", "h1", None), ("c2", 3, "entity", "class:a", None, 3)]
    out = decorate.decorate(*frames(spark, updates, evidence, dependencies), now)
    assert out.errors.collect() == [] and out.evidence.count() == 4
    assert {(r.claim_id, r.entity_id, r.dimension, r.status) for r in out.claims.collect()} == {("c1", 1, "aliases", "accepted"), ("c2", 2, "aliases", "proposed")}
    want = {("c1", "entity", "class:a", "fa"), ("c1", "relation", "7", "fr"), ("c1", "file", "file:x", "h1"), ("c1", "claim", "old", "present")}
    want |= {("c2", "entity", "method:b", "fb"), ("c2", "entity", "class:a", "fa"), ("c2", "analyzer", "roslyn", "4"), ("c2", "relation_id", "7", "present"), ("c2", "file", "file:x", "h1")}
    assert {tuple(r) for r in out.dependencies.collect()} == want
    assert {(r.claim_id, r.n_stale) for r in ledger.freshness(out.dependencies, now.values()).collect()} == {("c1", 0), ("c2", 0)}


def test_each_error_stops_the_whole_batch(spark, now):
    good = ("ok", "class:a", None, None, None, "add_alias", ALIAS, "proposed", 0.5)
    updates = [good, ("both", "class:a", 1, None, None, "add_alias", ALIAS, "proposed", 0.5), ("gone", "class:z", None, None, None, "add_alias", ALIAS, "proposed", 0.5), ("kind", "class:a", None, "method", None, "add_alias", ALIAS, "proposed", 0.5), ("name", None, 1, None, "B", "add_alias", ALIAS, "proposed", 0.5), ("shape", None, 1, None, None, "add_alias", "{}", "proposed", 0.5)]
    evidence = [("ok", i, *x) for i, x in enumerate([("route", None, None, None, None, None, None), ("entity", "class:z", None, None, None, None, None), ("relation", "class:a", "class:a", "contains", None, None, None), ("documentation", None, None, None, "no.md", None, None), ("claim", None, None, None, None, "new", None), ("manual", None, None, None, None, None, " "), ("rumour", None, None, None, None, None, None)])]
    dependencies = [("ok", i, *x) for i, x in enumerate([("entity", "class:a", None, 2), ("file", "src/x.cs", "h0", None), ("relation", "8", None, 3), ("analyzer", "roslyn", "5", None), ("documentation", "x", None, None)])]
    out = decorate.decorate(*frames(spark, updates, evidence, dependencies), now)
    places = {(r.claim_id, r.place) for r in out.errors.collect()}
    assert places == {("both", "subject"), ("gone", "subject"), ("kind", "subject"), ("name", "subject"), ("shape", "update"), *[("ok", f"evidence/{i}") for i in range(7)], *[("ok", f"dependencies/{i}") for i in range(5)]}
    assert out.claims.count() == out.evidence.count() == out.dependencies.count() == 0
