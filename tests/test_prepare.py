"""Tasks and changes prepared from a small map, and the smaller read and write operators."""

import pytest

from cairn.api import CodeMap
from cairn.operators import extract, generations, orientation, packing, recursion
from cairn.sources import workspace

E = "id bigint, stable_key string, kind string, name string, qualified_name string, language string, containing_id bigint, signature string, visibility string"


@pytest.fixture(scope="module")
def shop(spark):
    make = spark.createDataFrame
    rows = [(1, "workspace", "shop", "shop", None), (2, "project", "Shop", "Shop", 1), (3, "project", "Shop.Tests", "Shop.Tests", 1), (10, "class", "OrderService", "Shop.OrderService", 2), (11, "method", "PlaceOrder", "Shop.OrderService.PlaceOrder", 10), (12, "method", "Charge", "Shop.Billing.Charge", 2), (13, "test_case", "PlacesOrders", "Shop.Tests.PlacesOrders", 3), (14, "method", "Refund", "Shop.Billing.Refund", 2)]
    e = make([(i, f"k{i}", k, n, q, "csharp", c, None, "public") for i, k, n, q, c in rows], E)
    edges = [(11, 12, "calls"), (13, 11, "calls"), (12, 14, "calls"), (10, 11, "contains")]
    r = make([(i, s, t, "code", k, None) for i, (s, t, k) in enumerate(edges, 1)], "id bigint, source_id bigint, target_id bigint, domain string, kind string, dispatch_kind string")
    ev = make([(i, 100, 2 * i, 1, 9) for i in range(1, 5)], "relation_id bigint, file_id bigint, start_line int, start_column int, end_column int")
    f = make([(100, 2, "Shop/Orders.cs", "csharp", "h", False)], "id bigint, project_id bigint, relative_path string, language string, content_hash string, is_generated boolean")
    return CodeMap(e, r, ev, f)


def test_prepare_change(spark, shop):
    claims = spark.createDataFrame([("a", 11, "s", "accepted", 0.9, 1), ("old", 11, "s", "accepted", 0.9, 1), ("p", 12, "s", "proposed", 0.9, 1), ("far", 1, "s", "accepted", 1.0, 1)], "claim_id string, entity_id bigint, statement string, status string, confidence double, updated int")
    fresh = spark.createDataFrame([("old", 1, "changed")], "claim_id string, n_stale bigint, reason string")
    commands = spark.createDataFrame([(2, "build_command", "build Shop"), (3, "test_command", "test Shop"), (3, "run_command", "run")], "project_id bigint, kind string, command string")
    text = "\n".join(f"line {i}" for i in range(1, 60))
    sources = spark.createDataFrame([(100, "Shop/Orders.cs", text, False)], "file_id bigint, relative_path string, text string, is_generated boolean")
    out = shop.prepare_change(11, 4000, claims=claims, fresh=fresh, commands=commands, sources=sources, test_projects=[3], source_lines=8)
    assert [(x["role"], x["id"]) for x in out["items"]] == [("seed", 11), ("related_test", 13), ("direct", 12), ("transitive", 14)]
    assert [c["id"] for c in out["claims"]] == ["a"] and out["commands"] == ["test Shop", "build Shop"]
    assert out["projects"] == ["Shop", "Shop.Tests"] and packing.tokens(out) <= 4000
    shown = [x["source"] for x in out["items"] if "source" in x]
    assert out["source_slices"] == len(shown) == 1 and shown[0]["slice"].startswith("line 1\n") and out["omitted_source_slices"] > 0
    assert [c["id"] for c in shop.prepare_change(11, claims=claims, fresh=fresh, proposed=True)["claims"]] == ["a", "p"]
    assert shop.prepare_change(999)["state"] == "entity_not_found"


def test_prepare_task(shop):
    out = shop.prepare_task("Charge customers when PlaceOrder succeeds", query="PlaceOrder")
    assert out["decision"] == "auto" and out["candidates"][0]["entity_id"] == 11 and out["pack"]["items"][0]["id"] == 11
    assert shop.prepare_task("x", seed=12)["decision"] == "exact"
    nothing = shop.prepare_task("unheardword elsewhere")
    assert nothing["decision"] == "no_match" and nothing["next_actions"][0]["action"] == "find"
    unclear = shop.prepare_task("Billing")
    assert unclear["decision"] == "needs_seed" and {a["seed"] for a in unclear["next_actions"]} == {12, 14}
    with pytest.raises(ValueError):
        shop.prepare_task(" ")


def test_impacts_leave_out_tests_and_the_changed(shop):
    assert {(r.entity_id, r.seed, r.depth) for r in shop.impacts([11], test_projects=[3]).collect()} == {(12, 11, 1), (14, 11, 2)}
    assert shop.impacts([]).collect() == [] and [r.entity_id for r in shop.impacts([11, 10, 12], test_projects=[3]).collect()] == [14]


def test_sources_stay_in_the_budget():
    pack = {"items": [{"id": i, "kind": "method"} for i in range(4)]}
    cut = lambda f, a, b: {"file_id": f, "first_line": a, "last_line": b, "slice": "x" * 400}
    out = packing.attach_sources(pack, {0: cut(1, 1, 9), 1: cut(1, 9, 12), 2: cut(2, 1, 9), 3: cut(3, 1, 9)}, 330)
    assert [("source" in x) for x in out["items"]] == [True, False, True, False] and out["omitted_source_slices"] == 2
    assert packing.core_budget(4000, True) == 2600 and packing.core_budget(900, True) == 800 and packing.core_budget(900, False) == 900


def test_recursion_ends(spark):
    e = spark.createDataFrame([(i, "class", f"c{i}", i + 1) for i in range(1, 20)] + [(20, "project", "p", None)], "id bigint, kind string, name string, containing_id bigint")
    assert {r.project_id for r in recursion.ownership(e).collect()} == {20} and recursion.ownership(e).count() == 20
    assert recursion.containment(e, 20, 0).collect() == [] and recursion.containment(e, 20, 2).count() == 2


def test_fact_cache(spark, tmp_path):
    cache = generations.FactCache(spark, str(tmp_path / "facts"))
    make = lambda rows: spark.createDataFrame(rows, "analyzer string, version string, project_key string, fact string")
    cache.write(make([("cs", "1", "a", "x"), ("cs", "1", "b", "y"), ("sql", "1", "a", "z")]))
    cache.write(make([("cs", "1", "b", "new")]))
    assert {(r.project_key, r.fact) for r in cache.read("cs", "1").collect()} == {("a", "x"), ("b", "new")}
    assert [r.fact for r in cache.read("cs", "1", spark.createDataFrame([("b",)], "project_key string")).collect()] == ["new"]


def test_orientation_facts(spark):
    facts = spark.createDataFrame([(2, "f:a", "build_rule", "Nullable", 100, 5), (2, "f:a", "build_rule", "Nullable", 100, 3)], "owner_id bigint, stable_key string, kind string, name string, file_id bigint, line int")
    e, at, edges = orientation.persisted(facts, "has_rule")
    assert e.count() == 1 and at.first().start_line == 3 and edges.first().source_id == 2


def test_fingerprints_follow_references_and_shared_files(spark):
    f = spark.createDataFrame([(1, "a.cs", "h"), (2, "b.cs", "h")], "project_id bigint, relative_path string, content_hash string")
    shared = lambda h: spark.createDataFrame([("global.json", h)], "relative_path string, content_hash string")
    refs = spark.createDataFrame([(1, 2)], "source_id bigint, target_id bigint")
    of = lambda **k: {r.project_id: r.fingerprint for r in generations.input_fingerprints(f, **k).collect()}
    plain, referred, one, two = of(), of(references=refs), of(shared=shared("1")), of(shared=shared("2"))
    assert plain[2] == referred[2] and plain[1] != referred[1] and all(one[p] != two[p] for p in (1, 2))


def test_paths_and_containers(spark):
    df = spark.createDataFrame([("a/b/../c.cs",), ("../x",), ("a/../../y",), ("./a//b",), ("w/..\\z",)], "p string")
    assert [r[0] for r in df.select(workspace.normal_path(df.p)).collect()] == ["a/c.cs", "../x", "../y", "a/b", "w/..\\z"]
    e = spark.createDataFrame([(1, 9, 5), (2, 1, 5), (3, None, 5)], "id bigint, containing_id bigint, project_id bigint")
    assert {(r.id, r.containing_id) for r in generations.resolve_containers(e).collect()} == {(1, 5), (2, 1), (3, 5)}
    s = spark.createDataFrame([("k", "p", "method", "m", "m", "", "public", None)], "stable_key string, project_key string, kind string, name string, qualified_name string, signature string, visibility string, container_key string")
    at = spark.createDataFrame([("k", "b.cs", 1), ("k", "a.cs", 9)], "stable_key string, path string, start_line int")
    assert [(r.path, r.container_key, r.location_kind) for r in extract.declarations(s, at).orderBy("path").collect()] == [("a.cs", "p", "definition"), ("b.cs", "p", "partial_definition")]
