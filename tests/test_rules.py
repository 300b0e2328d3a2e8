"""Rules on single values, and the traps of the blueprint."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.functions.identity import stable_key
from cairn.functions.text import ascii_lower, search_terms, task_terms
from cairn.operators import edges, extract, generations, ledger, packing, search
from cairn.sources import workspace


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row.asDict()


L = F.lit


def test_text(spark):
    got = one(spark, low=ascii_lower(L("ÄBc")), terms=F.concat_ws(",", task_terms(L("Fix the ParserCache and the parsercache in IO for Loader_2"))), key=stable_key("x", L(None).cast("string"), L("a"), sep="|"))
    assert got["low"] == "Äbc" and got["terms"] == "ParserCache,Loader_2"
    import hashlib

    assert got["key"] == "x:" + hashlib.sha256(b"|a").hexdigest()
    assert search_terms("  alpha ") == ["alpha"] and search_terms("find the Alpha x") == ["find the Alpha x", "find", "the", "Alpha"]


def test_routes(spark):
    match = lambda a, b: one(spark, m=rules.route_matches(rules.route_path(L(a)), rules.route_path(L(b))))["m"]
    assert match("/Persona?url={sid}", "/Persona") and match("/a/7", "/A/{id}") and not match("/a/{id}", "/A/7") and not match("/a", "/a/b")
    assert match("https://host:80/x//y/", "x/Y") and match("{base}/x", "/x")
    route = lambda p, a: one(spark, r=rules.combined_route(L(p), L(a), L("PersonaController"), L("Get$1")))["r"]
    assert route("api/[controller]", "{id}") == "/api/Persona/{id}" and route("api/[Controller]", "/abs/[action]") == "/abs/Get$1" and route("", "x/") == "/x"


def test_sql(spark):
    sql = 'WITH a AS (SELECT * FROM "dbo".Users u JOIN "Orders" o ON 1=1) DELETE FROM users'
    got = one(spark, o=rules.sql_objects(L(sql)), e=rules.sql_effect(L(sql)), d=rules.sql_effect(L(" delete from x")), x=rules.sql_effect(L("EXEC p")))
    assert got == {"o": ["dbo.users", "orders", "users"], "e": "reads", "d": "deletes", "x": "executes"}


def test_classifiers(spark):
    codes = ["??", "UU", "AA", "R ", " D", "MD", "T ", "A ", " M"]
    assert [one(spark, s=rules.git_status(L(c)))["s"] for c in codes] == ["untracked", "conflicted", "conflicted", "renamed", "deleted", "deleted", "type_changed", "added", "modified"]
    got = one(spark, a=rules.append_detail(L("x | y"), L("y")), b=rules.append_detail(L("x"), L("y")), c=rules.append_detail(L(None).cast("string"), L("y")), d=rules.rule_precedence(L(100), L("a/b/")), e=rules.ef_effect(L("AddRange")), f=rules.access_kind(L("out")), g=rules.dispatch_kind(L(False), L(False), L("interface"), L(True)), h=rules.authorization(L(True), L("p"), L(None).cast("string"), L(True)), i=rules.project_kind(L("Microsoft.NET.Sdk.Web"), L(""), L(False)), j=rules.script_kind(L("test:codegen")), k=rules.lookup(rules.MIGRATION_KINDS, L("DropIndex")), l=rules.lookup(rules.TEST_ATTRIBUTES, L("Theory")))
    assert got == {"a": "x | y", "b": "x | y", "c": "y", "d": 120, "e": "inserts", "f": "writes", "g": "interface", "h": "anonymous", "i": "web", "j": "test", "k": "drops_index", "l": "xunit"}


def test_last_write_wins_and_first_end_stays(spark):
    e = spark.createDataFrame([(1, 2, "code", "calls", "direct", 5, 1, 1, 9), (1, 2, "code", "calls", "virtual", 5, 3, 1, 9), (1, 2, "code", "calls", "static", 5, 1, 1, 4)], "source_id bigint, target_id bigint, domain string, kind string, dispatch_kind string, file_id bigint, start_line int, start_column int, end_column int")
    assert generations.upsert_relations(e).first().dispatch_kind == "virtual"
    assert sorted((r.start_line, r.end_column) for r in generations.upsert_evidence(e).collect()) == [(1, 4), (3, 9)]
    loc = e.select(F.col("source_id").alias("entity_id"), "file_id", L("definition").alias("location_kind"), "start_line", "start_column", "end_column")
    assert {r.end_column for r in generations.upsert_locations(loc).collect()} == {9}


def test_edges_need_evidence(spark):
    ent = spark.createDataFrame([(1, "class", "a"), (2, "class", "b")], "id bigint, kind string, qualified_name string")
    rel = spark.createDataFrame([(1, 1, 2, "code", "calls", None), (2, 2, 1, "code", "calls", None)], "id bigint, source_id bigint, target_id bigint, domain string, kind string, dispatch_kind string")
    ev = spark.createDataFrame([(1, 7, 9, 1, 2), (1, 7, 3, 1, 2), (1, 8, 3, 1, 2)], "relation_id bigint, file_id bigint, start_line int, start_column int, end_column int")
    files = spark.createDataFrame([(7, "a.cs", False), (8, "b.g.cs", True)], "id bigint, relative_path string, is_generated boolean")
    (row,) = edges.relations_of(ent, rel, ev, 1).collect()
    assert (row.relation_id, row.file_id, row.start_line) == (1, 7, 3)
    assert edges.code_usages(ent, rel, ev, files, 2).count() == 3 and edges.truncated(edges.code_usages(ent, rel, ev, files, 2, limit=2), 2)


def test_search_scores(spark):
    rows = spark.createDataFrame([(1, "class", "Alpha", "x.Alpha", None, "csharp", None, None, False), (2, "http_endpoint", "b", "x.b", None, "csharp", "Alpha", None, False), (3, "method", "Alphabet", "x.Alphabet", None, "csharp", None, "src/alpha", True)], "id bigint, kind string, name string, qualified_name string, signature string, language string, project_name string, relative_path string, is_generated boolean").withColumn("project_path", F.concat("project_name", L("/p.csproj")))
    assert [(r.id, r.score) for r in search.search_entities(rows, "ALPHA").collect()] == [(1, 120), (3, 110), (2, 70)]
    assert [(r.id, r.score) for r in search.search_entities(rows, "http endpoints").collect()] == [(2, 140)]
    with pytest.raises(ValueError):
        search.search_entities(rows, " ")


def test_packing_skips_and_keeps_the_first():
    items = [{"kind": "m", "tokens": t} for t in (50, 70, 20, 30)]
    assert [x["tokens"] for x in packing.pack(items, 100)] == [50, 20, 30]
    assert [x["tokens"] for x in packing.pack(items, 10)] == [50]
    assert len(packing.pack([{"kind": "class", "tokens": 1}] * 9, 100)) == 6
    many = [{"role": "seed" if i == 3 else "item", "kind": "m", "name": "x" * 50, "id": i} for i in range(200)]
    out = packing.context_pack(many, [], ["c"], ["p"], 800)
    assert out["items"][0]["id"] == 3 and packing.tokens(out) <= 800
    with pytest.raises(ValueError):
        packing.context_pack([], [], [], [], 799)


def test_seed_decisions():
    d, one_ = packing.seed_decision, lambda score, exact=False, **more: {"score": score, "exact": exact, **more}
    assert d([]) == "no_match" and d([one_(10)]) == "auto"
    assert d([one_(150, True), one_(120, True)]) == "auto" and d([one_(140), one_(120)]) == "needs_seed" and d([one_(190), one_(120)]) == "auto"
    shared = {"project_name": "Web", "terms": ["web", "x"]}
    assert d([one_(210, True, **shared), one_(205, True, **shared)]) == "auto" and d([one_(260, **shared), one_(225, **shared)]) == "auto" and d([one_(260, **shared), one_(240, **shared)]) == "needs_seed"


def test_ledger(spark):
    status = lambda asked, kinds, c: one(spark, s=ledger.granted_status(L(asked), F.array(*[L(k) for k in kinds]), L(c)))["s"]
    assert status("accepted", ["entity"], 0.79) == "proposed" and status("accepted", ["manual"], 0.9) == "proposed" and status("accepted", ["manual", "entity"], 0.8) == "accepted" and status("rejected", [], 0.1) == "rejected"
    batch = {"schemaVersion": "1.0", "workspaceKey": "w", "operationId": "op-1", "updates": [{}]}
    digest = ledger.check_envelope(batch, "w")
    for bad in ({"schemaVersion": "2"}, {"workspaceKey": "x"}, {"operationId": "-"}, {"updates": []}, {"updates": [{}] * 501}, {"conflictPolicy": "best"}):
        with pytest.raises(ValueError):
            ledger.check_envelope({**batch, **bad}, "w")
    sessions = spark.createDataFrame([("op-1", digest, "{}")], "operation_id string, payload_hash string, result_json string")
    assert ledger.replay(sessions, "op-1", digest) == "{}" and ledger.replay(sessions, "op-2", digest) is None and ledger.replay(sessions, "op-1", "x", dry_run=True) is None
    with pytest.raises(ValueError):
        ledger.replay(sessions, "op-1", "other")


def test_extraction(spark):
    groups = spark.createDataFrame([(1, None, "/api"), (2, 1, "v1/"), (3, 2, "/x")], "id bigint, parent_id bigint, route string")
    assert {r.id: r.prefix for r in extract.group_prefixes(groups).collect()} == {1: "/api", 2: "/api/v1", 3: "/api/v1/x"}
    lines = spark.createDataFrame([(1, 1, "root = true"), (1, 2, "[*.cs]"), (1, 3, "# no"), (1, 4, "indent_size = 4")], "file_id bigint, line int, text string")
    assert {(r.section, r.key, r.value) for r in extract.editorconfig_rules(lines).collect()} == {("*", "root", "true"), ("*.cs", "indent_size", "4")}
    tables = spark.createDataFrame([(1, "F", None, "S", None, "attr", "d"), (2, None, "A", "S", None, None, None)], "entity_id bigint, fluent_table string, attribute_table string, set_name string, fluent_schema string, attribute_schema string, default_schema string")
    assert {r.entity_id: r.table_name for r in extract.table_names(tables).collect()} == {1: "attr.F", 2: "A"}
    syms = spark.createDataFrame([(10, 1, 1, 50), (11, 1, 5, 9)], "id bigint, file_id bigint, first_line int, last_line int")
    refs = spark.createDataFrame([(1, 1, 7, 99), (2, 1, 20, 99), (3, 2, 1, 99)], "ref_id bigint, file_id bigint, line int, project_id bigint")
    assert {r.ref_id: r.source_id for r in extract.nearest_symbol(refs, syms).collect()} == {1: 11, 2: 10, 3: 99}
    known = spark.createDataFrame([("A", "T", 5, 1)], "assembly string, name string, id bigint, project_id bigint")
    uses = spark.createDataFrame([("A", "T", 9), ("B", "T", 1), ("B", "U", 1)], "assembly string, name string, project_id bigint")
    assert extract.resolve_symbols(uses, known).count() == 2
    keys = spark.createDataFrame([("t", "PK_t", True, ["a", "b"])], "table_name string, object_name string, is_key boolean, column_names array<string>")
    assert {r.kind for r in extract.keys_and_indexes(keys).collect()} == {"includes_column", "has_primary_key", "primary_key_of"}


def test_git_feeds():
    assert workspace.parse_porcelain("R  new\0old\0?? x y\0 M z\0") == [("R ", "new", "old"), ("??", "x y", None), (" M", "z", None)]
    assert workspace.parse_name_status("R100\0old\0new\0M\0z\0D\0w\0") == [("R", "new", "old"), ("M", "z", None), ("D", "w", None)]
