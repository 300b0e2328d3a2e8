"""Discovery of a folder, stores, the stream, the facade and the command line."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.api import CodeMap
from cairn.operators import generations
from cairn.sources import workspace
from cairn.sources.projection import Graph
from cairn.streaming import feed

WEB = """<Project Sdk="Microsoft.NET.Sdk.Web">
  <PropertyGroup><TargetFrameworks>net9.0;net10.0</TargetFrameworks></PropertyGroup>
  <ItemGroup><ProjectReference Include="../Lib/Lib.csproj" />
  <ProjectReference Include="..\\Gone\\Gone.csproj" /><PackageReference Include="Dapper" /></ItemGroup>
</Project>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for path, text in {
        "All.slnx": "<Solution />",
        "global.json": '{"sdk": {"version": "10.0.100"}}',
        "AGENTS.md": "x",
        "src/Web/Web.csproj": WEB,
        "src/Web/Program.cs": "class P {}",
        "src/Web/Model.g.cs": "class M {}",
        "src/Web/bin/Out.cs": "no",
        "src/Lib/Lib.csproj": '<Project Sdk="Microsoft.NET.Sdk"></Project>',
        "src/Lib/Deep/A.cs": "class A {}",
        "src/Tests/Tests.csproj": '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><PackageReference Include="xunit" /></ItemGroup></Project>',
        "web/package.json": '{"name": "front", "scripts": {"test": "t", "build": "b", "other": "o"}}',
        "notes.bin": "x",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_discovery(spark, folder):
    files = workspace.discover(spark, [str(folder), str(folder / "src")]).cache()
    got = {(r.root_path == str(folder / "src"), r.relative_path): r for r in files.collect()}
    assert (True, "Web/Program.cs") in got and (False, "src/Web/Program.cs") not in got and not any("bin" in p for _, p in got)
    assert got[True, "Web/Model.g.cs"].is_generated and got[True, "Web/Program.cs"].language == "csharp" and len(got) == 10
    assert {r.name for r in workspace.solutions(files).collect()} == {"All"}
    assert [tuple(r) for r in workspace.global_settings(files).collect()] == [("global.json", "sdk.version", "10.0.100")]
    assert {(r.script, r.kind) for r in workspace.package_scripts(files).collect()} == {("test", "test"), ("build", "build"), ("other", "run")}
    assert workspace.instructions(files).first().precedence == 100
    found = workspace.projects(files).cache()
    assert {r.name: r.project_kind for r in found.collect()} == {"Web": "web", "Lib": "library", "Tests": "test"}
    refs = {(r.target_path, r.target, r.line) for r in workspace.project_references(found).collect()}
    assert refs == {("Lib/Lib.csproj", "Lib/Lib.csproj", 3), ("Web/..\\Gone\\Gone.csproj", None, 4)}
    owners = {r.relative_path: r.project for r in workspace.file_owners(files, found).collect()}
    assert owners["Lib/Deep/A.cs"] == "Lib/Lib.csproj" and owners["global.json"] is None
    facets = {(r.project, r.facet) for r in workspace.facets(found).collect()}
    assert {("Web/Web.csproj", "aspnet_core_host"), ("Web/Web.csproj", "database"), ("Tests/Tests.csproj", "test")} <= facets
    with pytest.raises(FileNotFoundError):
        workspace.discover(spark, ["/nowhere/at/all"])


def test_git(spark, folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src/Lib")
    run("commit", "-qm", "x")
    (folder / "src/Lib/Deep/A.cs").write_text("class B {}")
    df, more = workspace.git_deltas(spark, [str(folder), str(folder / "src")])
    assert {(r.path, r.status) for r in df.collect()} >= {("src/Lib/Deep/A.cs", "modified"), ("web/", "untracked")} and not more
    assert workspace.git_deltas(spark, [str(folder)], most=1)[1]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    g = Graph(spark, "/root/testdata/sf0.001")
    m = CodeMap(g.entities.withColumn("stable_key", F.concat(F.lit("k:"), "id")), g.relations, g.evidence, g.files)
    path = str(tmp_path_factory.mktemp("store"))
    assert m.save(path, "f1")["mode"] == "full" and m.save(path, "f1")["mode"] == "unchanged"
    return path


def test_store_keeps_the_last_whole_generation(spark, store):
    s = generations.Store(spark, store)
    n = s.read("entities").count()
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        s.build({"entities": broken}, "f2")
    assert s.manifest["generation"] == 1 and s.read("entities").count() == n
    with pytest.raises(KeyError):
        s.read("claims")


def test_facade(spark, store):
    m = CodeMap.open(spark, store)
    assert m.resolve(stable_key="k:30000001") == 30_000_001
    for bad in ({}, {"stable_key": "a", "entity_id": 1}):
        with pytest.raises(ValueError):
            m.resolve(**bad)
    with pytest.raises(LookupError):
        m.resolve(entity_id=5)
    pack = m.prepare_change(30_000_001, 1000, ["order"], domains=["code"], max_depth=1)
    assert pack["items"][0]["role"] == "seed" and len(pack["items"]) > 1


def test_command_line(spark, store, capsys):
    assert cli.main([store, "summary"], spark) == 0
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()} == {"entities", "files", "relations", "evidence"}
    assert cli.main([store, "entity", "5"], spark) == 1 and cli.main([store, "nonsense"], spark) == 2
    assert cli.main([store, "route", "40000001", "1003", "--max-depth", "4"], spark) == 0


def test_stream(spark, tmp_path):
    rows = [(1, "A ", "a.cs", None), (1, "A ", "a.cs", None), (2, "R ", "new.cs", "b.cs"), (3, "??", "c.cs", None)]
    df = spark.createDataFrame(rows, "change_id bigint, code string, path string, old_path string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.select("change_id", "ts", "code", "path", "old_path").write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([(10, "a.cs"), (11, "b.cs")], "id bigint, relative_path string")
    q = feed.write_generations(feed.read_changes(spark, str(tmp_path / "in")), files, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.change_id, r.status, r.file_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "added", 10), (2, "renamed", 11), (3, "untracked", None)}
    counts = feed.windowed_counts(feed.read_changes(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.status, r.n) for r in spark.sql("SELECT * FROM counts").collect()} == {("added", 1), ("renamed", 1), ("untracked", 1)}
