"""Workspace orientation: commands that follow from facets, and facts as entities, locations and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import stable_key

RUNNABLE = ["application", "aspnet_core_host", "worker", "tool"]


def quoted(path: Column) -> Column:
    return F.concat(F.lit('"'), path, F.lit('"'))


def derived_commands(projects: DataFrame, solutions: DataFrame, facets: DataFrame) -> DataFrame:
    """(owner_id, kind, name, command, origin, stable_key): build, test, run, package and migrate of projects; build, test and format of solutions.

    projects: (owner_id, name, path, packable); solutions: (owner_id, name, path); facets: (owner_id, facet).
    """
    own = facets.groupBy("owner_id").agg(F.collect_set("facet").alias("facets"))
    p = projects.join(own, "owner_id", "left").withColumn("facets", F.coalesce("facets", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("facets", F.array(*map(F.lit, names)))

    def rows(df: DataFrame, kind: str, label: str, command: str, origin: str) -> DataFrame:
        text = F.concat(F.lit(f"dotnet {command} "), quoted(F.col("path")))
        return df.select("owner_id", F.lit(kind).alias("kind"), F.concat(F.lit(label + " "), "name").alias("name"), text.alias("command"), F.lit(origin).alias("origin"))

    out = rows(p, "build", "Build", "build", "derived_from_msbuild")
    out = out.unionByName(rows(p.where(has("test")), "test", "Test", "test", "derived_from_msbuild"))
    out = out.unionByName(rows(p.where(has(*RUNNABLE)), "run", "Run", "run --project", "derived_from_msbuild"))
    out = out.unionByName(rows(p.where(has("library") & F.col("packable")), "package", "Package", "pack", "derived_from_msbuild"))
    out = out.unionByName(rows(p.where(has("migration")), "migrate", "Apply migrations for", "ef database update --project", "derived_from_ef_package"))
    for kind in ("build", "test", "format"):
        out = out.unionByName(rows(solutions, kind, kind.capitalize(), kind, "derived_from_solution"))
    return out.withColumn("stable_key", stable_key("workspace_command", F.col("owner_id").cast("string"), "kind", "command"))


def persisted(facts: DataFrame, relation_kind: str, domain: str = "build") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, locations, edges) of orientation facts (owner_id, stable_key, kind, name, file_id, line).

    Each fact is an entity with a place and an edge from what it belongs to; facts that repeat a key are one, at the first place.
    """
    first = facts.groupBy("stable_key").agg(F.min(F.struct("file_id", "line", "owner_id", "kind", "name")).alias("f")).select("stable_key", "f.*")
    entities = first.select("stable_key", "kind", "name", F.col("name").alias("qualified_name"))
    locations = first.select("stable_key", "file_id", F.lit("definition").alias("location_kind"), F.col("line").alias("start_line"))
    return entities, locations, first.select(F.col("owner_id").alias("source_id"), F.col("stable_key").alias("target_key"), F.lit(domain).alias("domain"), F.lit(relation_kind).alias("kind"), "file_id", F.col("line").alias("start_line"))
