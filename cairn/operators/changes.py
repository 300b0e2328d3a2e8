"""Change projection: deltas to files, entities, projects, impacts and endangered claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions.rules import git_status
from cairn.operators.common import nearest_folder
from cairn.operators.recursion import ownership
from cairn.operators.traverse import change_surface

KIND_RANK = {"file": 20, **{k: i for i, k in enumerate("http_endpoint class interface record method test_case".split())}}
PER_FILE = 25


def normalised(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn("status", git_status(F.col("code")))


def map_deltas(deltas: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each delta's file by its path, else by its old path; its project, else the nearest enclosing one.

    deltas: (ord, status, path, old_path); files: (id, relative_path, project_id); projects: (project_id, folder).
    """
    f = files.select(F.col("id").alias("file_id"), F.col("relative_path"), F.col("project_id").alias("file_project"))
    x = deltas.join(f.withColumnRenamed("relative_path", "path"), "path", "left")
    old = f.select(F.col("relative_path").alias("old_path"), F.col("file_id").alias("old_file"), F.col("file_project").alias("old_project"))
    x = x.join(old, "old_path", "left").withColumns({"file_id": F.coalesce("file_id", "old_file"), "file_project": F.coalesce("file_project", "old_project")})
    near = nearest_folder(x.where("file_project is null").select("ord", "path"), "path", ["ord"], projects, "folder").select("ord", F.col("project_id").alias("near_project"))
    x = x.join(near, "ord", "left")
    return x.select("ord", "status", "path", "old_path", "file_id", F.coalesce("file_project", "near_project").alias("project_id"))


def file_entities(located: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The first entities of each file: by the rank of their kind, then by name. located: (file_id, entity_id, kind, name); name is the qualified one."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind")), F.lit(10))
    x = located.select("file_id", "entity_id", "kind", "name", rank.alias("rank")).distinct()
    place = F.row_number().over(W.partitionBy("file_id").orderBy("rank", "name", "entity_id"))
    return x.withColumn("place", place).where(F.col("place") <= per_file)


def entity_counts(located: DataFrame) -> DataFrame:
    return located.groupBy("file_id").agg(F.countDistinct("entity_id").alias("n_entities"))


def within_budget(mapped: DataFrame, per_file: DataFrame, most: int = 100) -> DataFrame:
    """Entities of changed files while the running number, in delta order, stays within the budget."""
    n = per_file.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    # Deltas are what one working tree or range shows: at most 1,000 files.
    ahead = F.coalesce(F.sum("n").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = mapped.where("file_id is not null").join(n, "file_id").withColumn("room", F.lit(most) - ahead).where("room > 0").select("ord", "file_id", "room")
    return per_file.join(F.broadcast(room), "file_id").where("place <= room").select("ord", "file_id", "entity_id", "kind", "name", "place")


def endangered_claims(changed: DataFrame, locations: DataFrame, evidence: DataFrame, dependencies: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, n_touched): open claims that depend on a changed file, an entity there or a relation evidenced there."""
    ids = changed.select("file_id").distinct()
    touched = ids.select(F.lit("file").alias("kind"), F.col("file_id").alias("ref_id"))
    touched = touched.union(locations.join(ids, "file_id", "left_semi").select(F.lit("entity"), "entity_id"))
    touched = touched.union(evidence.join(ids, "file_id", "left_semi").select(F.lit("relation"), "relation_id")).distinct()
    x = dependencies.join(touched, ["kind", "ref_id"]).join(claims.where(F.col("status").isin("accepted", "proposed")).select("claim_id"), "claim_id", "left_semi")
    return x.groupBy("claim_id").agg(F.countDistinct("kind", "ref_id").alias("n_touched"))


def change_impacts(relations: DataFrame, seeds: list[int], entities: DataFrame, owners: DataFrame | None, test_projects: DataFrame, max_depth: int = 2, max_entities: int = 100, most_seeds: int = 8) -> DataFrame:
    """(entity_id, seed, depth, direction, kind): what the surfaces of up to eight changed entities reach, each at its least depth.

    Changed entities and those of test projects are left out; of equal depths the earlier seed's is kept, and the first
    max_entities reached make the result. What the driver holds is eight surfaces. Without `owners`, those of what was reached are looked up.
    """
    spark = relations.sparkSession
    schema = "entity_id bigint, seed bigint, depth int, direction string, kind string"
    found = [(s, x) for s in seeds[: min(most_seeds, max_entities)] for x in change_surface(relations, s, max_depth=max_depth, max_entities=max(10, min(100, max_entities)), entities=entities).items]
    ids = sorted({x["entity_id"] for _, x in found})
    if owners is None:
        owners = ownership(entities, spark.createDataFrame([(i,) for i in ids], "id bigint"))
    inside = owners.where(F.col("id").isin(ids)).join(test_projects, "project_id", "left_semi").select("id").collect() if ids else []
    out, skip = {}, {*seeds, *(r.id for r in inside)}
    for s, x in found:
        i = x["entity_id"]
        if i in skip or len(out) >= max_entities:
            continue
        if i not in out or x["depth"] < out[i][2]:
            out[i] = (i, s, x["depth"], x["direction"], x["kind"])
    return spark.createDataFrame(list(out.values()), schema)


def repository_projection(deltas: DataFrame) -> DataFrame:
    """(repository, n_files, files): each repository's changed files in order. deltas: (repository, ord, status, path), 1,000 at most of one."""
    files = F.array_sort(F.collect_list(F.struct("ord", "status", "path")))
    return deltas.groupBy("repository").agg(F.count(F.lit(1)).alias("n_files"), files.alias("files"))
