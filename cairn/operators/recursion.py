"""Recursive operators: ownership, containment, reverse closure.

Each is a loop over levels whose rows are checkpointed or bounded; a level is one join on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import pinned


#: Containment deeper than this is a cycle.
DEEPEST = 64


def ownership(entities: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, project_id, project_name): the nearest container that is a project; the entity itself if it is one.

    Only containers climb: they are few beside what they contain, which then takes its container's owner in one join. With `of`
    (ids, few enough to be broadcast) only these climb, and the entities aren't moved. Containment is shallow, so this is a handful of joins,
    each on the rows that haven't arrived yet; every fourth level is written, which keeps the plan short however deep it goes.
    """
    row = entities.select("id", F.col("kind").alias("at_kind"), F.col("containing_id").alias("next"), F.col("name").alias("at_name"))
    if of is not None:
        return _climbed(row.join(F.broadcast(of.select("id").distinct()), "id", "left_semi"), row, True)
    up = pinned(row.join(row.where("next is not null").select(F.col("next").alias("id")).distinct(), "id", "left_semi"))
    owner = pinned(_climbed(up, up, False)).select(F.col("id").alias("next"), "project_id", "project_name")
    own = row.where("at_kind = 'project'").select("id", F.col("id").alias("project_id"), F.col("at_name").alias("project_name"))
    return own.unionByName(row.where("at_kind <> 'project' and next is not null").select("id", "next").join(owner, "next").select("id", "project_id", "project_name"))


def _climbed(start: DataFrame, containers: DataFrame, few: bool) -> DataFrame:
    """Owners of the start rows (id, at_kind, next, at_name), by joins to their containers; few: the start rows can be broadcast."""
    up = containers.select(F.col("id").alias("u_id"), F.col("at_kind").alias("u_kind"), F.col("next").alias("u_up"), F.col("at_name").alias("u_name"))
    at = start.withColumn("at", F.col("id"))
    done = at.where("at_kind = 'project'").select("id", "at", "at_name")
    open_ = at.where("at_kind <> 'project' and next is not null")
    for depth in range(1, DEEPEST + 2):
        below = open_.select("id", "next")
        step = (F.broadcast(below) if few else below).join(up, F.col("next") == F.col("u_id")).select("id", F.col("u_id").alias("at"), F.col("u_kind").alias("at_kind"), F.col("u_up").alias("next"), F.col("u_name").alias("at_name"))
        if few or depth % 4 == 0:
            step = pinned(step)
        done = done.unionByName(step.where("at_kind = 'project'").select("id", "at", "at_name"))
        open_ = step.where("at_kind <> 'project' and next is not null")
        if (few or depth >= 3) and open_.isEmpty():
            break
    else:
        raise ValueError("containment has a cycle")
    return done.select("id", F.col("at").alias("project_id"), F.col("at_name").alias("project_name"))


def containment(entities: DataFrame, seed: int, depth: int) -> DataFrame:
    """(id, depth): what the seed contains, at most `depth` levels down; nothing at depth 0."""
    down = entities.where("containing_id is not null").select("containing_id", "id")
    level = entities.where(F.col("id") == seed).select("id")
    out = level.where("false").select("id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        level = down.join(level.select(F.col("id").alias("containing_id")), "containing_id").select("id")
        out = out.union(level.withColumn("depth", F.lit(d)))
    return out


#: Ids that a closure may hold on the driver: projects, not files.
MOST_PROJECTS = 1_000_000


def reverse_closure(seeds: DataFrame, references: DataFrame) -> DataFrame:
    """(id): the seeds and all that refer to them, directly or not. references: (source_id, target_id)."""
    sc = seeds.sparkSession
    seen = {r.id for r in seeds.select("id").distinct().collect()}
    frontier = set(seen)
    while frontier:
        # A level's projects; there are as many projects as a workspace has, not as many as files.
        now = sc.createDataFrame([(i,) for i in sorted(frontier)], "target_id bigint")
        found = {r.source_id for r in references.join(F.broadcast(now), "target_id", "left_semi").select("source_id").distinct().collect()}
        frontier = found - seen
        seen |= frontier
        if len(seen) > MOST_PROJECTS:
            raise ValueError(f"a closure of more than {MOST_PROJECTS} projects")
    return sc.createDataFrame([(i,) for i in sorted(seen)], "id bigint")
