"""Write operators: upserts with their conflict rules, promotion, fingerprints, and atomic generations.

A store is a folder of generations. A build writes every table under gen=N and then replaces one manifest
file; readers resolve the manifest once, so they see whole generations only, and a failed build leaves the
previous one current.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.identity import digest_of_group
from cairn.operators.common import numbered, numbered_parts, ranged
from cairn.operators.recursion import reverse_closure

EDGE_KEY = ["source_id", "target_id", "domain", "kind"]


def last_dispatch() -> Column:
    """The dispatch of the greatest position."""
    return F.max(F.struct("start_line", "start_column", F.coalesce("dispatch_kind", F.lit("")).alias("d")))["d"]


def upsert_relations(edges: DataFrame) -> DataFrame:
    """One relation for each (source, target, domain, kind): the dispatch of the greatest position wins."""
    return edges.groupBy(*EDGE_KEY).agg(last_dispatch().alias("dispatch_kind"))


def relations_from(edges: DataFrame) -> DataFrame:
    # Partitioned by ranges of the key before the upsert, edges move once: for the groups and for the numbers.
    return numbered_parts(upsert_relations(ranged(edges, *EDGE_KEY)), "id", *EDGE_KEY)


def upsert_evidence(edges: DataFrame) -> DataFrame:
    """One row for each (relation, file, position); a conflict doesn't move the end, so the first end stays."""
    return edges.groupBy(*EDGE_KEY, "file_id", "start_line", "start_column").agg(F.min("end_column").alias("end_column"))


def keyed_evidence(edges: DataFrame) -> DataFrame:
    """Evidence with its relation's id and key. Relations are numbered with their evidence in a list, so there is no join."""
    lists = upsert_evidence(ranged(edges, *EDGE_KEY)).groupBy(*EDGE_KEY).agg(F.collect_list(F.struct("file_id", "start_line", "start_column", "end_column")).alias("e"))
    return numbered_parts(lists, "relation_id", *EDGE_KEY).select("relation_id", *EDGE_KEY, F.inline("e"))


def evidence_from(edges: DataFrame) -> DataFrame:
    return keyed_evidence(edges).select("relation_id", "file_id", "start_line", "start_column", "end_column")


def relations_with_evidence(edges: DataFrame) -> DataFrame:
    """Numbered relations, and where the representative piece of evidence is: the least line and column, then file."""
    best = F.min(F.struct("start_line", "start_column", "file_id", "end_column"))
    x = ranged(edges, *EDGE_KEY).groupBy(*EDGE_KEY).agg(last_dispatch().alias("dispatch_kind"), best.alias("b"))
    x = x.select(*EDGE_KEY, "dispatch_kind", "b.file_id", "b.start_line", "b.start_column", "b.end_column")
    return numbered_parts(x, "id", *EDGE_KEY)


def upsert_locations(locations: DataFrame) -> DataFrame:
    """One row for each (entity, file, kind, position); a conflict does move the end: the last wins."""
    return locations.groupBy("entity_id", "file_id", "location_kind", "start_line", "start_column").agg(F.max("end_column").alias("end_column"))


def upsert_entities(previous: DataFrame, fresh: DataFrame, key: str = "stable_key") -> DataFrame:
    """Rows of a new generation: known keys keep their id, new ones get the next ids in key order."""
    ids = previous.select(key, F.col("id").alias("known"))
    x = fresh.drop("id").join(ids, key, "left")
    top = previous.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(x.where("known is null"), "n", key).crossJoin(F.broadcast(top)).withColumn("id", F.col("n") + F.col("top")).drop("n", "top", "known")
    return x.where("known is not null").withColumn("id", F.col("known")).drop("known").unionByName(new)


def admit_relations(edges: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source, target and evidence file are all known."""
    ids = entities.select("id")
    x = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    x = x.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return x.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def resolve_containers(entities: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """A container that isn't an entity (of `among`, if given) becomes null."""
    known = (entities if among is None else among).select(F.col("id").alias("containing_id"), F.lit(True).alias("k")).distinct()
    x = entities.join(known, "containing_id", "left")
    # A symbol of a project whose container isn't there hangs from the project.
    other = F.col("project_id") if "project_id" in entities.columns else F.lit(None).cast("bigint")
    return x.withColumn("containing_id", F.when(F.col("k"), F.col("containing_id")).otherwise(other)).drop("k").select(*entities.columns)


def contains_edges(entities: DataFrame) -> DataFrame:
    return entities.where("containing_id is not null").select(F.col("containing_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("code").alias("domain"), F.lit("contains").alias("kind"))


def project_references(refs: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, edges): every reference is a dependency; an edge only where its target is known."""
    known = projects.select(F.col("path").alias("target_path"), F.col("id").alias("target_id"))
    deps = refs.join(known, "target_path", "left").select("source_id", "target_id", "target_path")
    return deps, deps.where("target_id is not null").select("source_id", "target_id", F.lit("code").alias("domain"), F.lit("references").alias("kind"))


def input_fingerprints(files: DataFrame, version: str = "1", shared: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(project_id, fingerprint) over the project's files, and what else its analysis reads.

    shared: (relative_path, content_hash) of files that concern all projects, a few; references: (source_id, target_id).
    """
    own = files.where("project_id is not null")
    lines = own.select("project_id", F.concat_ws(":", "relative_path", "content_hash").alias("line"))
    if references is not None:
        lines = lines.unionByName(references.select(F.col("source_id").alias("project_id"), F.concat(F.lit("reference:"), F.col("target_id").cast("string")).alias("line")))
    if shared is not None:
        every = shared.agg(digest_of_group(F.concat_ws(":", "relative_path", "content_hash")).alias("h")).select(F.concat(F.lit("shared:"), "h").alias("line"))
        lines = lines.unionByName(own.select("project_id").distinct().crossJoin(F.broadcast(every)))  # one row
    return lines.groupBy("project_id").agg(digest_of_group(F.col("line"), version).alias("fingerprint"))


def workspace_fingerprint(files: DataFrame, version: str = "1") -> DataFrame:
    return files.agg(digest_of_group(F.concat_ws(":", "relative_path", "content_hash"), version).alias("fingerprint"))


def changed_files(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added, removed or changed, by content hash."""
    b, a = before.select(key, F.col("content_hash").alias("b")), after.select(key, F.col("content_hash").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def invalidated(before: DataFrame, after: DataFrame, references: DataFrame) -> DataFrame:
    """Projects to analyse again: a changed fingerprint, or a reference (however far) to one that has."""
    b = before.select("project_id", F.col("fingerprint").alias("b"))
    seeds = after.join(b, "project_id", "left").where(F.col("b").isNull() | (F.col("b") != F.col("fingerprint"))).select(F.col("project_id").alias("id"))
    return reverse_closure(seeds, references)


def promote(previous: DataFrame, fresh: DataFrame, reused: DataFrame, key: str = "project_id") -> DataFrame:
    """Facts of reused projects (but global route matches) together with the fresh ones."""
    old = previous.join(reused.select(key), key, "left_semi")
    if "kind" in old.columns:
        old = old.where("kind <> 'matches_endpoint'")
    return old.unionByName(fresh)


def index_mode(changed: int, analysed: int, projects: int, had_generation: bool) -> str:
    if not had_generation:
        return "full"
    return "unchanged" if not changed else "full" if analysed >= projects else "incremental"


@dataclass
class Store:
    """Generations of named tables in a folder."""

    spark: SparkSession
    folder: str

    @property
    def manifest(self) -> dict:
        path = os.path.join(self.folder, "MANIFEST.json")
        if not os.path.exists(path):
            return {"generation": 0, "tables": {}}
        with open(path) as f:
            return json.load(f)

    def read(self, table: str) -> DataFrame:
        tables = self.manifest["tables"]
        if table not in tables:
            raise KeyError(f"the current generation has no table {table!r}")
        return self.spark.read.parquet(os.path.join(self.folder, tables[table]))

    def build(self, tables: dict[str, DataFrame], fingerprint: str | None = None) -> dict:
        """Writes a generation and makes it current; an unchanged fingerprint gives the current one back."""
        now = self.manifest
        if fingerprint is not None and now.get("fingerprint") == fingerprint:
            return {**now, "mode": "unchanged"}
        n = now["generation"] + 1
        paths = {}
        for name, df in tables.items():
            paths[name] = f"gen={n}/{name}"
            df.write.mode("overwrite").parquet(os.path.join(self.folder, paths[name]))
        new = {"generation": n, "tables": {**now["tables"], **paths}, "fingerprint": fingerprint}
        temporary = os.path.join(self.folder, f".MANIFEST.{n}")
        with open(temporary, "w") as f:
            json.dump(new, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, os.path.join(self.folder, "MANIFEST.json"))
        return {**new, "mode": "full" if n == 1 else "incremental"}


@dataclass
class FactCache:
    """Facts of analysed projects, by analyzer, version and project: what a build reads instead of analysing again."""

    spark: SparkSession
    folder: str

    KEYS = ("analyzer", "version", "project_key")

    def write(self, facts: DataFrame) -> None:
        """Replaces the facts of the projects that are in the frame, and no others'."""
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.KEYS).parquet(self.folder)

    def read(self, analyzer: str, version: str, projects: DataFrame | None = None) -> DataFrame:
        """Facts of one analyzer and version, of all or the given (project_key) projects; partitions prune the scan."""
        x = self.spark.read.parquet(self.folder).where((F.col("analyzer") == analyzer) & (F.col("version").cast("string") == version))
        x = x.withColumn("project_key", F.col("project_key").cast("string"))
        return x if projects is None else x.join(projects.select("project_key").distinct(), "project_key", "left_semi")
