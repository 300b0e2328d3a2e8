"""Edge queries: relations of an entity, code usages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.common import first_of
from cairn.schema import DEFAULT_DOMAINS
from cairn.session import pinned


def names(given: list[str] | None, default: list[str]) -> list[str]:
    """Trimmed, distinct, not empty; the default if nothing is left."""
    out = list(dict.fromkeys(x.strip() for x in given or [] if x and x.strip()))
    return out or default


def bounded(value: int, least: int, most: int, what: str) -> int:
    if not least <= value <= most:
        raise ValueError(f"{what} must be from {least} to {most}")
    return value


def best_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each relation: the least line and column, then the least file."""
    return first_of(evidence, ["relation_id"], ["start_line", "start_column", "file_id"])


def _ends(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of both ends. The edges are an entity's own and are in files, so Spark knows how few they are: entities don't move."""
    df = pinned(df)
    ids = df.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    entities = entities.select("id", "qualified_name", "kind").join(ids, "id", "left_semi")
    s = entities.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_name"), F.col("kind").alias("source_kind"))
    t = entities.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_name"), F.col("kind").alias("target_kind"))
    return df.join(s, "source_id").join(t, "target_id")


def own_edges(relations: DataFrame, entity_id: int, direction: str, incoming: DataFrame | None = None) -> DataFrame:
    """Edges of an entity. `incoming`, the relations sorted by target if there are such, spares the scan of all for those that come in."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError("direction must be incoming, outgoing or both")
    out, into = F.col("source_id") == entity_id, F.col("target_id") == entity_id
    if incoming is None:
        return relations.where({"outgoing": out, "incoming": into}.get(direction, out | into))
    if direction == "outgoing":
        return relations.where(out)
    if direction == "incoming":
        return incoming.where(into)
    return relations.where(out).unionByName(incoming.where(into & ~out))


def relations_of(entities: DataFrame, relations: DataFrame, evidence: DataFrame | None, entity_id: int, direction: str = "both", domains: list[str] | None = None, kinds: list[str] | None = None, limit: int = 50, incoming: DataFrame | None = None) -> DataFrame:
    """Edges of an entity with their evidence, and whether there are more than `limit`.

    Edges without evidence don't show. The entity's edges are filtered before any join. Relations that carry their
    representative evidence (`generations.relations_with_evidence`) need no evidence table.
    """
    bounded(limit, 1, 200, "limit")
    own = own_edges(relations, entity_id, direction, incoming).where(F.col("domain").isin(names(domains, DEFAULT_DOMAINS)))
    if kinds := names(kinds, []):
        own = own.where(F.col("kind").isin(kinds))
    own = own.withColumnRenamed("id", "relation_id")
    if "start_line" in relations.columns:
        x = _ends(own.where("start_line is not null"), entities)
    else:
        near = evidence.join(own.select("relation_id"), "relation_id", "left_semi")
        x = _ends(own, entities).join(best_evidence(near), "relation_id")
    x = x.orderBy("domain", "kind", "source_name", "target_name", "start_line", "relation_id").limit(limit + 1)
    return x.select("relation_id", "source_id", "source_name", "target_id", "target_name", "domain", "kind", "dispatch_kind", "file_id", "start_line", "start_column")


def code_usages(entities: DataFrame, relations: DataFrame, evidence: DataFrame, files: DataFrame, target_id: int, kinds: list[str] | None = None, limit: int = 50, incoming: DataFrame | None = None) -> DataFrame:
    """Incoming code edges but containment: one row for each piece of evidence."""
    bounded(limit, 1, 100, "limit")
    own = own_edges(relations, target_id, "incoming", incoming).where((F.col("domain") == "code") & (F.col("kind") != "contains"))
    if kinds := names(kinds, []):
        own = own.where(F.col("kind").isin(kinds))
    own = own.select(F.col("id").alias("relation_id"), "source_id", "target_id", "kind", "dispatch_kind")
    if "target_id" in evidence.columns:
        evidence = evidence.where(F.col("target_id") == target_id)
    near = evidence.select("relation_id", "file_id", "start_line", "start_column", "end_column")
    path = files.select(F.col("id").alias("file_id"), "relative_path", "is_generated")
    x = _ends(own.join(near, "relation_id"), entities).join(path, "file_id")
    x = x.orderBy("is_generated", "kind", "source_name", "relative_path", "start_line", "start_column").limit(limit + 1)
    return x.select("relation_id", "source_id", "source_name", "kind", "dispatch_kind", "relative_path", "is_generated", "start_line", "start_column", "end_column")


def truncated(rows: DataFrame, limit: int) -> bool:
    """Whether limit + 1 rows came back."""
    return rows.count() > limit
