"""Ranked substring search over symbols and entities."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import ascii_lower, contains, fold, search_terms
from cairn.operators.common import first_of
from cairn.operators.edges import bounded, names
from cairn.schema import SYMBOL_KINDS


def definitions(locations: DataFrame) -> DataFrame:
    """(entity_id, definition_count, file_id, start_line): how many definitions, and the first."""
    d = locations.where("location_kind = 'definition'")
    first = first_of(d, ["entity_id"], ["file_id", "start_line", "start_column"]).select("entity_id", "file_id", "start_line")
    return d.groupBy("entity_id").agg(F.count(F.lit(1)).alias("definition_count")).join(first, "entity_id")


def search_symbols(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols by name or qualified name: exact, prefix, other; then length, name, kind."""
    bounded(limit, 1, 100, "limit")
    q = fold(query.strip())
    if not q:
        raise ValueError("an empty query")
    name, full = ascii_lower("name"), ascii_lower("qualified_name")
    rank = F.when((name == q) | (full == q), 0).when(name.startswith(q) | full.startswith(q), 1).otherwise(2)
    hit = entities.where(F.col("kind").isin(SYMBOL_KINDS)).where(contains("name", query.strip()) | contains("qualified_name", query.strip()))
    return hit.select("id", "kind", "name", "qualified_name", rank.alias("rank")).orderBy("rank", F.length("qualified_name"), "qualified_name", "kind", "id").limit(limit + 1)


def _score(term: str) -> Column:
    t = fold(term)
    name, full, kind = ascii_lower("name"), ascii_lower("qualified_name"), F.concat(F.replace(ascii_lower("kind"), F.lit("_"), F.lit(" ")), F.lit("s"))
    has = lambda c: F.coalesce(F.instr(c, t) > 0, F.lit(False))
    text = (
        F.when(name == t, 120)
        .when(full == t, 110)
        .when(name.startswith(t), 80)
        .when(has(name), 65)
        .when(has(full), 55)
        .when(has(ascii_lower("signature")), 45)
        .when(has(kind), 35)
        .when(has(ascii_lower("language")), 20)
        .otherwise(0)
    )
    project = F.when(F.coalesce(ascii_lower("project_name") == t, F.lit(False)), 70).when(contains("project_path", term), 45).otherwise(0)
    file = F.when(F.coalesce(ascii_lower("relative_path") == t, F.lit(False)), 50).when(contains("relative_path", term), 30).otherwise(0)
    return text + project + file


def _matches(term: str) -> Column:
    kind = F.replace(F.col("kind"), F.lit("_"), F.lit(" "))
    surfaces = [contains(c, term) for c in ("name", "qualified_name", "signature", "language", "project_name", "project_path", "relative_path")]
    return reduce(or_, [*surfaces, contains(kind, term), contains(F.concat(kind, F.lit("s")), term)])


def search_entities(rows: DataFrame, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Entities of any kind by additive score over their text surfaces.

    rows: entities with project_name, project_path, relative_path and is_generated. The whole query counts twice if it has
    several terms. One pass over the rows; only the best limit + 1 travel.
    """
    bounded(limit, 1, 100, "limit")
    terms = search_terms(query)
    if not terms:
        raise ValueError("an empty query")
    score = reduce(add, [_score(t) * (2 if i == 0 and len(terms) > 1 else 1) for i, t in enumerate(terms)])
    x = rows.where(reduce(or_, [_matches(t) for t in terms]))
    if kinds := names(kinds, []):
        x = x.where(F.col("kind").isin(kinds))
    x = x.select("id", "kind", "name", "qualified_name", "is_generated", score.cast("bigint").alias("score"))
    return x.orderBy(F.desc("score"), "is_generated", F.length("qualified_name"), "qualified_name", "kind", "id").limit(limit + 1)


def searchable(entities: DataFrame, owners: DataFrame, files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Entities with the surfaces that a search looks at. projects: (project_id, project_path)."""
    own = owners.select("id", "project_id", "project_name")
    own = own.withColumn("project_path", F.lit(None).cast("string")) if projects is None else own.join(projects, "project_id", "left")
    own = own.drop("project_id")
    path = files.select("id", "relative_path", "is_generated")
    x = entities.join(own, "id", "left").join(path.withColumnRenamed("id", "p_id"), F.col("id") == F.col("p_id"), "left").drop("p_id")
    return x.withColumn("is_generated", F.coalesce("is_generated", F.lit(False)))
