"""Fact rules over relations of facts: ownership of files, markers, routes, registrations, pipelines, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import rules
from cairn.functions.identity import stable_key
from cairn.operators.common import first_of, nearest_folder
from cairn.schema import SYMBOL_KINDS


def own_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files and the project with the longest enclosing folder. files: (file_id, path); projects: (project_id, folder)."""
    return nearest_folder(files, "path", ["file_id"], projects, "folder")


def source_marker(files: DataFrame, marker: str) -> DataFrame:
    """(project_id, file_id, line): the first line of a project's sources that has the marker."""
    lines = files.where("not is_generated").select("project_id", "file_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.instr("l", marker) > 0)
    best = lines.groupBy("project_id").agg(F.min(F.struct("file_id", "line")).alias("b"))
    return best.select("project_id", "b.file_id", (F.col("b.line") + 1).alias("line"))


def split_values(rows: DataFrame, value: str) -> DataFrame:
    """One row for each part of a ;-list, trimmed, not empty."""
    return rows.withColumn(value, F.explode(F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda x: x != "")))


def with_defaults(dimensions: DataFrame, projects: DataFrame, defaults: dict[str, list[str]]) -> DataFrame:
    """Build dimensions (project_id, dimension, value), and the defaults where a project has none of a dimension."""
    spark = projects.sparkSession
    d = spark.createDataFrame([(k, v) for k, vs in defaults.items() for v in vs], "dimension string, value string")
    missing = projects.select("project_id").crossJoin(F.broadcast(d)).join(dimensions.select("project_id", "dimension").distinct(), ["project_id", "dimension"], "left_anti")
    return dimensions.select("project_id", "dimension", "value").unionByName(missing.select("project_id", "dimension", "value"))


def editorconfig_rules(lines: DataFrame) -> DataFrame:
    """(file_id, line, section, key, value) of INI lines (file_id, line, text): a running section."""
    header = F.regexp_extract("text", "^\\s*\\[(.*)\\]\\s*$", 1)
    section = F.last(F.when(header != "", header), True).over(W.partitionBy("file_id").orderBy("line"))
    x = lines.withColumn("section", section).where(F.col("text").rlike("^\\s*[^#;\\[\\s][^=]*="))
    return x.select("file_id", "line", F.coalesce("section", F.lit("*")).alias("section"), F.trim(F.regexp_extract("text", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("text", "=(.*)$", 1)).alias("value"))


def dedupe_facts(facts: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_of(facts, keys, list(order))


def resolve_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References to known symbols: by (assembly, name), else by name within the own project; others go."""
    far = symbols.select(F.col("assembly"), F.col("name"), F.col("id").alias("far_id"))
    near = symbols.select("project_id", "name", F.col("id").alias("near_id"))
    x = refs.join(far, ["assembly", "name"], "left").join(near, ["project_id", "name"], "left")
    return x.withColumn("target_id", F.coalesce("far_id", "near_id")).where("target_id is not null").drop("far_id", "near_id")


def route_edges(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(source_id, target_id): requests and the endpoints they match.

    An equi-join on verb, number of segments and the first segment that can't be a parameter keeps the
    segment-wise test to few pairs; endpoints whose first segment is a parameter join under '*'.
    """
    first = lambda p: F.lower(F.coalesce(F.get(rules.segments(p), 0), F.lit("")))
    r = requests.select(F.col("id").alias("source_id"), F.upper("verb").alias("verb"), F.col("path").alias("rp"))
    r = r.withColumns({"n": F.size(rules.segments(F.col("rp"))), "head": F.explode(F.array_distinct(F.array(first(F.col("rp")), F.lit("*"))))})
    e = endpoints.select(F.col("id").alias("target_id"), F.upper("verb").alias("verb"), F.col("path").alias("ep"))
    e = e.withColumns({"n": F.size(rules.segments(F.col("ep"))), "head": F.when(first(F.col("ep")).startswith("{"), "*").otherwise(first(F.col("ep")))})
    return r.join(e, ["verb", "n", "head"]).where(rules.route_matches(F.col("rp"), F.col("ep"))).select("source_id", "target_id").distinct()


def rebuild_global(relations: DataFrame, known: DataFrame, matches: DataFrame) -> DataFrame:
    """All relations anew: without old route matches and unknown sources, with the new matches, distinct."""
    kept = relations.where("kind <> 'matches_endpoint'").join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    new = matches.select("source_id", "target_id", F.lit("framework").alias("domain"), F.lit("matches_endpoint").alias("kind"))
    return kept.select("source_id", "target_id", "domain", "kind").unionByName(new).distinct()


def registration_edges(registrations: DataFrame, members: DataFrame, implementations: DataFrame) -> DataFrame:
    """Services to implementations (resolves_to), and each interface member to its implementations' (dispatches_to).

    registrations: (service_id, implementation_id, lifetime); members: (service_id, member_id);
    implementations: (member_id, implementation_id, method_id).
    """
    r = registrations.select("service_id", "implementation_id").distinct()
    direct = r.select(F.col("service_id").alias("source_id"), F.col("implementation_id").alias("target_id"), F.lit("resolves_to").alias("kind"))
    # A member is of few services, so implementations meet their services by the member first; a registration then only tells which
    # of these stay. (By the service, each registration would meet all members.) Both move once, for the distinct rows and for the join.
    m, i = (x.repartition("member_id").distinct() for x in (members.select("service_id", "member_id"), implementations.select("member_id", "implementation_id", "method_id")))
    fan = m.join(i, "member_id").join(r, ["service_id", "implementation_id"], "left_semi")
    return direct.unionByName(fan.select(F.col("member_id").alias("source_id"), F.col("method_id").alias("target_id"), F.lit("dispatches_to").alias("kind"))).distinct()


def sql_facts(texts: DataFrame) -> DataFrame:
    """(id, object, effect): what a SQL text touches, and how."""
    return texts.select("id", F.explode(rules.sql_objects(F.col("text"))).alias("object"), rules.sql_effect(F.col("text")).alias("effect"))


def middleware_chain(uses: DataFrame) -> DataFrame:
    """Middleware in source order within (source, file): place, and the one before. uses: (source_id, file_id, line, col, middleware_id)."""
    w = W.partitionBy("source_id", "file_id").orderBy("line", "col", "middleware_id")
    return uses.withColumns({"place": F.row_number().over(w), "before_id": F.lag("middleware_id").over(w)})


def group_prefixes(groups: DataFrame, most: int = 8) -> DataFrame:
    """(id, prefix): the routes of nested groups, outermost first. groups: (id, parent_id, route)."""
    out = groups.select("id", F.col("parent_id").alias("up"), F.col("route").alias("prefix"))
    parents = groups.select(F.col("id").alias("p_id"), F.col("parent_id").alias("p_up"), F.col("route").alias("p_route"))
    for _ in range(most - 1):
        out = out.join(parents, F.col("up") == F.col("p_id"), "left").select("id", F.col("p_up").alias("up"), F.concat_ws("/", "p_route", "prefix").alias("prefix"))
    return out.select("id", F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("prefix", "/+", "/"), "^/|/$", "")).alias("prefix"))


def unify_tables(mapped: DataFrame, known: DataFrame) -> DataFrame:
    """Mapped tables by the known object of that name, in any case, else under a key of their own."""
    k = known.groupBy(F.lower("qualified_name").alias("l")).agg(F.min("stable_key").alias("known_key"))
    own: Column = stable_key("database_object", F.lower("table_name"))
    return mapped.withColumn("l", F.lower("table_name")).join(k, "l", "left").select("entity_id", "table_name", F.coalesce("known_key", own).alias("table_key"), F.col("known_key").isNotNull().alias("existing"))


def table_names(entities: DataFrame) -> DataFrame:
    """(entity_id, table_name): the fluent name, else the attribute's, else the set's; the schema likewise."""
    name = F.coalesce("fluent_table", "attribute_table", "set_name")
    schema = F.coalesce("fluent_schema", "attribute_schema", "default_schema")
    return entities.select("entity_id", F.concat_ws(".", schema, name).alias("table_name"))


def keys_and_indexes(columns: DataFrame) -> DataFrame:
    """(source, target, kind) of primary keys and indexes. columns: (table_name, object_name, is_key, column_names array)."""
    x = columns.select("table_name", "object_name", "is_key", F.explode("column_names").alias("c"))
    includes = x.select(F.col("object_name").alias("source"), F.concat_ws(".", "table_name", "c").alias("target"), F.lit("includes_column").alias("kind"))
    has = columns.select(F.col("table_name").alias("source"), F.col("object_name").alias("target"), F.when(F.col("is_key"), "has_primary_key").otherwise("has_index").alias("kind"))
    back = columns.select(F.col("object_name").alias("source"), F.col("table_name").alias("target"), F.when(F.col("is_key"), "primary_key_of").otherwise("indexes").alias("kind"))
    return includes.unionByName(has).unionByName(back)


def nearest_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol of the file whose span holds the reference, else its project. refs: (ref_id, file_id, line, project_id)."""
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "first_line", "last_line")
    x = refs.join(s, "file_id").where("line between first_line and last_line")
    best = first_of(x, ["ref_id"], [F.col("last_line") - F.col("first_line"), "symbol_id"]).select("ref_id", "symbol_id")
    return refs.join(best, "ref_id", "left").withColumn("source_id", F.coalesce("symbol_id", "project_id"))


def declarations(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """Declared symbols of known kinds with each of their places: the first is the definition, others are parts of it.

    symbols: (stable_key, project_key, kind, name, qualified_name, signature, visibility, container_key), spans: (stable_key, path, start_line).
    A symbol without a container is the project's.
    """
    known = symbols.where(F.col("kind").isin(SYMBOL_KINDS))
    place = F.row_number().over(W.partitionBy("stable_key").orderBy("path", "start_line"))
    at = spans.withColumn("location_kind", F.when(place == 1, "definition").otherwise("partial_definition"))
    x = known.withColumn("container_key", F.coalesce("container_key", "project_key")).join(at, "stable_key")
    return x.select("stable_key", "kind", "name", "qualified_name", "signature", "visibility", "container_key", "path", "start_line", "location_kind")


def ef_columns(properties: DataFrame) -> DataFrame:
    """(entity_id, property, column, nullable, is_key) of an entity's scalar properties: what the fluent calls say, else attributes, else the convention.

    properties: (entity_id, entity_name, property, fluent_column, attribute_column, fluent_required, annotated_nullable, has_key_attribute, fluent_key).
    By convention a property is the key if it is called Id or by the entity's name and Id, in any case; a key is never null.
    """
    conventional = F.lower("property").isin("id") | (F.lower("property") == F.concat(F.lower("entity_name"), F.lit("id")))
    key = F.coalesce("fluent_key", F.col("has_key_attribute") | conventional)
    nullable = F.when(key, False).when(F.col("fluent_required").isNotNull(), ~F.col("fluent_required")).otherwise(F.coalesce("annotated_nullable", F.lit(False)))
    return properties.select("entity_id", "property", F.coalesce("fluent_column", "attribute_column", "property").alias("column"), nullable.alias("nullable"), key.alias("is_key"))


def ef_indexes(indexes: DataFrame) -> DataFrame:
    """(entity_id, name, is_unique, column_names): an index without a name is called by its table and properties. indexes: (entity_id, table_name, given_name, is_unique, column_names)."""
    name = F.coalesce("given_name", F.concat_ws("_", F.lit("IX"), "table_name", F.array_join("column_names", "_")))
    return indexes.where(F.size("column_names") > 0).select("entity_id", name.alias("name"), F.coalesce("is_unique", F.lit(False)).alias("is_unique"), "column_names")
