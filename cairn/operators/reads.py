"""Point reads, counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_one_identity(stable_key: str | None, entity_id: int | None) -> None:
    if (stable_key is None) == (entity_id is None):
        raise ValueError("give exactly one of stable_key and entity_id")


def graph_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) for each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def kind_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def project_summary(entities: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, name, n_files, n_generated, n_dependencies) of every project."""
    n = files.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("f"), F.sum(F.col("is_generated").cast("bigint")).alias("g"))
    d = dependencies.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    return entities.where("kind = 'project'").join(n, "id", "left").join(d, "id", "left").select("id", "name", zero("f", "n_files"), zero("g", "n_generated"), zero("d", "n_dependencies"))


def degrees(relations: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over all domains and kinds."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def entity_detail(entities: DataFrame, relations: DataFrame, entity_id: int, incoming: DataFrame | None = None) -> DataFrame:
    """The entity with its degrees; the filters reach the scans. `incoming`: the relations sorted by target."""
    count = lambda df, end, name: df.where(F.col(end) == entity_id).agg(F.count(F.lit(1)).alias(name))
    into, out = count(relations if incoming is None else incoming, "target_id", "in_degree"), count(relations, "source_id", "out_degree")
    return entities.where(F.col("id") == entity_id).crossJoin(into).crossJoin(out)


def index_state(runs: DataFrame, capability: str) -> DataFrame:
    """The latest run's status of a capability, 'missing' without one."""
    own = runs.where(F.col("capability") == capability)
    return own.agg(F.coalesce(F.max_by("status", "run_id"), F.lit("missing")).alias("status"), F.count(F.lit(1)).alias("n_runs"))


def orientation_gate(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts, if the orientation's latest run succeeded; else none."""
    ok = index_state(runs, "workspace.orientation").where("status = 'succeeded'").select(F.lit(1).alias("ok"))
    return facts.join(F.broadcast(ok), F.lit(True), "left_semi")


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules and their place: precedence from high to low, then path and line."""
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("precedence"), "path", "line"))
    return rules.withColumn("place", place)


def health_reasons(files: DataFrame, current: DataFrame, runs: DataFrame, schema_version: int, supported: int) -> DataFrame:
    """(reason, n): what is wrong with an index, one row for each reason that applies."""
    gone = files.join(current.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_files").alias("reason"), "n")
    other = current.select("id", F.col("content_hash").alias("h"))
    changed = files.join(other, "id").where("h <> content_hash").agg(F.count(F.lit(1)).alias("n")).select(F.lit("changed_files").alias("reason"), "n")
    failed = runs.where("status = 'failed'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("failed_runs").alias("reason"), "n")
    out = gone.union(changed).union(failed)
    if schema_version > supported:
        out = out.union(out.sparkSession.createDataFrame([("newer_schema", 1)], "reason string, n bigint"))
    return out.where("n > 0")


def foundation_status(generation: int | None, entities: DataFrame, files: DataFrame, relations: DataFrame, requires_rebuild: bool = False) -> DataFrame:
    """(indexing_state, message), one row."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    x = n(entities.where("kind = 'project'"), "p").crossJoin(n(files, "f")).crossJoin(n(relations, "r"))  # one row each
    if generation is None:
        return x.select(F.lit("not_started").alias("indexing_state"), F.lit("no generation has been built").alias("message"))
    state = F.lit("requires_rebuild") if requires_rebuild else F.when(F.col("r") == 0, "not_started").otherwise("current")
    text = F.concat(F.lit(f"generation {generation}: "), F.col("p").cast("string"), F.lit(" projects, "), F.col("f").cast("string"), F.lit(" files, "), F.col("r").cast("string"), F.lit(" relations"))
    return x.select(state.alias("indexing_state"), text.alias("message"))


def entity_states(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, state): current, or entity_not_found, so that an unknown entity is told from one without edges."""
    known = entities.select(F.col("id"), F.lit("current").alias("state")).distinct()
    return asked.select("id").join(known, "id", "left").select("id", F.coalesce("state", F.lit("entity_not_found")).alias("state"))
