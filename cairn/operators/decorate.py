"""Writing claims: subjects, evidence and dependencies of a batch are resolved against the current generation.

Everything is joins on keys; a row that doesn't resolve gives an error with its place. A batch is atomic: with any error
nothing of it is taken.

* updates: (claim_id, stable_key, entity_id, expected_kind, expected_name, update_kind, update, requested_status, confidence)
* evidence: (claim_id, ordinal, kind, source_key, target_key, relation_kind, path, ref_claim, reason); an entity's key is its source_key
* dependencies: (claim_id, ordinal, kind, key, expected, expected_generation)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import ledger

EVIDENCE_KINDS = ["entity", "relation", "source_location", "documentation", "claim", "manual"]
DEPENDENCY_KINDS = ["entity", "file", "relation", "analyzer"]


@dataclass
class Current:
    """What the current generation has.

    entities: (id, stable_key, kind, qualified_name, fingerprint); relations: (id, source_key, target_key, kind, fingerprint);
    files: (stable_key, relative_path, content_hash); claims: (claim_id); analyzers: (name, version).
    """

    generation: int
    entities: DataFrame
    relations: DataFrame
    files: DataFrame
    claims: DataFrame
    analyzers: DataFrame

    def values(self) -> DataFrame:
        """(kind, key, value) of the six kinds that a dependency may have."""
        text = lambda c: F.col(c).cast("string")
        one = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
        out = one(self.entities, "entity", text("stable_key"), F.col("fingerprint"))
        out = out.unionByName(one(self.files, "file", text("stable_key"), F.col("content_hash")))
        out = out.unionByName(one(self.relations, "relation", text("id"), F.col("fingerprint")))
        out = out.unionByName(one(self.relations, "relation_id", text("id"), F.lit("present")))
        out = out.unionByName(one(self.claims, "claim", text("claim_id"), F.lit("present")))
        return out.unionByName(one(self.analyzers, "analyzer", text("name"), F.col("version")))


def resolve_selectors(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds resolved_id and selector_error: by exactly one of key and id, of the expected kind and name if they are given."""
    e = entities.select(F.col("id").alias("r_id"), F.col("stable_key").alias("r_key"), F.col("kind").alias("r_kind"), F.col("qualified_name").alias("r_name"))
    by_key = rows.where("stable_key is not null and entity_id is null").join(e, F.col("stable_key") == F.col("r_key"), "left")
    by_id = rows.where("stable_key is null and entity_id is not null").join(e, F.col("entity_id") == F.col("r_id"), "left")
    none = F.lit(None)
    neither = rows.where("(stable_key is null) = (entity_id is null)").select("*", *[none.cast(e.schema[c].dataType).alias(c) for c in e.columns])
    error = (
        F.when(F.col("stable_key").isNull() == F.col("entity_id").isNull(), "give exactly one of stable_key and entity_id")
        .when(F.col("r_id").isNull(), "not a current entity")
        .when(F.col("expected_kind") != F.col("r_kind"), F.concat(F.lit("expectedKind does not match "), "r_kind"))
        .when(F.col("expected_name") != F.col("r_name"), F.concat(F.lit("expectedQualifiedName does not match "), "r_name"))
    )
    x = by_key.unionByName(by_id).unionByName(neither).withColumn("selector_error", error)
    return x.withColumn("resolved_id", F.when(F.col("selector_error").isNull(), F.col("r_id"))).drop("r_id", "r_key", "r_kind", "r_name")


def resolve_evidence(evidence: DataFrame, now: Current) -> DataFrame:
    """(claim_id, ordinal, kind, dependency_kind, key, expected, error): what each piece of evidence makes its claim depend on; a manual one on nothing."""
    e = now.entities.select(F.col("stable_key").alias("source_key"), "fingerprint", F.lit(True).alias("there"))
    r = now.relations.select("source_key", "target_key", F.col("kind").alias("relation_kind"), F.col("id").cast("string").alias("rid"), "fingerprint")
    r = r.groupBy("source_key", "target_key", "relation_kind").agg(F.min(F.struct("rid", "fingerprint")).alias("r")).select("source_key", "target_key", "relation_kind", "r.*")
    f = now.files.groupBy(F.col("relative_path").alias("path")).agg(F.min(F.struct("stable_key", "content_hash")).alias("f")).select("path", "f.*")
    c = now.claims.select(F.col("claim_id").cast("string").alias("ref_claim")).distinct().withColumn("there", F.lit(True))
    base = evidence.withColumn("ref_claim", F.col("ref_claim").cast("string"))

    def rows(df: DataFrame, kind: str | None, key: Column | None, expected: Column | None, error: Column) -> DataFrame:
        text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
        return df.select("claim_id", "ordinal", "kind", text(None if kind is None else F.lit(kind)).alias("dependency_kind"), text(key).alias("key"), text(expected).alias("expected"), error.cast("string").alias("error"))

    unless = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), text)
    of = lambda *kinds: base.where(F.col("kind").isin(*kinds))
    out = rows(of("entity").join(e, "source_key", "left"), "entity", F.col("source_key"), F.col("fingerprint"), unless(F.col("there"), "not a current entity"))
    out = out.unionByName(rows(of("relation").join(r, ["source_key", "target_key", "relation_kind"], "left"), "relation", F.col("rid"), F.col("fingerprint"), unless(F.col("rid").isNotNull(), "not a current relation")))
    out = out.unionByName(rows(of("source_location", "documentation").join(f, "path", "left"), "file", F.col("stable_key"), F.col("content_hash"), unless(F.col("stable_key").isNotNull(), "not a current file")))
    out = out.unionByName(rows(of("claim").join(c, "ref_claim", "left"), "claim", F.col("ref_claim"), F.lit("present"), unless(F.col("there"), "not a claim of this workspace")))
    out = out.unionByName(rows(of("manual"), None, None, None, unless(F.length(F.trim("reason")) > 0, "manual evidence needs a reason")))
    other = base.where(F.col("kind").isNull() | ~F.col("kind").isin(EVIDENCE_KINDS))
    return out.unionByName(rows(other, None, None, None, F.when(F.col("kind") == "route", "routes aren't stored, so they are no evidence").otherwise("unknown kind of evidence")))


def explicit_dependencies(dependencies: DataFrame, now: Current) -> DataFrame:
    """(claim_id, ordinal, kind, key, expected, error); a relation's dependency is on its id being present."""
    base = dependencies.withColumn("key", F.col("key").cast("string"))
    e = now.entities.select(F.col("stable_key").alias("key"), F.col("fingerprint").alias("is"))
    f = now.files.groupBy(F.col("relative_path").alias("key")).agg(F.min(F.struct("stable_key", "content_hash")).alias("f")).select("key", "f.*")
    r = now.relations.select(F.col("id").cast("string").alias("key"), F.lit(True).alias("there"))
    a = now.analyzers.select(F.col("name").alias("key"), F.col("version").alias("expected"), F.lit(True).alias("there")).distinct()
    fresh = F.coalesce(F.col("expected_generation") == now.generation, F.lit(False))

    def rows(df: DataFrame, kind: Column, key: Column, expected: Column, error: Column) -> DataFrame:
        return df.select("claim_id", "ordinal", kind.alias("kind"), key.alias("key"), expected.cast("string").alias("expected"), error.cast("string").alias("error"))

    of = lambda kind: base.where(F.col("kind") == kind)
    out = rows(of("entity").join(e, "key", "left"), F.col("kind"), F.col("key"), F.col("is"), F.when(~fresh, "the entity's generation isn't current").when(F.col("is").isNull(), "not a current entity"))
    out = out.unionByName(rows(of("file").join(f, "key", "left"), F.col("kind"), F.coalesce("stable_key", "key"), F.col("expected"), F.when(F.col("stable_key").isNull(), "not a current file").when(~F.col("expected").eqNullSafe(F.col("content_hash")), "the file's hash isn't current")))
    out = out.unionByName(rows(of("relation").join(r, "key", "left"), F.lit("relation_id"), F.col("key"), F.lit("present"), F.when(~fresh | F.col("there").isNull(), "not a current relation")))
    out = out.unionByName(rows(of("analyzer").join(a, ["key", "expected"], "left"), F.col("kind"), F.col("key"), F.col("expected"), F.when(F.col("there").isNull(), "the analyzer's version isn't current")))
    other = base.where(F.col("kind").isNull() | ~F.col("kind").isin(DEPENDENCY_KINDS))
    return out.unionByName(rows(other, F.col("kind"), F.col("key"), F.col("expected"), F.lit("unknown kind of dependency")))


@dataclass
class Decorated:
    """What a batch adds; without errors only."""

    claims: DataFrame
    evidence: DataFrame
    dependencies: DataFrame
    errors: DataFrame


def decorate(updates: DataFrame, evidence: DataFrame, dependencies: DataFrame, now: Current) -> Decorated:
    """Validates and resolves a batch. errors: (claim_id, place, error); if it has a row, the other frames have none.

    A claim depends on its subject, on what its evidence shows, and on what it names; the same thing counts once.
    """
    x = ledger.validated(resolve_selectors(updates, now.entities))
    proof = resolve_evidence(evidence, now)
    named = explicit_dependencies(dependencies, now)
    errors = x.where("selector_error is not null").select("claim_id", F.lit("subject").alias("place"), F.col("selector_error").alias("error"))
    errors = errors.unionByName(x.where("error is not null").select("claim_id", F.lit("update").alias("place"), "error"))
    at = lambda what: F.concat(F.lit(what + "/"), F.col("ordinal").cast("string")).alias("place")
    errors = errors.unionByName(proof.where("error is not null").select("claim_id", at("evidence"), "error"))
    errors = errors.unionByName(named.where("error is not null").select("claim_id", at("dependencies"), "error"))
    good = F.broadcast(errors.limit(1).select(F.lit(1).alias("bad")))
    keep = lambda df: df.join(good, F.lit(True), "left_anti")
    kinds = evidence.groupBy("claim_id").agg(F.collect_set("kind").alias("kinds"))
    claims = x.join(kinds, "claim_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    status = ledger.granted_status(F.col("requested_status"), F.col("kinds"), F.col("confidence"))
    claims = claims.select("claim_id", F.col("resolved_id").alias("entity_id"), "dimension", "update_kind", "update", status.alias("status"), "confidence")
    subject = claims.join(now.entities.select(F.col("id").alias("entity_id"), "stable_key", "fingerprint"), "entity_id").select("claim_id", F.lit("entity").alias("kind"), F.col("stable_key").alias("key"), F.col("fingerprint").alias("expected"))
    shown = proof.where("dependency_kind is not null").select("claim_id", F.col("dependency_kind").alias("kind"), "key", "expected")
    depends = subject.unionByName(shown).unionByName(named.select("claim_id", "kind", "key", "expected")).distinct()
    return Decorated(keep(claims), keep(proof.select("claim_id", "ordinal", "kind")), keep(depends), errors)
