"""The claim ledger: validation, resolution, status, fingerprints, freshness, reviews."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import digest
from cairn.operators.edges import bounded
from cairn.schema import GROUP_KINDS, UPDATE_SHAPES, VOCABULARIES

OPERATION_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")


def check_envelope(batch: dict, workspace: str) -> str:
    """Raises on a batch that can't be taken; its payload hash otherwise."""
    if batch.get("schemaVersion") != "1.0":
        raise ValueError("schemaVersion must be 1.0")
    if batch.get("workspaceKey") != workspace:
        raise ValueError("the batch is for another workspace")
    if not OPERATION_ID.fullmatch(str(batch.get("operationId", ""))):
        raise ValueError("operationId has 1 to 128 letters, digits and . _ : -")
    if not 1 <= len(batch.get("updates", [])) <= 500:
        raise ValueError("a batch has 1 to 500 updates")
    if batch.get("conflictPolicy", "atomic") != "atomic":
        raise ValueError("only atomic batches are supported")
    text = json.dumps(batch, sort_keys=True, separators=(",", ":"))
    if len(text.encode()) > 1 << 20:
        raise ValueError("a batch is at most 1 MiB")
    return hashlib.sha256(text.encode()).hexdigest()


def replay(sessions: DataFrame, operation: str, payload_hash: str, dry_run: bool = False) -> str | None:
    """The stored result of the same operation; raises if its payload was another. A dry run has none."""
    if dry_run:
        return None
    row = sessions.where(F.col("operation_id") == operation).select("payload_hash", "result_json").first()
    if row is None:
        return None
    if row.payload_hash != payload_hash:
        raise ValueError("the operation id was used with another payload")
    return row.result_json


def validated(updates: DataFrame) -> DataFrame:
    """Adds dimension and error (null if valid). updates: (update_kind, update json)."""
    spark = updates.sparkSession
    rules = spark.createDataFrame([(k, d, r, sorted({"kind", *r, *a})) for k, (d, r, a) in UPDATE_SHAPES.items()], "update_kind string, dimension string, required array<string>, allowed array<string>")
    x = updates.join(F.broadcast(rules), "update_kind", "left").withColumn("v_keys", F.expr("json_object_keys(update)"))
    missing, extra = F.array_except("required", "v_keys"), F.array_except("v_keys", "allowed")
    error = F.when(F.col("dimension").isNull(), F.lit("unknown update kind")).when(F.col("v_keys").isNull(), F.lit("not an object"))
    error = error.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ","))).when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(extra), ",")))
    for name, values in VOCABULARIES.items():
        kind, prop = name.split(".")
        given = F.get_json_object("update", f"$.{prop}")
        error = error.when((F.col("update_kind") == kind) & given.isNotNull() & ~given.isin(values), F.concat(F.lit(f"{prop} isn't one of its values: "), given))
    group = F.get_json_object("update", "$.group.kind")
    error = error.when(group.isNotNull() & ~group.isin(GROUP_KINDS), F.concat(F.lit("group isn't of one of its kinds: "), group))
    return x.withColumn("error", error).drop("v_keys", "required", "allowed")


def granted_status(requested: Column, evidence_kinds: Column, confidence: Column) -> Column:
    """accepted needs evidence that isn't manual and a confidence of 0.8; else it is only proposed."""
    enough = F.exists(evidence_kinds, lambda k: k != "manual") & (confidence >= 0.8)
    return F.when((requested == "accepted") & ~F.coalesce(enough, F.lit(False)), "proposed").otherwise(requested)


REVIEWS = {"revalidate": "accepted", "dispute": "disputed", "reject": "rejected", "supersede": "superseded"}


def reviewed(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims with the status of their latest review. reviews: (claim_id, seq, action)."""
    known = F.create_map(*[F.lit(x) for kv in REVIEWS.items() for x in kv])
    last = reviews.groupBy("claim_id").agg(F.max_by("action", "seq").alias("action"))
    x = claims.join(last, "claim_id", "left")
    return x.withColumn("status", F.coalesce(F.element_at(known, F.col("action")), "status")).drop("action")


def entity_fingerprints(entities: DataFrame, located: DataFrame) -> DataFrame:
    """(entity_id, fingerprint) of kind, name, signature and the hashes of the files it is in. located: (entity_id, content_hash)."""
    h = located.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("content_hash")), ",").alias("hashes"))
    x = entities.join(h, F.col("id") == F.col("entity_id"), "left")
    return x.select(F.col("id").alias("entity_id"), digest("kind", "qualified_name", "signature", "hashes").alias("fingerprint"))


def relation_fingerprints(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("id").alias("relation_id"), digest("source_id", "target_id", "domain", "kind", "dispatch_kind", "logical_scope").alias("fingerprint"))


def freshness(dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """(claim_id, n_stale, reason): a claim is stale if a dependency's value isn't the expected one any more.

    current: (kind, key, value), the union of what each kind of dependency is worth now.
    """
    x = dependencies.join(current, ["kind", "key"], "left")
    ok = F.col("expected").eqNullSafe(F.col("value"))
    reason = F.when(F.col("value").isNull(), F.concat("kind", F.lit(" "), "key", F.lit(" no longer exists"))).otherwise(F.concat("kind", F.lit(" "), "key", F.lit(" changed")))
    return x.groupBy("claim_id").agg(F.sum((~ok).cast("bigint")).alias("n_stale"), F.min(F.when(~ok, reason)).alias("reason"))


def assessments(claims: DataFrame, fresh: DataFrame, entity_id: int, proposed: bool = True, stale: bool = False, history: bool = False, limit: int = 50) -> DataFrame:
    """Claims about an entity: accepted first, then by confidence, newest first."""
    bounded(limit, 1, 200, "limit")
    status = ["accepted"] + ["proposed"] * proposed + ["disputed", "rejected", "superseded"] * history
    own = claims.where((F.col("entity_id") == entity_id) & F.col("status").isin(status)).orderBy(F.desc("updated"), F.desc("claim_id")).limit(min(limit * 10, 5000))
    x = own.join(fresh.select("claim_id", "n_stale"), "claim_id", "left").withColumn("is_stale", F.coalesce(F.col("n_stale") > 0, F.lit(False)))
    if not stale:
        x = x.where(~F.col("is_stale"))
    return x.orderBy(F.when(F.col("status") == "accepted", 0).otherwise(1), F.desc("confidence"), F.desc("updated"), "claim_id").limit(limit + 1).drop("n_stale")
