"""Graph tables, fact-row inputs and controlled vocabularies."""

from __future__ import annotations

ENTITIES = "id bigint, stable_key string, kind string, name string, qualified_name string, language string, containing_id bigint, signature string, visibility string"
RELATIONS = "id bigint, source_id bigint, target_id bigint, domain string, kind string, dispatch_kind string, logical_scope string"
EVIDENCE = "relation_id bigint, file_id bigint, analyzer string, start_line int, start_column int, end_line int, end_column int"
LOCATIONS = "entity_id bigint, file_id bigint, location_kind string, start_line int, start_column int, end_line int, end_column int"
FILES = "id bigint, stable_key string, project_id bigint, root_path string, relative_path string, language string, content_hash string, size_bytes bigint, is_generated boolean"

SYMBOL_KINDS = (
    "namespace record_struct record class struct interface enum delegate constructor destructor operator conversion_operator "
    "method indexer property enum_member constant field event symbol"
).split()
DISCOVERY_KINDS = ["workspace", "solution", "project", "file"]
FRAMEWORK_KINDS = "http_endpoint http_request service_registration test_case minimal_api_handler middleware framework_registration endpoint_mapping authorization_policy".split()
DATABASE_KINDS = "database_operation database_object database_column primary_key database_index ef_db_context migration migration_operation".split()
DEFAULT_DOMAINS = ["code", "framework", "database"]
HIGH_FANOUT = ["reads", "writes", "uses_type"]

#: Update kinds of claims, one a line: kind, dimension: required properties | optional ones.
_SHAPES = """
add_alias aliases: alias aliasKind | locale
add_membership membership: group participantRole strength | ordinal
classify_role architecture: layer role | customRole responsibility
connect_nodes behavior: relationKind target | routeRole
describe_behavior behavior: responsibility | asyncBoundary inputs outputs postconditions preconditions sideEffects transactionBoundary
link_documentation documentation: relationKind | documentId heading path
link_test tests: coverageKind target | scenarios verificationCommand
mark_landmark landmarks: importance landmarkKind |
record_change_guidance change_surface: classification reason | editInstead verification
record_constraint constraints: constraintKind rule strength | consequence
record_contract contracts: compatibility contractRole target | format
record_design_intent intent: intentKind rationale | expiresWhen
record_effect effects: effectKind | direct operation resource target
record_failure failure: failureKind outcome | retryable target transportStatus
record_lifecycle lifecycle: boundary lifetime | cancellation concurrency retry transaction
record_precedent precedent: applicability recommendation target | importantDifferences
report_knowledge_gap knowledge_gaps: gapKind question | blocksReuse suggestedQueries
resolve_dynamic_target runtime: mechanism target | alternatives resolutionScope
review_assessment reviews: action claimId reason |
"""
#: Values of controlled properties, one a line.
_VALUES = """
add_alias.aliasKind: acronym database_name domain_term external_name legacy_name search_term ui_label
add_membership.strength: core related supporting
classify_role.layer: application build cross_cutting data domain frontend infrastructure integration presentation test unknown
classify_role.role: application_service composition_root data_access domain_logic domain_service endpoint external_gateway filter frontend_component frontend_hook generated_output handler mapper message_consumer message_producer middleware migration other repository scheduler service state_store test_fixture validator worker
connect_nodes.relationKind: alternate_to configures consumes_from crosses_boundary_to delegates_to depends_on_runtime follows guards implements_intent_of orchestrates persists_through precedes publishes_to similar_to transforms_to validates
link_documentation.relationKind: decision_for deprecates example_for explains governs runbook_for
link_test.coverageKind: contract end_to_end fixture integration snapshot unit
mark_landmark.landmarkKind: bridge composition_root data_boundary entry_point high_usage hotspot public_contract security_boundary
record_change_guidance.classification: do_not_edit generated_source_only likely_change must_change verify
record_constraint.constraintKind: architecture compatibility data generation operational performance security testing
record_constraint.strength: advisory enforced preferred required
record_contract.compatibility: internal private public unknown
record_contract.contractRole: command configuration database_row event request response serialization ui_model
record_design_intent.intentKind: compatibility_requirement deprecation design_decision migration_strategy operational_assumption performance_assumption security_assumption temporary_workaround
record_effect.effectKind: cache_read cache_write database_read database_write external_call file_io message_consume message_publish other state_change telemetry
record_failure.failureKind: authentication authorization cancellation concurrency conflict not_found other permanent_dependency timeout transient_dependency unhandled validation
record_lifecycle.boundary: background component message other process request transaction
record_lifecycle.lifetime: background_iteration component custom process request scoped singleton transient unknown
record_precedent.recommendation: avoid conditional use
report_knowledge_gap.gapKind: ambiguous_pattern configuration_gap dynamic_behavior insufficient_evidence missing_test other stale_documentation unresolved_target
resolve_dynamic_target.mechanism: configuration_binding dependency_injection dynamic_dispatch generated_source other reflection route_binding runtime_registration
review_assessment.action: dispute reject revalidate supersede
"""
GROUP_KINDS = "architectural_boundary blueprint bounded_context business_capability cross_cutting_concern feature pattern subsystem workflow".split()


def _shape(line: str) -> tuple[str, tuple[str, list[str], list[str]]]:
    head, _, rest = line.partition(": ")
    kind, dimension = head.split()
    required, _, optional = rest.partition("|")
    return kind, (dimension, required.split(), optional.split())


UPDATE_SHAPES: dict[str, tuple[str, list[str], list[str]]] = dict(map(_shape, _SHAPES.strip().splitlines()))
VOCABULARIES: dict[str, list[str]] = {k: v.split() for k, _, v in (x.partition(": ") for x in _VALUES.strip().splitlines())}
