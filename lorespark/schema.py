"""Canonical table schemas and the fixed values that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _D, _L, _I, _B = T.StringType(), T.TimestampNTZType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_A, _V, _M = T.ArrayType(_S), T.ArrayType(T.FloatType()), T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


KNOWLEDGE = _struct(
    id=_S, title=_S, summary=_S, source=_S, source_ref=_S, source_date=_TS, contacts=_A, organizations=_A, decisions=_A, commitments=_A,
    action_items=_A, tags=_A, project=_S, importance=_S, provenance=_S, source_account=_S, valid_from=_TS, valid_until=_TS, superseded_by=_S,
    embedding=_V, artifact_path=_S, metadata=_M, raw_content=_S, extraction_version=_I, created_at=_TS, updated_at=_TS,
)
ENTITIES = _struct(id=_S, type=_S, canonical_name=_S, email=_S, domain=_S, relationship_type=_S, relationship_confidence=_D, user_label=_S, user_dismissed=_B, first_seen_date=_TS, last_seen_date=_TS, updated_at=_TS)
ALIASES = _struct(entity_id=_S, alias=_S, alias_normalized=_S, source=_S)
MENTIONS = _struct(entity_id=_S, knowledge_item_id=_S, role=_S, direction=_S, mention_date=_TS)
EDGES = _struct(source_entity_id=_S, target_entity_id=_S, edge_type=_S, co_occurrence_count=_L, confidence=_D, valid_at=_TS, invalid_at=_TS, user_denied=_B)
COMMITMENTS = _struct(id=_S, text=_S, owner=_S, assigned_to=_S, due_date=_TS, detected_from=_S, detected_at=_TS, state=_S, state_changed_at=_TS, fulfilled_evidence=_S, project=_S, importance=_S)
ARTIFACTS = _struct(identifier=_S, title=_S, type=_S, version=_I, is_latest=_B, content=_S, project=_S, created_at=_TS)
STAGED_ACTIONS = _struct(id=_L, type=_S, status=_S, payload=_M, project=_S, created_at=_TS, expires_at=_TS, escalation_level=_I, auto_execute_eligible=_B)
PREDICTIONS = _struct(id=_S, prediction_date=T.DateType(), check_by=T.DateType(), domain=_S, subject=_S, confidence=_D, outcome=_S, project=_S)

# Fixed values.
#: Sources whose rows the system made itself; every other source is primary.
DERIVED_SOURCES = ["agent-report", "agent-notification", "briefing", "directive", "training", "cos-insight", "verification"]
IMPORTANCE_ORDER = {"critical": 0, "high": 1, "normal": 2, "low": 3, "noise": 4}
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
TREND_ORDER = {"accelerating": 0, "new_burst": 1, "cold": 2, "decelerating": 3, "steady": 4}
GENERIC_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "me.com", "live.com"]
OPEN_STATES = ["detected", "active", "overdue"]
