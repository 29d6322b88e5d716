"""The tables of the store."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MEMORY = _struct(
    tenant=_S,
    id=_S,
    namespace=_S,
    content=_S,
    embedding=T.ArrayType(T.FloatType(), False),
    tags=T.ArrayType(_S),
    supersedes=_S,
    superseded_by=_S,
    superseded_at=_TS,
    source_client=_S,
    embedding_model=_S,
    sensitivity=_S,
    occurred_at=_TS,
    occurred_until=_TS,
    access_count=_L,
    last_accessed_at=_TS,
    last_confirmed_at=_TS,
    created_at=_TS,
)
PROVENANCE = _struct(client=_S, conv_id=_S, verified=_B)
REGISTRY = _struct(tenant=_S, namespace=_S, kind=_S, key=_S, value=_S, provenance=PROVENANCE, sensitivity=_S, version=_L, review_after=_TS, created_at=_TS)
REGISTRY_HISTORY = _struct(tenant=_S, registry_id=_S, namespace=_S, kind=_S, key=_S, value=_S, provenance=PROVENANCE, sensitivity=_S, version=_L, replaced_at=_TS)
REGISTRY_ALIAS = _struct(tenant=_S, namespace=_S, kind=_S, alias_key=_S, canonical=_S, origin=_S)
ENTITY_ALIAS = _struct(tenant=_S, namespace=_S, alias=_S, canonical=_S, since=_TS, until=_TS, origin=_S, created_at=_TS)
EDGE = _struct(src_id=_S, dst_id=_S, relation=_S, produced_by=_S)
PAIR_DISMISSED = _struct(lo_id=_S, hi_id=_S, dismissed_by=_S, dismissed_token=_S, dismissed_at=_TS)
CARDINALITY = _struct(tag=_S, arity=_S, note=_S, declared_at=_TS)
CLEANUP_PROPOSAL = _struct(id=_S, cluster_key=_S, kind=_S, namespace=_S, keep_id=_S, rationale=_S, produced_by=_S, posted_by=_S, similarity=T.DoubleType(), state=_S, reason=_S, decided_at=_TS, created_at=_TS)
CLEANUP_MEMBER = _struct(proposal_id=_S, memory_id=_S, content=_S)
CLEANUP_WATERMARK = _struct(scope=_S, cadence=_S, through=_TS)
INGEST_PROPOSAL = _struct(
    id=_S, fingerprint=_S, content=_S, namespace=_S, tags=T.ArrayType(_S), supersedes=_S, speaker=_S, quote=_S, auto=_B, extractor=_S, posted_by=_S, state=_S, memory_id=_S, last_error=_S, last_error_at=_TS, decided_at=_TS, created_at=_TS
)
INGEST_SOURCE = _struct(proposal_id=_S, run_id=_S, file_path=_S, session_id=_S, entry_id=_S, observed_at=_TS)
INGEST_WATERMARK = _struct(file_path=_S, source=_S, byte_offset=_L, prefix_sha256=_S, skip_reason=_S, updated_at=_TS)
EMISSION = _struct(content_sha256=_S, memory_id=_S, tool=_S, session_id=_S, first_emitted_at=_TS, last_emitted_at=_TS, emit_count=_L)
TOOL_CALLS = _struct(client=_S, tool=_S, succeeded=_B, unprompted=_B, latency_ms=T.IntegerType(), session_id=_S, namespace=_S, created_at=_TS)
SENSITIVITY_DEFAULT = _struct(pattern=_S, sensitivity=_S)
SEALED_ITEM = _struct(tenant=_S, namespace=_S, key_hmac=_S, created_at=_TS)
