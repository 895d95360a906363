"""Table schemas, as versioned steps.  Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: The six moments of an incident, in their order.
MOMENTS = ("start_ts", "first_observed_ts", "it_awareness_ts", "ack_ts", "mitigate_ts", "resolve_ts")
RAW = tuple(f"{m}_raw" for m in MOMENTS)
TEXTS = ("external_id", "title", "description", "severity", "detection_source", "vendor", "service")
PERCENTS = ("impact_pct", "service_health_pct")
METRICS = ("mttd_seconds", "it_awareness_lag_seconds", "mtta_seconds", "time_to_mitigation_seconds", "mttr_seconds")


def _fields(names, kind) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


WARNING = T.StructType(_fields(("code", "message", "details"), T.StringType()))
WARNINGS = T.ArrayType(WARNING)

INCIDENT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("external_id", T.StringType()), T.StructField("fingerprint", T.StringType())]
    + _fields(TEXTS[1:], T.StringType())
    + _fields(PERCENTS, T.LongType())
    + _fields(MOMENTS, T.StringType())
    + _fields(RAW, T.StringType())
)
TIMELINE = T.StructType([T.StructField("id", T.LongType()), T.StructField("incident_id", T.LongType()), *_fields(("source", "ts", "author", "kind", "text", "raw_json", "created_at"), T.StringType())])
ARTIFACT = T.StructType([T.StructField("id", T.LongType()), T.StructField("incident_id", T.LongType()), *_fields(("kind", "sha256", "filename", "mime_type", "text", "created_at"), T.StringType())])
PROFILE = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))])
DRAFT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_fields(("quarter_label", "section_type", "draft_text"), T.StringType()),
        T.StructField("citation_chunk_ids", T.ArrayType(T.StringType())),
        *_fields(("model_name", "model_params_hash", "prompt_template_version", "created_at", "artifact_hash"), T.StringType()),
        T.StructField("parent_draft_id", T.LongType()),
        T.StructField("revision_number", T.IntegerType()),
        *_fields(("revision_notes", "branch_label"), T.StringType()),
    ]
)
SOURCE = T.StructType(_fields(("source_id", "type", "origin_kind", "path", "label", "created_at", "text"), T.StringType()))
CHUNK = T.StructType(
    [
        *_fields(("chunk_id", "source_id"), T.StringType()), T.StructField("ordinal", T.IntegerType()), *_fields(("text", "text_sha256"), T.StringType()), T.StructField("token_count_est", T.IntegerType()),
        T.StructField("meta", T.StructType([T.StructField("incident_keys", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()), T.StructField("time_range", T.StructType(_fields(("end_ts", "start_ts"), T.StringType())))])),
    ]
)
VECTOR = T.StructType([*_fields(("chunk_id", "text_sha256"), T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
TABLES = {"incidents": INCIDENT, "timeline_events": TIMELINE, "artifacts": ARTIFACT, "profiles": PROFILE, "drafts": DRAFT, "sources": SOURCE, "chunks": CHUNK, "vectors": VECTOR}

#: Schema steps in order: name -> what the step adds.
STEPS: dict[str, tuple[str, ...]] = {
    "0001_tables": ("incidents", "timeline_events", "artifacts", "profiles"),
    "0002_raw_timestamps": RAW,
    "0003_story_fields": ("detection_source", "vendor", "service"),
    "0004_drafts": ("drafts",),
    "0005_draft_revisions": ("parent_draft_id", "revision_number", "revision_notes", "branch_label"),
    "0006_draft_hash": ("artifact_hash",),
    "0007_evidence": ("sources", "chunks", "vectors"),
}
