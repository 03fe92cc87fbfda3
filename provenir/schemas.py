"""Column layouts of the record collections."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

EVIDENCE = (
    "id STRING, source_adapter STRING, adapter_version STRING, source_locator STRING, "
    "raw_content_hash STRING, raw_size_bytes BIGINT, collected_at TIMESTAMP, "
    "observed_at TIMESTAMP, ingest_parameters MAP<STRING,STRING>"
)
# Custody is kept one row per record: its length grows with every copy of the
# same bytes, so an array inside the evidence row would have no bound.
CUSTODY = (
    "evidence_id STRING, seq STRING, actor STRING, action STRING, timestamp TIMESTAMP, "
    "source_locator STRING, source_id STRING"
)
BLOBS = "id STRING, raw BINARY"
EVENTS = (
    "id STRING, event_type STRING, entity_ids ARRAY<STRING>, attributes MAP<STRING,STRING>, "
    "derived_from ARRAY<STRING>, created_at TIMESTAMP"
)
ASSERTIONS = (
    "id STRING, subject_event_id STRING, value TIMESTAMP, precision STRING, "
    "source_evidence_id STRING, asserted_by STRING, created_at TIMESTAMP"
)
ENTITIES = (
    "id STRING, entity_type STRING, identifiers MAP<STRING,STRING>, first_seen TIMESTAMP, "
    "last_seen TIMESTAMP, derived_from ARRAY<STRING>"
)
RELATIONSHIPS = (
    "id STRING, relationship_type STRING, source_entity_id STRING, target_entity_id STRING, "
    "attributes MAP<STRING,STRING>, derived_from ARRAY<STRING>, created_at TIMESTAMP"
)
EVIDENCE_REFS = "ARRAY<STRUCT<kind:STRING,id:STRING>>"
HYPOTHESES = (
    f"id STRING, statement STRING, status STRING, supporting_evidence {EVIDENCE_REFS}, "
    f"contradicting_evidence {EVIDENCE_REFS}, inferred_by STRING, created_at TIMESTAMP"
)
TRACKED_GAPS = (
    "id STRING, absent_source STRING, present_source STRING, absent_source_refinement STRING, "
    "present_source_refinement STRING, interval_start TIMESTAMP, interval_end TIMESTAMP, "
    "corroborating_time_assertion_ids ARRAY<STRING>, "
    "bounding_absent_assertion_ids ARRAY<STRING>, min_gap_seconds DOUBLE, "
    "min_corroborating_events INT, refine_source_by_attribute STRING, status STRING, "
    "annotated_by STRING, annotated_at TIMESTAMP, note STRING"
)
TRACKED_CONTRADICTIONS = (
    "id STRING, subject_event_id STRING, assertion_ids ARRAY<STRING>, status STRING, "
    "annotated_by STRING, annotated_at TIMESTAMP, note STRING"
)
RESPONSES = (
    "participant_id STRING, condition STRING, case_id STRING, question_id STRING, "
    "answer STRING, correct_answer STRING, response_time_ms STRING, timestamp STRING, "
    "optional_notes STRING, study_version STRING, is_developer_validation BOOLEAN"
)

SCHEMAS = {
    "evidence": EVIDENCE,
    "custody": CUSTODY,
    "blobs": BLOBS,
    "events": EVENTS,
    "assertions": ASSERTIONS,
    "entities": ENTITIES,
    "relationships": RELATIONSHIPS,
    "hypotheses": HYPOTHESES,
    "tracked_gaps": TRACKED_GAPS,
    "tracked_contradictions": TRACKED_CONTRADICTIONS,
}


@dataclass(frozen=True)
class Case:
    """The collections of one dataset, as DataFrames."""

    evidence: DataFrame
    custody: DataFrame
    blobs: DataFrame
    events: DataFrame
    assertions: DataFrame
    entities: DataFrame
    relationships: DataFrame
    hypotheses: DataFrame
    tracked_gaps: DataFrame
    tracked_contradictions: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "Case":
        return Case(**{name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
