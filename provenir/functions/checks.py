"""Record validity rules, as columns, and argument checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import hashing
from provenir.functions.text import is_blank, source_id_problem
from provenir.functions.times import TOLERANCE_SECONDS

REF_KINDS = ("evidence_item", "normalized_event")
HYPOTHESIS_STATUSES = ("proposed", "supported", "contradicted", "withdrawn")
FINDING_STATUSES = ("open", "reviewed", "dismissed")
DIRECTIONS = ("out", "in", "both")


def first_problem(rules: list[tuple[Column, str]]) -> Column:
    """The text of the first rule whose condition holds, else null."""
    return F.coalesce(*[F.when(condition, F.lit(text)) for condition, text in rules])


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the rest with a ``reason`` column."""
    marked = df.withColumn("reason", problem)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def _no_lineage(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def evidence_problem() -> Column:
    return first_problem(
        [
            (F.col("id") != F.col("raw_content_hash"), "id differs from raw_content_hash"),
            (F.col("raw_size_bytes") < 0, "raw_size_bytes is negative"),
        ]
    )


def custody_problem() -> Column:
    return source_id_problem(F.col("source_id"))


def event_problem(check_id: bool = False) -> Column:
    rules = [
        (F.col("event_type").isNull() | is_blank(F.col("event_type")), "event_type is blank"),
        (_no_lineage(F.col("derived_from")), "derived_from is empty"),
    ]
    if check_id:
        expected = hashing.event_id(F.col("event_type"), F.col("attributes"), F.col("derived_from"))
        rules.append((F.col("id") != expected, "id is not the content hash"))
    return first_problem(rules)


def assertion_problem() -> Column:
    return first_problem(
        [
            (F.col("value").isNull(), "value is missing"),
            (~F.col("precision").isin(*TOLERANCE_SECONDS), "precision is unknown"),
        ]
    )


def entity_problem() -> Column:
    return first_problem(
        [
            (F.col("entity_type").isNull() | is_blank(F.col("entity_type")), "entity_type is blank"),
            (_no_lineage(F.col("derived_from")), "derived_from is empty"),
        ]
    )


def relationship_problem() -> Column:
    return first_problem(
        [
            (is_blank(F.col("relationship_type")), "relationship_type is blank"),
            (
                is_blank(F.col("source_entity_id")) | is_blank(F.col("target_entity_id")),
                "an endpoint is blank",
            ),
            (F.col("source_entity_id") == F.col("target_entity_id"), "endpoints are equal"),
            (_no_lineage(F.col("derived_from")), "derived_from is empty"),
        ]
    )


def hypothesis_problem() -> Column:
    refs = F.concat(F.col("supporting_evidence"), F.col("contradicting_evidence"))
    return first_problem(
        [
            (is_blank(F.col("statement")), "statement is blank"),
            (is_blank(F.col("inferred_by")), "inferred_by is blank"),
            (~F.col("status").isin(*HYPOTHESIS_STATUSES), "status is unknown"),
            (F.exists(refs, lambda r: ~r["kind"].isin(*REF_KINDS)), "a reference kind is unknown"),
            (F.size(refs) == 0, "no evidence is referenced"),
        ]
    )


def annotation_problem() -> Column:
    """Who and when come together or not at all, and who is never blank."""
    by, at = F.col("annotated_by"), F.col("annotated_at")
    return first_problem(
        [
            (by.isNull() != at.isNull(), "annotated_by and annotated_at must come together"),
            (by.isNotNull() & is_blank(by), "annotated_by is blank"),
        ]
    )


def require_depth(max_depth: int | None) -> None:
    if max_depth is not None and max_depth < 1:
        raise ValueError(f"max_depth must be at least 1 or None, got {max_depth}")


def require_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1 or None, got {limit}")


def require_direction(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")


def require_positive(name: str, value: int) -> None:
    if value < 1:
        raise ValueError(f"{name} must be at least 1, got {value}")


def reverse_direction(direction: str) -> str:
    return {"out": "in", "in": "out", "both": "both"}[direction]
