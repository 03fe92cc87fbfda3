"""Canonical JSON text and the content ids built on it, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.functions.times import canonical_timestamp

# The JSON short escapes, keyed by UTF-16 code unit.
_SHORT_ESCAPES = {
    "0008": "\\b",
    "0009": "\\t",
    "000a": "\\n",
    "000c": "\\f",
    "000d": "\\r",
    "0022": '\\"',
    "005c": "\\\\",
}
_MANIFEST_TYPES = ("NormalizedEvent", "TimeAssertion", "Relationship", "GapFinding", "TimeContradiction")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def packed_id(c: Column) -> Column:
    """An id as bytes, for shuffles: a mark, then 32 bytes of a SHA-256 in hex, or the text of any other id."""
    digest = F.concat(F.lit(b"\x01"), F.unhex(c))
    # Most other texts are told by their length, without the pattern.
    return F.when((F.length(c) == 64) & c.rlike(r"\A[0-9a-f]{64}\z"), digest).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpacked_id(c: Column) -> Column:
    body = F.substring(c, 2, 2_147_483_647)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(body.cast("string"))


def json_text(c: Column) -> Column:
    """A quoted ASCII-only JSON string; null stays null.

    Printable ASCII needs two replaces. Other text goes through its UTF-16
    code units, which gives surrogate pairs for free; the branch is only
    evaluated for rows that need it.
    """
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("(.{4})"), F.lit(1))

    # Refers to its argument only: anything else would be evaluated per character.
    def escape_unit(unit: Column) -> Column:
        out = F.when(
            unit.between("0020", "007e") & ~unit.isin("0022", "005c"),
            F.chr(F.conv(unit, 16, 10).cast("int")),
        )
        for code, text in _SHORT_ESCAPES.items():
            out = out.when(unit == code, text)
        return out.otherwise(F.concat(F.lit("\\u"), unit))

    escaped = F.array_join(F.transform(units, escape_unit), "")
    body = F.when(c.rlike(r"[^ -~]"), escaped).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))


def json_list(parts: Column) -> Column:
    """A JSON array from an array of already encoded members."""
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def json_strings(c: Column) -> Column:
    """A JSON array of strings, order kept."""
    return json_list(F.transform(c, json_text))


def json_string_map(c: Column) -> Column:
    """A JSON object from a string map, keys sorted by code point."""
    entries = F.transform(
        F.array_sort(F.map_entries(c)),
        lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def json_object(members: dict[str, Column]) -> Column:
    """A JSON object with fixed keys; values are already encoded."""
    parts: list[Column] = []
    for position, key in enumerate(sorted(members)):
        lead = "{" if position == 0 else ","
        parts += [F.lit(f'{lead}"{key}":'), members[key]]
    return F.concat(*parts, F.lit("}"))


def json_timestamp(c: Column) -> Column:
    return F.concat(F.lit('"'), canonical_timestamp(c), F.lit('"'))


def _tag(name: str) -> Column:
    assert name in _MANIFEST_TYPES
    return F.lit(f'"{name}"')


def event_id(event_type: Column, attributes: Column, derived_from: Column) -> Column:
    return sha256_hex(
        json_object(
            {
                "_type": _tag("NormalizedEvent"),
                "event_type": json_text(event_type),
                "attributes": json_string_map(attributes),
                "derived_from": json_strings(derived_from),
            }
        )
    )


def assertion_id(
    subject_event_id: Column,
    value: Column,
    precision: Column,
    source_evidence_id: Column,
    asserted_by: Column,
) -> Column:
    return sha256_hex(
        json_object(
            {
                "_type": _tag("TimeAssertion"),
                "subject_event_id": json_text(subject_event_id),
                "value": json_timestamp(value),
                "precision": json_text(precision),
                "source_evidence_id": json_text(source_evidence_id),
                "asserted_by": json_text(asserted_by),
            }
        )
    )


def relationship_id(
    relationship_type: Column,
    source_entity_id: Column,
    target_entity_id: Column,
    attributes: Column,
    derived_from: Column,
) -> Column:
    return sha256_hex(
        json_object(
            {
                "_type": _tag("Relationship"),
                "relationship_type": json_text(relationship_type),
                "source_entity_id": json_text(source_entity_id),
                "target_entity_id": json_text(target_entity_id),
                "attributes": json_string_map(attributes),
                "derived_from": json_strings(derived_from),
            }
        )
    )


def gap_finding_id(
    absent_source: Column,
    present_source: Column,
    absent_source_refinement: Column,
    present_source_refinement: Column,
    interval_start: Column,
    interval_end: Column,
    corroborating_ids: Column,
    bounding_ids: Column,
) -> Column:
    return gap_finding_digest(
        {
            "absent_source": json_text(absent_source),
            "present_source": json_text(present_source),
            "absent_source_refinement": json_or_null(json_text(absent_source_refinement)),
            "present_source_refinement": json_or_null(json_text(present_source_refinement)),
            "interval_start": json_timestamp(interval_start),
            "interval_end": json_timestamp(interval_end),
            "corroborating_time_assertion_ids": json_strings(corroborating_ids),
            "bounding_absent_assertion_ids": json_strings(bounding_ids),
        }
    )


def gap_finding_digest(members: dict[str, Column]) -> Column:
    """A finding's id from its members, each encoded already."""
    return sha256_hex(json_object({"_type": _tag("GapFinding"), **members}))


def contradiction_id(subject_event_id: Column, first_id: Column, second_id: Column) -> Column:
    """Id of an unordered pair; a pair of equal ids is an error."""
    pair = F.sort_array(F.array(first_id, second_id))
    digest = sha256_hex(
        json_object(
            {
                "_type": _tag("TimeContradiction"),
                "subject_event_id": json_text(subject_event_id),
                "assertion_ids": json_strings(pair),
            }
        )
    )
    return F.when(
        first_id == second_id, F.raise_error(F.lit("a contradiction needs two distinct ids"))
    ).otherwise(digest)


def entity_hash(prefix: str = "") -> Column:
    """Hash over every field of an entity row (UTC timestamps)."""
    c = lambda name: F.col(f"{prefix}{name}")
    return sha256_hex(
        json_object(
            {
                "id": json_text(c("id")),
                "entity_type": json_text(c("entity_type")),
                "identifiers": json_string_map(c("identifiers")),
                "first_seen": json_or_null(json_timestamp(c("first_seen"))),
                "last_seen": json_or_null(json_timestamp(c("last_seen"))),
                "derived_from": json_strings(c("derived_from")),
            }
        )
    )


def _json_refs(c: Column) -> Column:
    return json_list(
        F.transform(
            c, lambda r: json_object({"kind": json_text(r["kind"]), "id": json_text(r["id"])})
        )
    )


def hypothesis_hash(prefix: str = "") -> Column:
    """Hash over every field of a hypothesis row (UTC timestamps)."""
    c = lambda name: F.col(f"{prefix}{name}")
    return sha256_hex(
        json_object(
            {
                "id": json_text(c("id")),
                "statement": json_text(c("statement")),
                "status": json_text(c("status")),
                "supporting_evidence": _json_refs(c("supporting_evidence")),
                "contradicting_evidence": _json_refs(c("contradicting_evidence")),
                "inferred_by": json_text(c("inferred_by")),
                "created_at": json_timestamp(c("created_at")),
            }
        )
    )


def hash_mod3(text: Column) -> Column:
    """``sha256(text)`` read as an integer, modulo 3.

    16 leaves remainder 1 modulo 3, so the digit sum has the same remainder.
    """
    digits = F.split(sha256_hex(text), "")
    total = F.aggregate(
        digits,
        F.lit(0),
        lambda acc, d: acc + F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0)),
    )
    return (total % 3).cast("int")
