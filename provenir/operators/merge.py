"""Merging new records into collections: first wins, last wins, or conflict.

All groupings are built from mergeable aggregates, so a group of copies of any
size is folded on the map side before the shuffle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions import hashing
from provenir.functions.hashing import json_string_map
from provenir.schemas import Case
from provenir.session import cut
from provenir.sources.records import Records

CUSTODY_VALUE = ["evidence_id", "actor", "action", "timestamp", "source_locator", "source_id"]


class EventConflict(RuntimeError):
    """An incoming event shares an id with a stored one but differs from it."""


def keep_first(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per key: the one with the lowest ``seq`` (dropped)."""
    return _pick(df, key, seq, F.min_by)


def keep_last(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per key: the one with the highest ``seq`` (dropped)."""
    return _pick(df, key, seq, F.max_by)


def _pick(df: DataFrame, key: str, seq: str, by) -> DataFrame:
    columns = [c for c in df.columns if c not in (key, seq)]
    picked = df.groupBy(key).agg(by(F.struct(*columns), F.col(seq)).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in columns]).select(
        *[c for c in df.columns if c != seq]
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows unchanged, plus the first incoming row of every new key."""
    fresh = keep_first(incoming, key).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The last incoming row of a key replaces the existing one."""
    latest = keep_last(incoming, key)
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest)


def merge_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """First-seen fields of a content id are kept."""
    return insert_if_absent(existing, incoming)


def distinct_custody(custody: DataFrame) -> DataFrame:
    """Custody records distinct by full value, each at its first ``seq``."""
    return custody.groupBy(*CUSTODY_VALUE).agg(F.min("seq").alias("seq")).select(*custody.columns)


def _new_custody(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    condition = F.col("n.evidence_id") == F.col("o.evidence_id")
    for c in CUSTODY_VALUE[1:]:
        condition = condition & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return incoming.alias("n").join(existing.alias("o"), condition, "left_anti")


def merge_custody(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add the records whose full value, time included, is not there yet."""
    return existing.unionByName(_new_custody(existing, distinct_custody(incoming)))


def append_custody(custody: DataFrame, records: DataFrame) -> DataFrame:
    """Append custody rows as they are; ids and manifests are not affected."""
    return custody.unionByName(records.select(*custody.columns))


def custody_array(evidence: DataFrame, custody: DataFrame) -> DataFrame:
    """Evidence with its records nested in first-seen order, for export shapes."""
    record = F.struct("seq", "actor", "action", "timestamp", "source_locator", "source_id")
    nested = custody.groupBy(F.col("evidence_id").alias("id")).agg(
        F.transform(
            F.sort_array(F.collect_list(record)),
            lambda r: F.struct(
                r["actor"].alias("actor"),
                r["action"].alias("action"),
                r["timestamp"].alias("timestamp"),
                r["source_locator"].alias("source_locator"),
                r["source_id"].alias("source_id"),
            ),
        ).alias("chain_of_custody")
    )
    return evidence.join(nested, "id", "left")


def _event_value() -> Column:
    """Everything of an event but ``created_at``, as one comparable digest."""
    parts = ("event_type", F.to_json("entity_ids"), json_string_map(F.col("attributes")), F.to_json("derived_from"))
    return F.sha2(F.to_json(F.array(*parts)), 256)


def event_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids under which two events differ in more than ``created_at``."""
    both = existing.select("id", _event_value().alias("v")).unionByName(
        incoming.select("id", _event_value().alias("v"))
    )
    return both.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").select("id")


def merge_events(
    existing: DataFrame, incoming: DataFrame, *, on_conflict: str = "raise"
) -> DataFrame:
    """Insert new events; an equal one is a no-op, a different one a conflict.

    ``raise`` refuses the whole batch before anything is written; ``keep``
    leaves the stored row, for callers that route conflicts elsewhere.
    """
    if on_conflict == "raise":
        hits = [r.id for r in event_conflicts(existing, incoming).orderBy("id").limit(5).collect()]
        if hits:
            raise EventConflict(f"events differ under one id, for example {hits}")
    return insert_if_absent(existing, incoming)


def merge_blobs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One blob per content id; the bytes of one id are equal by definition."""
    new = incoming.join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return existing.unionByName(new)


def merge_records(case: Case, records: Records) -> Case:
    """All collections of ``case`` with one batch merged in."""
    return replace(
        case,
        evidence=merge_evidence(case.evidence, records.evidence),
        custody=merge_custody(case.custody, records.custody),
        blobs=merge_blobs(case.blobs, records.blobs),
        events=merge_events(case.events, records.events),
        assertions=insert_if_absent(case.assertions, records.assertions),
    )


def fresh_rows(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The first incoming row of every key that ``existing`` does not hold.

    The existing keys are first cut down to those the batch names. The batch is
    written, so its size is known: a small one is broadcast, and a large table
    is scanned for its key column only, not shuffled. What is known of it is written too:
    mostly nothing, so the batch stays where it is. Digests are dealt as bytes.
    """
    packed = hashing.packed_id(F.col(key)).alias(key)
    shown = hashing.unpacked_id(F.col(key))
    first = cut(keep_first(incoming.withColumn(key, packed), key).withColumn(key, shown), "fresh")
    known = cut(existing.select(packed).join(first.select(packed), key, "left_semi").withColumn(key, shown), "known")
    return first.join(known, key, "left_anti")


def delta_records(case: Case, records: Records) -> Case:
    """Only the rows one batch adds to ``case``, for stores that append."""
    empty = Case.empty(case.evidence.sparkSession)
    events = cut(records.events, "events")
    touched = case.events.join(events.select("id").distinct(), "id", "left_semi")
    hits = [r.id for r in event_conflicts(touched, events).orderBy("id").limit(5).collect()]
    if hits:
        raise EventConflict(f"events differ under one id, for example {hits}")
    custody = cut(distinct_custody(records.custody), "custody")
    known = case.custody.join(custody.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return replace(
        empty,
        evidence=fresh_rows(case.evidence, records.evidence),
        custody=_new_custody(known, custody),
        blobs=fresh_rows(case.blobs, records.blobs.withColumn("seq", F.lit(0))),
        events=fresh_rows(case.events, events),
        assertions=fresh_rows(case.assertions, records.assertions),
    )


def ingest_counts(records: Records) -> DataFrame:
    """Rows the source yielded, before any merge, as one row."""
    tagged = (
        records.evidence.select(F.lit("evidence").alias("kind"))
        .unionByName(records.events.select(F.lit("event").alias("kind")))
        .unionByName(records.assertions.select(F.lit("assertion").alias("kind")))
    )
    return tagged.agg(
        F.count_if(F.col("kind") == "evidence").alias("evidence_count"),
        F.count_if(F.col("kind") == "event").alias("normalized_event_count"),
        F.count_if(F.col("kind") == "assertion").alias("time_assertion_count"),
    )


# --- hypotheses and claims -------------------------------------------------


def update_hypotheses(hypotheses: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status changes in ``seq`` order.

    ``changes`` has ``id, seq, status, add_supporting, add_contradicting``. The
    last status wins; references are appended, repeats included.
    """
    last = changes.groupBy("id").agg(F.max_by("status", "seq").alias("_status"))

    def added(field: str) -> DataFrame:
        steps = changes.where(F.size(field) > 0).select("id", F.struct("seq", F.col(field).alias("refs")).alias("step"))
        refs = F.flatten(F.transform(F.sort_array(F.collect_list("step")), lambda s: s["refs"]))
        return steps.groupBy("id").agg(refs.alias(f"_{field}"))

    none = F.array().cast("array<struct<kind:string,id:string>>")
    joined = hypotheses.join(last, "id", "left").join(added("add_supporting"), "id", "left").join(added("add_contradicting"), "id", "left")
    return joined.select(
        "id",
        "statement",
        F.coalesce("_status", "status").alias("status"),
        F.concat("supporting_evidence", F.coalesce("_add_supporting", none)).alias("supporting_evidence"),
        F.concat("contradicting_evidence", F.coalesce("_add_contradicting", none)).alias("contradicting_evidence"),
        "inferred_by",
        "created_at",
    )


def hypothesis_references(hypotheses: DataFrame, changes: DataFrame) -> DataFrame:
    """``id, side, seq, position, kind, ref_id``: every reference of every hypothesis, one row each.

    The long form of ``update_hypotheses``, for hypotheses with very many references:
    those they began with have a null ``seq``, and no list of them is ever gathered.
    """
    def exploded(df: DataFrame, field: str, side: str, seq: Column) -> DataFrame:
        return df.select("id", F.lit(side).alias("side"), seq.alias("seq"), F.posexplode(field).alias("position", "r")).select(
            "id", "side", "seq", "position", "r.kind", F.col("r.id").alias("ref_id")
        )

    known, seq = changes.join(hypotheses.select("id"), "id", "left_semi"), F.col("seq")
    at_first = F.lit(None).cast(dict(changes.dtypes)["seq"])
    return (
        exploded(hypotheses, "supporting_evidence", "supporting", at_first)
        .unionByName(exploded(hypotheses, "contradicting_evidence", "contradicting", at_first))
        .unionByName(exploded(known, "add_supporting", "supporting", seq))
        .unionByName(exploded(known, "add_contradicting", "contradicting", seq))
    )


def missing_references(rows: DataFrame, refs: Column, *known: DataFrame) -> DataFrame:
    """``id, missing`` for every reference that names no row of ``known`` (by id)."""
    wanted = rows.select("id", F.explode(refs).alias("missing"))
    for frame in known:
        wanted = wanted.join(frame.select(F.col("id").alias("missing")), "missing", "left_anti")
    return wanted.select("id", "missing").distinct()


def create_claims(
    existing: DataFrame, claims: DataFrame, problems: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add claims whose id names no problem; report every claim once.

    ``problems`` has ``id`` of claims to refuse. The report carries ``status``
    of ``created``, ``already existing`` or ``rejected``.
    """
    first = keep_first(claims)
    bad = problems.select("id").distinct().withColumn("_bad", F.lit(True))
    known = existing.select("id").withColumn("_known", F.lit(True))
    marked = cut(first.join(bad, "id", "left").join(known, "id", "left"), "claims")
    status = (
        F.when(F.col("_bad"), "rejected").when(F.col("_known"), "already existing").otherwise("created")
    )
    report = marked.select("id", status.alias("status"))
    created = marked.where("_bad IS NULL AND _known IS NULL").drop("_bad", "_known")
    return existing.unionByName(created), report
