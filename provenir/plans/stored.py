"""Queries that go through files, stores, packages and streams, and the single-record lookups."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from provenir.functions import checks
from provenir.functions.times import micros
from provenir.operators import evaluation, hashtree, lookups, merge, provenance, report, study, timeline, tracking, traversal
from provenir.operators.chains import totals as chain_totals
from provenir.operators.components import find_components
from provenir.plans import views
from provenir.plans.catalog import GAP_SECONDS, _claims, _graph, _origin, joined, query
from provenir.schemas import ASSERTIONS, Case
from provenir.session import cut, scratch_path, write_rows
from provenir.sources import tables
from provenir.sources.packages import export_objects, read_packages, resolve_packages
from provenir.sources.records import read_records
from provenir.sources.responses import append_responses, read_responses
from provenir.sources.store import ingest
from provenir.streaming.ingest import start_ingest
from provenir.streaming.tracking import read_tracked, start_tracking

NOW = datetime(2026, 1, 1, tzinfo=UTC)


# --- files of three kinds, read through the registry -------------------------------


def _ingested(spark: SparkSession, d: str):
    """Events written as .jsonl, .csv and .syslog folders, each read by the parser that takes its name."""
    for path in views.log_folders(spark, d):
        yield read_records(spark, path, collected_at=NOW, source_id="host1")


@query
def ingested_files(spark, d):
    """Evidence of all three folders: adapter, declared source, copies."""
    out = None
    for records in _ingested(spark, d):
        evidence = records.evidence.select("id", "source_adapter", "seq")
        rows = evidence.join(records.custody.select("seq", "source_id", "actor"), "seq").groupBy(
            "id", "source_adapter", "source_id", "actor").agg(F.count(F.lit(1)).alias("copies"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def ingest_counts(spark, d):
    """Rows that each source yields, before any merge."""
    out = None
    for records in _ingested(spark, d):
        adapter = records.evidence.agg(F.min("source_adapter").alias("source_adapter"))
        row = merge.ingest_counts(records).crossJoin(adapter)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query
def batch_ingest(spark, d):
    """Three folders taken into one store, the first of them twice: what the store holds."""
    root = scratch_path(spark, "store")
    folders = views.log_folders(spark, d)
    for path in [*folders, folders[0]]:
        ingest(spark, path, root, collected_at=NOW, source_id="host1", compact_after=2)
    case = tables.read_deltas(spark, root)
    custody = case.custody.groupBy(F.col("evidence_id").alias("id")).agg(F.count(F.lit(1)).alias("n_custody"))
    events = case.events.select(F.element_at("derived_from", 1).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_events"))
    return case.evidence.select("id", "source_adapter").join(custody, "id", "left").join(events, "id", "left")


# --- snapshots and manifests -----------------------------------------------------------


def _full_case(spark: SparkSession, d: str) -> Case:
    """All six hashed collections: events with their claims, the trade graph, customers as hypotheses."""
    return replace(
        views.event_case(spark, d), entities=views.trade_entities(spark, d), relationships=views.trade_graph(spark, d),
        hypotheses=views.customer_hypotheses(spark, d),
    )


@query
def manifest_list(spark, d):
    """The list manifest over all six collections."""
    return provenance.list_manifest(_full_case(spark, d)).select("collection", "hash", "manifest_version")


@query
def snapshot_round_trip(spark, d):
    """A case written as a snapshot, read back and verified against the manifest taken before."""
    case, root = _full_case(spark, d), scratch_path(spark, "snapshot")
    manifest = cut(provenance.tree_manifest(case), "manifest")
    tables.write_snapshot(case, root)
    stored = tables.read_snapshot(spark, root)
    return provenance.overview(stored, provenance.tree_manifest(stored), manifest).drop("manifest_hash")


@query
def manifest_verdicts(spark, d):
    """The four verdicts: no record, another kind, the same case, the case without its errors."""
    case = views.event_case(spark, d)
    tree = cut(provenance.tree_manifest(case), "manifest")
    quiet = replace(case, events=case.events.where("event_type != 'error'"))
    cases = {
        "unrecorded": provenance.verdict(tree, None),
        "other_depth": provenance.verdict(tree, provenance.tree_manifest(case, digits=2)),
        "same": provenance.verify(replace(case, events=case.events.repartition(5, "event_type")), tree),
        "without_errors": provenance.verify(quiet, tree),
    }
    out = None
    for name, row in cases.items():
        part = row.select(F.lit(name).alias("compared"), "verdict", "matches")
        out = part if out is None else out.unionByName(part)
    return out


def _stored_tree(spark, d, after: Case) -> hashtree.HashTree:
    """A stored tree of the event case, brought up to ``after`` by what changed."""
    tree = hashtree.HashTree(spark, scratch_path(spark, "tree"))
    before = cut(provenance.object_hashes(views.event_case(spark, d)), "objects")
    tree.update(before)
    tree.update(hashtree.changes_between(before, provenance.object_hashes(after)))
    return tree


@query
def stored_tree_manifest(spark, d):
    """The manifest of the case without its errors, from a stored tree that had them and was updated."""
    case = views.event_case(spark, d)
    tree = _stored_tree(spark, d, replace(case, events=case.events.where("event_type != 'error'")))
    return tree.manifest().select("collection", "hash")


@query
def stored_tree_diff(spark, d):
    """What changed between two versions of a stored tree: errors withdrawn, orders in as entities."""
    case = views.event_case(spark, d)
    after = replace(case, events=case.events.where("event_type != 'error'"), entities=views.trade_entities(spark, d))
    tree = _stored_tree(spark, d, after)
    return hashtree.diff(tree.state(0), tree.state(1)).select("collection", "id", "change")


@query
def custody_growth(spark, d):
    """A second custody record for every item: more custody, the same manifest."""
    case = views.event_case(spark, d)
    again = case.custody.withColumn("action", F.lit("copied"))
    grown = replace(case, custody=merge.append_custody(case.custody, again))
    same = evaluation.same_manifest(provenance.tree_manifest(case), provenance.tree_manifest(grown))
    counts = grown.custody.agg(F.count(F.lit(1)).alias("n_custody"), F.count_distinct("evidence_id").alias("n_items"))
    return same.crossJoin(counts)  # seven rows by one


# --- tracking --------------------------------------------------------------------------------


@query
def contradiction_track_counts(spark, d):
    """Contradictions of even orders are tracked already; then all are."""
    claims = _claims(spark, d)
    even = claims.where(F.expr("CAST(substring(subject_event_id, 2) AS BIGINT) % 2 = 0"))
    tracked = cut(tracking.contradiction_rows(even).withColumn("note", F.lit("seen")), "tracked")
    table, outcome = tracking.track(tracked, tracking.contradiction_rows(claims), within="subject_event_id")
    kept = table.agg(F.count(F.lit(1)).alias("rows"), F.count("note").alias("notes"))
    return outcome.crossJoin(kept)  # one row by one


@query
def gap_track_counts(spark, d):
    """Gaps found without the error events are tracked; then those found with them."""
    case = views.event_case(spark, d)
    errors = case.events.where("event_type = 'error'").select(F.col("id").alias("subject_event_id"))
    quiet = replace(case, assertions=case.assertions.join(errors, "subject_event_id", "left_anti"))
    tracked = cut(tracking.gap_rows(quiet, min_gap_seconds=GAP_SECONDS), "tracked")
    table, outcome = tracking.track(tracked, tracking.gap_rows(case, min_gap_seconds=GAP_SECONDS))
    return outcome.crossJoin(table.agg(F.count(F.lit(1)).alias("rows")))  # one row by one


@query
def tracked_contradiction_list(spark, d):
    rows = tracking.contradiction_rows(_claims(spark, d))
    narrow = rows.select("id", "subject_event_id", "status", F.size("assertion_ids").alias("n_claims"))
    return tracking.list_tracked_contradictions(narrow)


# --- streams ------------------------------------------------------------------------------------


@query
def stream_ingest(spark, d):
    """Event files taken in by the ingest stream, and read back from its store."""
    root = scratch_path(spark, "stream")
    start_ingest(
        spark, f"{views.event_files(spark, d)}/*", kind="jsonl", root=f"{root}/store", checkpoint=f"{root}/checkpoint",
        collected_at=NOW, source_id="host1",
    ).awaitTermination()
    case = tables.read_deltas(spark, f"{root}/store")
    cited = case.events.select(F.element_at("derived_from", 1).alias("id"), "event_type")
    claims = case.assertions.select(F.col("source_evidence_id").alias("id"), micros(F.col("value")).alias("value_us"))
    return case.evidence.select("id", "raw_size_bytes").join(cited, "id", "left").join(claims, "id", "left")


@query
def stream_tracking(spark, d):
    """Claims in four files, tracked file by file: what comes late still meets what came before."""
    root = scratch_path(spark, "stream")
    columns = spark.createDataFrame([], ASSERTIONS).columns
    write_rows(views.order_claims(spark, d, parts=4).select(*columns), f"{root}/in")
    start_tracking(spark, f"{root}/in", root=f"{root}/out", checkpoint=f"{root}/checkpoint", files_per_batch=1).awaitTermination()
    return read_tracked(spark, f"{root}/out").select("id", "subject_event_id", joined("assertion_ids").alias("assertion_ids"), "status")


# --- packages ------------------------------------------------------------------------------------


def _read_packages(spark: SparkSession, d: str):
    return resolve_packages(*read_packages(spark, f"{views.package_files(spark, d)}/*/*.txt"))


@query
def package_file_errors(spark, d):
    """Problems of package files: unknown fields, another version, loose base64, dangling references."""
    name = F.concat(F.lit("s"), F.regexp_extract("package_id", "/supplier=([0-9]+)/", 1))
    return _read_packages(spark, d).errors.select(name.alias("package"), "path", "message").distinct()


@query
def package_file_records(spark, d):
    """Records of the packages without problems, all six collections, exported again."""
    case = _read_packages(spark, d).case
    keys = joined(F.array_sort(F.json_object_keys("json")))
    objects = export_objects(case).select("collection", "local_id", keys.alias("fields"))
    # New hypothesis ids are random; what counts is that each is one.
    is_new = F.col("local_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    shown = F.when((F.col("collection") == "hypotheses") & is_new, "new").otherwise(F.col("local_id"))
    return objects.groupBy("collection", shown.alias("id"), "fields").agg(F.count_distinct("local_id").alias("n"))


# --- lookups, nested results and reports ---------------------------------------------------------


@query
def one_record(spark, d):
    """One entity by id, and one relationship with its lineage."""
    entity = lookups.get_one(views.trade_entities(spark, d), "C1").select("id", F.col("entity_type").alias("kind"), joined("derived_from").alias("derived_from"))
    graph = _graph(spark, d)
    first = graph.where("source_entity_id = 'C1' AND relationship_type = 'located_in'").select("id").first()["id"]
    edge = lookups.get_one(graph, first).select("id", F.col("relationship_type").alias("kind"), joined("derived_from").alias("derived_from"))
    return entity.unionByName(edge)


@query
def one_reference(spark, d):
    """One evidence id, one event id and one that names nothing."""
    case = replace(Case.empty(spark), evidence=views.trade_evidence(spark, d), events=views.trade_events(spark, d))
    out = None
    for ref in ("ev-o1", "ne-o1", "nothing"):
        row = lookups.resolve_reference(case, ref)
        out = row if out is None else out.unionByName(row)
    return out.select("ref_id", "kind")


@query
def existing_references(spark, d):
    """The ids cited by the graph that name evidence."""
    cited = _graph(spark, d).select(F.explode("derived_from").alias("ref_id")).distinct()
    return lookups.existing(views.trade_evidence(spark, d), cited, "ref_id")


@query
def hypothesis_list(spark, d):
    rows = lookups.list_hypotheses(views.customer_hypotheses(spark, d))
    return rows.select("id", "statement", "status", "inferred_by", F.size("supporting_evidence").alias("n_supporting"))


@query
def nested_results(spark, d):
    """Chains, neighbours and components as nested JSON files, read back."""
    root, graph = scratch_path(spark, "results"), _graph(spark, d)
    chains = traversal.all_shortest_paths(graph, views.customer_to_supplier_queries(spark, d)).chains
    near = traversal.neighbors(graph, _origin(spark, "C1"), max_depth=2)
    tables.write_json(report.chains_json(chains), f"{root}/chains")
    tables.write_json(report.neighbors_json(near), f"{root}/neighbors")
    members = find_components(cut(views.as_relationships(views.placed(spark, d)), "graph"), min_size=8).members
    tables.write_json(report.components_json(members), f"{root}/components")
    chains, near, members = (spark.read.json(f"{root}/{name}") for name in ("chains", "neighbors", "components"))
    one = chains.select(
        F.lit("chain").alias("shape"), F.concat_ws("/", "query_id", "chain_index").alias("id"), F.size("steps").cast("long").alias("n"),
        F.col("steps")[0]["rel_id"].alias("first"))
    two = near.select(F.lit("neighbor"), "entity_id", "hop_count", "via.rel_id")
    three = members.select(F.lit("component"), "component", F.size("entity_ids").cast("long"), F.col("entity_ids")[0])
    return one.union(two).union(three)


@query
def report_sections(spark, d):
    """Rows of every section of a report, written and read back."""
    case, root = replace(_full_case(spark, d), tracked_contradictions=tracking.contradiction_rows(_claims(spark, d))), scratch_path(spark, "report")
    names = report.write_report(report.sections(case, cut(provenance.tree_manifest(case), "manifest")), root)
    out = None
    for name in names:
        rows = spark.read.text(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def nested_custody(spark, d):
    """Evidence with its custody nested in first-seen order: how many, and the first and last source."""
    nested = merge.custody_array(views.event_evidence(spark, d), views.event_custody(spark, d)).withColumn("c", F.col("chain_of_custody"))
    return nested.select("id", F.size("c").alias("n"), F.col("c")[0]["source_id"].alias("first"), F.element_at("c", -1)["source_id"].alias("last"))


@query
def nested_timeline(spark, d):
    """Events with their claims nested in id order: how many, and the first."""
    case = views.event_case(spark, d)
    nested = timeline.nested_timeline(case.events, case.assertions, "error")
    return nested.select("id", F.size("time_assertions").alias("n"), F.get("time_assertions", F.lit(0))["id"].alias("first"))


@query
def chains_to_many_targets(spark, d):
    """Every customer's shortest chains to a supplier of its own, all suppliers in turn."""
    n = views.table(spark, d, "supplier").count()
    key = F.col("c_custkey")
    queries = views.table(spark, d, "customer").select(
        views.key("C", "c_custkey").alias("query_id"), views.key("C", "c_custkey").alias("source"),
        F.concat(F.lit("S"), (key % n).cast("string")).alias("target"))
    counted = chain_totals(traversal.chain_graph(_graph(spark, d), queries))
    return counted.select("query_id", "target", "found", "hop_count", F.col("n_chains").cast("long").alias("n_chains"))


# --- study files and record rules ------------------------------------------------------------------


@query
def response_files(spark, d):
    """Responses appended to a store as JSON lines, read back and validated: counts per reason."""
    root = scratch_path(spark, "responses")
    append_responses(views.responses(spark, d).drop("index"), root)
    valid, rejected = study.validate_responses(read_responses(spark, f"{root}/*/*.json"))
    reasons = valid.select(F.lit("valid").alias("reason")).unionByName(rejected.select("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def scored_responses(spark, d):
    """Every response beside the key's answer for its case and question."""
    key = views.responses(spark, d).groupBy(F.col("case_id").alias("query_id"), "question_id").agg(F.max("correct_answer").alias("correct_answer"))
    scored = study.score_responses(views.responses(spark, d), key.where("question_id != 'q-3'"))
    return scored.select("index", "key_answer", (F.col("answer") == F.col("key_answer")).alias("right"))


def _study_cases(spark, d):
    """Customers as the cases of a study."""
    return views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("position"), views.key("case-", "c_custkey").alias("case_id"), F.col("c_mktsegment").alias("case_type"),
        F.col("c_nationkey").alias("path_count"), F.lit(2).alias("chain_count"), views.key("f", "c_nationkey").alias("fixture_id"),
        F.lit("v1").alias("answer_key_version"), F.array(views.key("q-", "c_custkey"), F.lit("a")).alias("question_ids"),
    )


@query
def case_manifest(spark, d):
    """The digest of a study's case list, as one list."""
    return study.case_manifest_hash(_study_cases(spark, d))


@query
def case_tree(spark, d):
    """The digest of a study's case list, as a tree."""
    return study.case_tree_hash(_study_cases(spark, d))


@query
def record_checks(spark, d):
    """Evidence, custody, events, claims, entities and hypotheses with faults, judged by the record rules."""
    e = views.table(spark, d, "events")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    key = F.col("event_id")
    evidence = e.select(
        F.lit("a").alias("id"), F.when(key % 3 == 0, "b").otherwise("a").alias("raw_content_hash"), F.when(key % 5 == 0, -1).otherwise(1).alias("raw_size_bytes"))
    custody = e.select(F.when(key % 3 == 0, " u").when(key % 5 == 0, "").otherwise(F.col("event_type")).alias("source_id"))
    events = e.select(F.when(key % 3 == 0, "\t").otherwise("k").alias("event_type"), some(key % 5 > 0).alias("derived_from"))
    claims = e.select(F.when(key % 3 > 0, F.col("ts")).alias("value"), F.when(key % 5 == 0, "week").otherwise("day").alias("precision"))
    entities = e.select(F.when(key % 3 == 0, "").otherwise("k").alias("entity_type"), some(key % 5 > 0).alias("derived_from"))
    refs = F.array(F.struct(F.when(key % 7 == 0, "other").otherwise("evidence_item").alias("kind"), F.lit("x").alias("id")))
    none = F.array().cast("array<struct<kind:string,id:string>>")
    hypotheses = e.select(
        F.when(key % 3 == 0, " ").otherwise("s").alias("statement"), F.when(key % 5 == 0, "").otherwise("me").alias("inferred_by"),
        F.when(key % 11 == 0, "sure").otherwise("proposed").alias("status"),
        F.when(key % 2 == 0, refs).otherwise(none).alias("supporting_evidence"), none.alias("contradicting_evidence"))
    judged = {
        "evidence": (evidence, checks.evidence_problem()), "custody": (custody, checks.custody_problem()), "event": (events, checks.event_problem()),
        "claim": (claims, checks.assertion_problem()), "entity": (entities, checks.entity_problem()), "hypothesis": (hypotheses, checks.hypothesis_problem()),
    }
    out = None
    for name, (rows, problem) in judged.items():
        good, bad = checks.split_valid(rows, problem)
        reasons = good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason"))
        part = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("record"), "reason", "n")
        out = part if out is None else out.unionByName(part)
    return out
