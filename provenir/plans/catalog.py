"""Every query by name: callables from ``(spark, sf_dir)`` to a flat DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import checks, hashing, text, times
from provenir.functions.times import micros
from provenir.operators import (
    chains,
    components,
    contradictions,
    evaluation,
    gaps,
    lineage,
    lookups,
    merge,
    provenance,
    study,
    timeline,
    tracking,
    traversal,
)
from provenir.operators.chains import ChainGraph
from provenir.plans import views
from provenir.schemas import Case
from provenir.session import cut
from provenir.sources import lines as line_source
from provenir.sources import parsers
from provenir.sources.packages import export_objects, resolve_packages
from provenir.sources.records import derive_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GAP_SECONDS = 48 * 3600
REFINED_GAP_SECONDS = 8 * 24 * 3600
SEED = "study-v1-seed"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# --- contradictions -----------------------------------------------------------


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """The order claims as a stored table."""
    return cut(views.order_claims(spark, d), "claims")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return contradictions.detect(_claims(spark, d))


@query
def contradictions_report(spark, d):
    return _pairs(spark, d).select(
        "subject_event_id",
        F.col("a.id").alias("a_id"),
        F.col("b.id").alias("b_id"),
        micros(F.col("a.value")).alias("a_us"),
        micros(F.col("b.value")).alias("b_us"),
        F.col("a.precision").alias("a_precision"),
        F.col("b.precision").alias("b_precision"),
        F.col("a.source_evidence_id").alias("a_source"),
        F.col("b.source_evidence_id").alias("b_source"),
    )


@query
def contradiction_tracking(spark, d):
    rows = tracking.contradiction_rows(_claims(spark, d))
    return rows.select("id", "subject_event_id", joined("assertion_ids").alias("assertion_ids"), "status")


# --- evidence --------------------------------------------------------------------


@query
def evidence_dedup_custody(spark, d):
    first = merge.keep_first(views.document_rows(spark, d))
    custody = merge.distinct_custody(views.document_custody(spark, d))
    sources = gaps.declared_sources(custody)
    counts = custody.groupBy(F.col("evidence_id").alias("id")).agg(F.count(F.lit(1)).alias("n_custody"))
    return first.join(counts, "id").join(sources.withColumnRenamed("evidence_id", "id"), "id").select(
        "id", "source_locator", "raw_size_bytes", "n_custody", "n_sources"
    )


@query
def ambiguous_sources(spark, d):
    custody = views.document_custody(spark, d)
    many = gaps.declared_sources(custody).where("n_sources > 1").select("evidence_id")
    return gaps.source_ids(custody).join(many, "evidence_id", "left_semi")


@query
def insert_if_absent(spark, d):
    """Documents arriving after a first load of those long enough to matter."""
    rows = views.document_rows(spark, d)
    loaded = merge.keep_first(rows.where("raw_size_bytes >= 1000"))
    return merge.insert_if_absent(loaded, rows).select("id", "source_locator", "raw_size_bytes")


@query
def upsert_last_wins(spark, d):
    rows = views.document_rows(spark, d)
    loaded = merge.keep_first(rows.where("raw_size_bytes >= 1000"))
    return merge.upsert(loaded, rows.where("raw_size_bytes < 20000")).select("id", "source_locator", "raw_size_bytes")


@query
def event_conflicts(spark, d):
    """Events re-sent with other entity ids conflict with the stored ones."""
    stored = views.event_events(spark, d)
    resent = stored.withColumn(
        "entity_ids", F.when(F.col("event_type") == "error", F.array(F.lit("n1"))).otherwise(F.col("entity_ids"))
    )
    return merge.event_conflicts(stored, resent)


@query
def unique_lines(spark, d):
    """Lines of all documents, each an evidence item kept once."""
    lines = line_source.lines_of_texts(views.table(spark, d, "documents"), "doc_id", "text")
    rows = lines.select(
        F.sha2("raw", 256).alias("id"),
        F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("source_locator"),
        F.octet_length("raw").cast("bigint").alias("raw_size_bytes"),
        line_source.seq_key(F.lit(0), F.lpad("path", 20, "0"), F.col("line_no")).alias("seq"),
    )
    copies = rows.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return merge.keep_first(rows).join(copies, "id")


# --- lines and parsers --------------------------------------------------------------


def _records(parsed: DataFrame, adapter: str, locator: str = "line_no"):
    return derive_records(
        parsed, adapter=adapter, version="0.1.0", collected_at=F.lit("2026-01-01 00:00:00"),
        source_id=F.lit("host1"), locator_column=locator,
    )


def _event_rows(records) -> DataFrame:
    return records.events.select(
        "id",
        "event_type",
        joined(F.array_sort(F.map_keys("attributes"))).alias("attribute_names"),
        F.sha2(hashing.json_string_map(F.col("attributes")), 256).alias("attributes_hash"),
        F.element_at("derived_from", 1).alias("evidence_id"),
    )


@query
def jsonl_events(spark, d):
    return _event_rows(_records(parsers.jsonl(views.json_lines(spark, d)), "jsonl"))


@query
def jsonl_assertions(spark, d):
    records = _records(parsers.jsonl(views.json_lines(spark, d)), "jsonl")
    return records.assertions.select(
        "id", "subject_event_id", micros(F.col("value")).alias("value_us"), "precision", "source_evidence_id", "asserted_by"
    )


@query
def jsonl_evidence(spark, d):
    records = _records(parsers.jsonl(views.json_lines(spark, d)), "jsonl")
    return records.evidence.select("id", "source_adapter", "source_locator", "raw_size_bytes")


@query
def csv_events(spark, d):
    return _event_rows(_records(parsers.csv_timeline(views.csv_lines(spark, d)), "csv_timeline", "row_no"))


@query
def syslog_events(spark, d):
    return _event_rows(_records(parsers.syslog(views.syslog_lines(spark, d)), "syslog"))


@query
def text_file_lines(spark, d):
    """Events written as text files with blank lines in between, and scanned back with their numbers."""
    path = views.event_files(spark, d)
    lines = line_source.read_lines(spark, f"{path}/*/*.txt")
    name = F.regexp_extract("path", "/file=([^/]+)/", 1)
    return lines.select(name.alias("file"), "line_no", "row_no", F.sha2("raw", 256).alias("id"))


@query
def document_lines(spark, d):
    lines = line_source.lines_of_texts(views.table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy(F.col("path").alias("doc")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("line_no").alias("last_line"),
        F.sum(F.octet_length("raw").cast("bigint")).alias("n_bytes"),
    )


# --- scalar functions over whole tables -------------------------------------------------


@query
def canonical_json_texts(spark, d):
    body = hashing.json_text(F.col("text"))
    return views.table(spark, d, "documents").select(
        "doc_id",
        F.length(body).cast("bigint").alias("json_chars"),
        F.sha2(body, 256).alias("json_hash"),
    )


@query
def neutralized_texts(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(text.neutralize(F.col("text")), 256).alias("neutral_hash"))


@query
def iso_timestamps(spark, d):
    """Event times written in six notations and read back; naive text stays null."""
    ts = F.col("ts").cast("timestamp")
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss")
    notations = {
        "extended": F.concat(day, F.lit("T"), F.date_format(ts, "HH:mm:ss.SSSSSS"), F.lit("Z")),
        "basic": F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("T"), F.date_format(ts, "HHmmss"), F.lit("+0000")),
        "minutes": F.concat(day, F.lit(" "), F.date_format(ts, "HH:mm"), F.lit("+01:00")),
        "offset": F.concat(day, F.lit("T"), clock, F.lit("-23:30")),
        "naive": F.concat(day, F.lit("T"), clock),
        "broken": F.concat(day, F.lit("T"), clock, F.lit("+1:00")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("notation"), v.alias("written")) for k, v in notations.items()])
    return views.table(spark, d, "events").select("event_id", F.explode(rows).alias("n")).select(
        "event_id", "n.notation", micros(times.parse_iso(F.col("n.written"))).alias("value_us")
    )


@query
def source_id_checks(spark, d):
    pages = views.table(spark, d, "pages")
    ok = lambda c: text.source_id_problem(c).isNull()
    return pages.select(
        "page_id",
        ok(F.col("url")).alias("url_ok"),
        ok(F.concat(F.col("url"), F.lit(" "))).alias("padded_ok"),
        ok(F.col("html")).alias("html_ok"),
    )


# --- timeline and lists ---------------------------------------------------------------------


def _timeline(spark: SparkSession, d: str, event_type: str | None) -> DataFrame:
    # Claims of orders as well as of events, so that one event has several.
    events = views.table(spark, d, "orders").select(
        views.key("o", "o_orderkey").alias("id"),
        F.lit("order").alias("event_type"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    users = views.event_events(spark, d).select("id", "event_type", "created_at")
    claims = views.order_claims(spark, d).unionByName(views.event_claims(spark, d))
    return timeline.timeline(events.unionByName(users), claims, event_type).select(
        "id", "event_type", micros(F.col("sort_time")).alias("sort_us"), micros(F.col("display_time")).alias("display_us"), "n_claims"
    )


@query
def timeline_all(spark, d):
    return _timeline(spark, d, None)


@query
def timeline_filtered(spark, d):
    return _timeline(spark, d, "signup")


@query
def timeline_claims(spark, d):
    case = views.event_case(spark, d)
    return timeline.claims_of_timeline(case.events, case.assertions).withColumn("value", micros(F.col("value")))


@query
def list_evidence(spark, d):
    rows = lookups.list_evidence(views.event_evidence(spark, d), "events")
    return rows.select("id", "source_adapter", "adapter_version", "source_locator", "raw_size_bytes", micros(F.col("collected_at")).alias("collected_us"))


@query
def list_entities(spark, d):
    return lookups.list_entities(views.trade_entities(spark, d), "supplier").select(
        "id", "entity_type", F.col("identifiers")["name"].alias("name")
    )


@query
def list_relationships_by_entity(spark, d):
    rows = lookups.list_relationships(views.trade_graph(spark, d), "S1", "supplied_by")
    return rows.select("id", "relationship_type", "source_entity_id", "target_entity_id", joined("derived_from").alias("derived_from"))


@query
def resolved_references(spark, d):
    refs = lookups.resolve_references(views.trade_graph(spark, d), views.trade_evidence(spark, d), views.trade_events(spark, d))
    return refs.select("owner", "position", "ref_id", "kind")


@query
def resolved_entities(spark, d):
    ends = views.trade_graph(spark, d).select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    return lookups.resolve_entities(ends, views.trade_entities(spark, d)).select("entity_id", "entity_type", "found")


@query
def events_without_claims(spark, d):
    return lookups.events_without_claims(views.event_events(spark, d), views.event_claims(spark, d)).select("id", "event_type")


@query
def dangling_references(spark, d):
    return merge.missing_references(
        views.trade_graph(spark, d), F.col("derived_from"), views.trade_evidence(spark, d), views.trade_events(spark, d)
    )


# --- coverage gaps ------------------------------------------------------------------------------


def _gaps(spark: SparkSession, d: str, seconds: float, refine_by: str | None = None) -> gaps.GapResult:
    case = views.event_case(spark, d)
    return gaps.find_gaps(
        case.assertions, case.events, case.evidence, case.custody, min_gap_seconds=seconds, refine_by=refine_by
    )


def _flat_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumn("interval_start", micros(F.col("interval_start"))).withColumn(
        "interval_end", micros(F.col("interval_end"))
    )


@query
def gap_windows(spark, d):
    found = _gaps(spark, d, 12 * 3600).gaps
    return found.select("source", "gap_start", "gap_end", "before_id", "after_id")


@query
def coverage_gaps(spark, d):
    return _flat_findings(_gaps(spark, d, GAP_SECONDS).findings).drop(
        "absent_source_refinement", "present_source_refinement"
    )


@query
def coverage_gaps_refined(spark, d):
    return _flat_findings(_gaps(spark, d, REFINED_GAP_SECONDS, "type").findings)


@query
def gap_corroboration(spark, d):
    return _flat_findings(gaps.corroborating_ids(_gaps(spark, d, GAP_SECONDS))).drop(
        "absent_source_refinement", "present_source_refinement"
    )


@query
def gap_exclusions(spark, d):
    return _gaps(spark, d, GAP_SECONDS, "type").stats


@query
def gap_tracking(spark, d):
    rows = tracking.gap_rows(views.event_case(spark, d), min_gap_seconds=GAP_SECONDS)
    return rows.select(
        "id", "absent_source", "present_source", micros(F.col("interval_start")).alias("start_us"),
        joined("corroborating_time_assertion_ids").alias("corroborating"),
        joined("bounding_absent_assertion_ids").alias("bounding"), "min_gap_seconds", "min_corroborating_events", "status",
    )


def _tracked_without_errors(spark: SparkSession, d: str) -> tuple[Case, DataFrame]:
    """The event case, and the findings that were tracked before its errors arrived."""
    from dataclasses import replace

    case = views.event_case(spark, d)
    quiet = replace(case, assertions=case.assertions.join(
        case.events.where("event_type = 'error'").select(F.col("id").alias("subject_event_id")), "subject_event_id", "left_anti"
    ))
    # Their id lists are in the ids already, which is all that a later check reads of them.
    found = tracking.gap_rows(quiet, min_gap_seconds=GAP_SECONDS)
    return case, cut(found.drop("corroborating_time_assertion_ids", "bounding_absent_assertion_ids"), "tracked")


@query
def gap_still_reproduced(spark, d):
    """Findings tracked before the errors arrived: do they still hold with all events?"""
    case, tracked = _tracked_without_errors(spark, d)
    return tracking.still_reproduced(case, tracked).select("id", "absent_source", "present_source", "still_reproduced")


@query
def gap_parameter_sets(spark, d):
    """The same findings under three parameter sets each: as found, twice as long, and three claims or more."""
    case, tracked = _tracked_without_errors(spark, d)
    sets = F.array(*[F.struct(F.lit(float(GAP_SECONDS * k)).alias("s"), F.lit(n).alias("n")) for k, n in ((1, 2), (2, 2), (1, 3))])
    rows = tracked.withColumn("p", F.explode(sets)).withColumns({"min_gap_seconds": F.col("p.s"), "min_corroborating_events": F.col("p.n")})
    return tracking.still_reproduced(case, rows.drop("p")).select("id", "min_gap_seconds", "min_corroborating_events", "still_reproduced")


@query
def contradiction_annotations(spark, d):
    """Annotate every tracked contradiction twice; the later note stands."""
    tracked = cut(tracking.contradiction_rows(_claims(spark, d)), "tracked")
    marks = tracked.select(
        "id",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("seq"), F.lit(s).alias("status"), F.lit(by).alias("annotated_by"), F.lit(note).alias("note"))
            for n, s, by, note in ((1, "reviewed", "ana", "first"), (2, "dismissed", "bo", "second"), (3, "reviewed", " ", "blank"))
        ])).alias("m"),
    ).select("id", "m.*").withColumn("annotated_at", F.lit("2026-02-01 00:00:00").cast("timestamp"))
    updated, _ = tracking.annotate(tracked, marks)
    return updated.select("id", "subject_event_id", "status", "annotated_by", "note")


# --- graph --------------------------------------------------------------------------------------


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """The trade graph as a stored table."""
    return cut(views.trade_graph(spark, d), "graph")


def _origin(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([("q", node)], "query_id string, origin string")


def _neighbors(spark: SparkSession, d: str, node: str, depth: int, direction: str) -> DataFrame:
    found = traversal.neighbors(_graph(spark, d), _origin(spark, node), max_depth=depth, direction=direction)
    return found.select("entity_id", "hop_count", "rel_id", "from_id", "to_id", "walked_direction")


@query
def neighbors_out(spark, d):
    return _neighbors(spark, d, "C1", 3, "out")


@query
def neighbors_in(spark, d):
    return _neighbors(spark, d, "R0", 3, "in")


@query
def neighbors_both(spark, d):
    return _neighbors(spark, d, "S0", 3, "both")


@query
def distance_map(spark, d):
    return traversal.distances(_graph(spark, d), _origin(spark, "C2"), max_depth=4, direction="both").select("entity_id", "hop_count")


@query
def shortest_path_batch(spark, d):
    """From every customer and supplier to one region: found, hops."""
    found = traversal.shortest_path(_graph(spark, d), views.to_region_queries(spark, d))
    return found.summary


@query
def shortest_path_steps(spark, d):
    found = traversal.shortest_path(_graph(spark, d), views.to_region_queries(spark, d))
    return found.chains.select("query_id", "position", "rel_id", "from_id", "to_id", "walked_direction")


def _chains(spark: SparkSession, d: str) -> tuple[traversal.Paths, DataFrame]:
    """Every customer's shortest chains to one supplier, written once."""
    queries = views.customer_to_supplier_queries(spark, d)
    found = traversal.all_shortest_paths(_graph(spark, d), queries)
    return traversal.Paths(cut(found.chains, "chains"), cut(found.summary, "summary")), queries


@query
def all_shortest_paths(spark, d):
    found, _ = _chains(spark, d)
    return found.chains.select("query_id", "chain_index", "position", "rel_id", "from_id", "to_id", "walked_direction")


def _counted_chains(spark: SparkSession, d: str) -> tuple[DataFrame, ChainGraph]:
    """The trade graph, and every customer's shortest chains to one supplier as counts over edges."""
    graph = _graph(spark, d)
    return graph, traversal.chain_graph(graph, views.customer_to_supplier_queries(spark, d))


@query
def all_shortest_summary(spark, d):
    """How many shortest chains there are; none is listed."""
    _, found = _counted_chains(spark, d)
    return chains.totals(found).withColumn("n_chains", F.col("n_chains").cast("long")).withColumn("truncated", F.lit(False))


@query
def all_shortest_both_ways(spark, d):
    """All chains between two customers in either direction."""
    pair = spark.createDataFrame([("q", "C1", "C2")], "query_id string, source string, target string")
    found = traversal.all_shortest_paths(_graph(spark, d), pair, direction="both")
    return found.chains.select("chain_index", "position", "rel_id", "from_id", "to_id", "walked_direction")


@query
def limited_chains(spark, d):
    """The first three chains of every customer, and whether there are more."""
    found = traversal.all_shortest_paths(_graph(spark, d), views.customer_to_supplier_queries(spark, d), limit=3)
    counts = found.chains.groupBy("query_id").agg(
        F.count_distinct("chain_index").alias("shown"), F.min(F.when(F.col("position") == 0, F.col("rel_id"))).alias("least_rel")
    )
    return found.summary.select("query_id", "n_chains", "truncated").join(counts, "query_id", "left")


@query
def distance_to_target(spark, d):
    """How many hops every node is from one supplier, walking against the steps."""
    back = checks.reverse_direction("out")
    return traversal.distances(_graph(spark, d), _origin(spark, "S1"), max_depth=None, direction=back).select("entity_id", "hop_count")


@query
def explained_chains(spark, d):
    found, _ = _chains(spark, d)
    return lineage.explain_chains(found.chains, views.trade_evidence(spark, d), views.trade_events(spark, d))


@query
def chain_entities(spark, d):
    found, queries = _chains(spark, d)
    ids = lineage.chain_entities(found.chains, queries)
    return lookups.resolve_entities(ids, views.trade_entities(spark, d)).select("query_id", "entity_id", "entity_type", "found")


def _lineage_events(spark: SparkSession, d: str) -> DataFrame:
    """What events derive from, as a stored table."""
    return cut(views.trade_events(spark, d).select("id", "derived_from"), "events")


@query
def root_evidence(spark, d):
    return lineage.root_map(_lineage_events(spark, d), views.trade_evidence(spark, d))


def _overlap(spark: SparkSession, d: str):
    found, _ = _chains(spark, d)
    roots = cut(lineage.chain_roots(found.chains, _lineage_events(spark, d), views.trade_evidence(spark, d)), "roots")
    return found, roots, lineage.evidence_overlap(found.summary, roots)


def _counted_overlap(spark: SparkSession, d: str):
    """The same without a list of chains."""
    graph, found = _counted_chains(spark, d)
    edges = chains.marked_edges(found)
    return graph, found, edges, lineage.counted_overlap(found, edges, graph, _lineage_events(spark, d), views.trade_evidence(spark, d))


@query
def evidence_overlap(spark, d):
    *_, overlap = _counted_overlap(spark, d)
    return overlap.select("query_id", F.col("n_chains").cast("long").alias("n_chains"), joined("shared_evidence_ids").alias("shared"), "fully_evidence_independent")


@query
def components_of_orders(spark, d):
    found = components.find_components(cut(views.as_relationships(views.placed(spark, d)), "graph"), min_size=8)
    return found.members.select("component_index", "component", "entity_id")


@query
def components_of_trade(spark, d):
    found = components.find_components(_graph(spark, d))
    return found.members.select("component_index", "component", "entity_id")


@query
def component_totals(spark, d):
    rels = views.as_relationships(views.placed(spark, d))
    return components.find_components(rels, min_size=12).stats


@query
def component_relationships(spark, d):
    found = components.find_components(cut(views.as_relationships(views.placed(spark, d)), "graph"), min_size=8)
    return found.relationships.select("component_index", "rel_id")


# --- provenance -----------------------------------------------------------------------------------


@query
def manifest_tree(spark, d):
    return provenance.tree_manifest(views.event_case(spark, d)).select("collection", "hash")


@query
def manifest_diff(spark, d):
    """What changes when the error events are withdrawn and orders come in as entities."""
    from dataclasses import replace

    before = views.event_case(spark, d)
    after = replace(before, events=before.events.where("event_type != 'error'"), entities=views.trade_entities(spark, d))
    return provenance.diff(before, after).select("collection", "id", "change")


@query
def entity_hashes(spark, d):
    return views.trade_entities(spark, d).select("id", hashing.entity_hash().alias("hash"))


@query
def overview(spark, d):
    from dataclasses import replace

    case = replace(
        views.event_case(spark, d), entities=views.trade_entities(spark, d), relationships=views.trade_graph(spark, d),
        tracked_contradictions=tracking.contradiction_rows(_claims(spark, d)),
    )
    manifest = provenance.tree_manifest(case)
    return provenance.overview(case, manifest, manifest).drop("manifest_hash")


# --- evaluation and study ----------------------------------------------------------------------------


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Labels for the customer queries, taken from customer columns."""
    return views.table(spark, d, "customer").select(
        views.key("C", "c_custkey").alias("query_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "PARTIAL_OVERLAP").otherwise(F.col("c_mktsegment")).alias("class"),
        (F.col("c_mktsegment") == "FURNITURE").alias("is_adversarial"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") < 12).alias("root_disjoint"),
    )


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    graph, found, edges, overlap = _counted_overlap(spark, d)
    return evaluation.evaluate(evaluation.counted_predictions(found, edges, graph, overlap), _truth(spark, d))


@query
def baseline_predictions(spark, d):
    return _evaluated(spark, d).select("query_id", "method", "predicted", "false_corroboration", "correct")


@query
def evaluation_groups(spark, d):
    return evaluation.group_metrics(cut(_evaluated(spark, d), "evaluated"))


@query
def pairwise_overlap(spark, d):
    found, roots, overlap = _overlap(spark, d)
    return evaluation.pair_accounting(found.summary, roots, found.chains, overlap)


@query
def discriminator_outcomes(spark, d):
    return evaluation.discriminator(_evaluated(spark, d)).select("query_id", "direct_refs", "root_evidence", "truth", "outcome")


@query
def discriminator_counts(spark, d):
    return evaluation.discriminator_counts(evaluation.discriminator(_evaluated(spark, d)))


@query
def confusion_matrix(spark, d):
    return evaluation.confusion(views.document_predictions(spark, d), ["group", "method"])


def _known_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of each case: what the clicks and views ask, but not case 8."""
    asked = views.responses(spark, d).join(
        views.table(spark, d, "events").where("event_type IN ('click', 'view')").select(F.col("event_id").alias("index")), "index"
    )
    return asked.where("case_id != 'case-8'").select("case_id", "question_id").distinct()


@query
def response_validation(spark, d):
    valid, rejected = study.validate_responses(views.responses(spark, d), known_questions=_known_questions(spark, d))
    return valid.select("index", F.lit("valid").alias("reason")).unionByName(rejected.select("index", "reason"))


@query
def condition_metrics(spark, d):
    valid, _ = study.validate_responses(views.responses(spark, d))
    return study.condition_metrics(
        valid.withColumn("response_time_ms", F.col("response_time_ms").cast("bigint")), expected_per_condition=4000
    )


@query
def study_summary(spark, d):
    return study.study_summary(views.responses(spark, d))


@query
def condition_assignment(spark, d):
    people = views.table(spark, d, "events").select(views.key("p", "user_id").alias("participant_id")).distinct()
    return study.assign_conditions(people, SEED)


@query
def case_order(spark, d):
    people = views.table(spark, d, "events").select(views.key("p", "user_id").alias("participant_id")).distinct()
    cases = views.responses(spark, d).select("case_id").distinct()
    return study.case_orders(people, cases, SEED)


@query
def answer_key(spark, d):
    found, roots, _ = _overlap(spark, d)
    return study.answer_key(found.summary, roots).select("query_id", "question_id", "correct_answer")


@query
def neutral_chain_labels(spark, d):
    _, roots, _ = _overlap(spark, d)
    return study.neutral_labels(roots, "E", "root_id")


# --- packages, claims and checks ---------------------------------------------------------------------


@query
def package_errors(spark, d):
    return resolve_packages(views.customer_packages(spark, d)).errors


@query
def package_events(spark, d):
    case = resolve_packages(views.customer_packages(spark, d)).case
    return case.events.select("id", "event_type", joined("derived_from").alias("derived_from"))


@query
def exported_evidence(spark, d):
    """Documents exported as package objects, text as text."""
    from dataclasses import replace

    rows = views.document_rows(spark, d)
    texts = views.table(spark, d, "documents").select(F.sha2("text", 256).alias("id"), F.col("text").cast("binary").alias("raw"))
    case = replace(
        Case.empty(spark),
        evidence=merge.keep_first(rows).select(
            "id", "source_adapter", "adapter_version", "source_locator", F.col("id").alias("raw_content_hash"), "raw_size_bytes",
            F.lit("2026-01-01 00:00:00").cast("timestamp").alias("collected_at"), F.lit(None).cast("timestamp").alias("observed_at"),
            F.create_map().cast("map<string,string>").alias("ingest_parameters"),
        ),
        custody=views.document_custody(spark, d),
        blobs=texts.dropDuplicates(["id"]),
    )
    body = F.from_json("json", "local_id string, content string, source_locator string, source_id string").alias("o")
    return export_objects(case).where("collection = 'evidence_items'").select("local_id", body).select(
        "local_id", F.sha2("o.content", 256).alias("content_hash"), "o.source_locator", "o.source_id"
    )


@query
def claimed_relationships(spark, d):
    """All trade edges claimed anew over a store that holds the located_in edges."""
    graph = cut(views.trade_graph(spark, d), "graph")
    stored = graph.where("relationship_type = 'located_in'")
    problems = merge.missing_references(graph, F.col("derived_from"), views.trade_evidence(spark, d), views.trade_events(spark, d))
    _, report = merge.create_claims(stored, graph.withColumn("seq", F.col("id")), problems)
    return report


def _hypothesis_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One hypothesis per customer, and its orders, which support or contradict it in turn."""
    ref = lambda c: F.array(F.struct(F.lit("evidence_item").alias("kind"), c.alias("id")))
    good = F.col("o_orderstatus") != "F"
    changes = views.table(spark, d, "orders").select(
        views.key("h", "o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.when(good, "supported").otherwise("contradicted").alias("status"),
        F.when(good, ref(views.key("ev-o", "o_orderkey"))).alias("add_supporting"),
        F.when(~good, ref(views.key("ev-o", "o_orderkey"))).alias("add_contradicting"),
    )
    return views.customer_hypotheses(spark, d), changes


@query
def hypothesis_updates(spark, d):
    return merge.update_hypotheses(*_hypothesis_changes(spark, d)).select(
        "id", "status", joined("supporting_evidence.id").alias("supporting"), joined("contradicting_evidence.id").alias("contradicting")
    )


@query
def hypothesis_references(spark, d):
    """The same references one by one, without a list per hypothesis."""
    return merge.hypothesis_references(*_hypothesis_changes(spark, d)).select("id", "side", "seq", "ref_id")


@query
def relationship_checks(spark, d):
    """Nation pairs of customer and supplier per line as edges, judged by the record rules."""
    lines = views.table(spark, d, "lineitem").join(views.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        lines.join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(views.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.when(F.col("l_returnflag") == "R", " ").otherwise("ships").alias("relationship_type"),
            views.key("N", "c_nationkey").alias("source_entity_id"), views.key("N", "s_nationkey").alias("target_entity_id"),
            F.when(F.col("l_linestatus") == "O", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("derived_from"),
        )
    )
    return edges.withColumn("reason", F.coalesce(checks.relationship_problem(), F.lit("valid"))).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def condition_views(spark, d):
    """Chains of the study cases as each condition shows them."""
    found, roots, _ = _overlap(spark, d)
    direct = evaluation.direct_references(found.chains).groupBy("query_id", "chain_index").agg(
        joined(F.sort_array(F.collect_set("ref_id"))).alias("direct_labels")
    )
    rooted = roots.groupBy("query_id", "chain_index").agg(joined(F.sort_array(F.collect_set("root_id"))).alias("root_labels"))
    return study.condition_view(direct.join(rooted, ["query_id", "chain_index"], "left"))


@query
def ground_truth_match(spark, d):
    """Chain counts and root sets against what the tables say directly."""
    found, roots, _ = _overlap(spark, d)
    orders = views.table(spark, d, "orders").select("o_orderkey", views.key("C", "o_custkey").alias("query_id"))
    lines = views.table(spark, d, "lineitem").where("l_suppkey = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct()
    per_chain = orders.join(lines, "o_orderkey").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected_paths"),
        F.collect_list(F.array(views.key("ev-o", "o_orderkey"))).alias("expected_root_sets"),
        F.collect_list(
            F.concat(
                F.array(
                    F.concat(views.key("ne-l", "o_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")),
                    views.key("ev-o", "o_orderkey"),
                ),
                F.when(F.col("o_orderkey") % 11 == 0, F.array(views.key("dangling-", "o_orderkey"))).otherwise(F.array().cast("array<string>")),
            )
        ).alias("expected_direct_sets"),
    )
    return evaluation.ground_truth_matches(found.summary, found.chains, roots, per_chain)
