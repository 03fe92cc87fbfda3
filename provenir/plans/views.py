"""The relational test tables seen as evidence, events, claims and a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import hashing
from provenir.schemas import Case
from provenir.session import scratch_path

NO_ATTRIBUTES = "map<string,string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _no_attributes() -> Column:
    return F.create_map().cast(NO_ATTRIBUTES)


# --- documents as evidence ----------------------------------------------------


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence row per document, before merging equal texts."""
    return table(spark, sf_dir, "documents").select(
        F.sha2(F.col("text"), 256).alias("id"),
        F.lit("documents").alias("source_adapter"),
        F.lit("0.1.0").alias("adapter_version"),
        key("documents:", "doc_id").alias("source_locator"),
        F.octet_length("text").cast("bigint").alias("raw_size_bytes"),
        F.col("source").alias("source_id"),
        F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("seq"),
    )


def document_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rows(spark, sf_dir).select(
        F.col("id").alias("evidence_id"),
        "seq",
        F.lit("adapter:documents@0.1.0").alias("actor"),
        F.lit("ingested").alias("action"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        "source_locator",
        "source_id",
    )


# --- orders and lines as time claims ---------------------------------------------


def order_claims(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Order and ship dates as claims about the order; equal claims appear once. With ``parts`` dealt to so many."""
    # A claim's id is a digest of these columns; equal rows go before it is made, in the join's partitions.
    dates = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").distinct()
    shipped = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        .distinct()
    )
    orders = dates.select(
        key("o", "o_orderkey").alias("subject_event_id"),
        F.col("o_orderdate").cast("timestamp").alias("value"),
        F.lit("day").alias("precision"),
        key("ev-o", "o_orderkey").alias("source_evidence_id"),
    )
    line = F.col("l_linenumber") % 3
    lines = shipped.select(
        key("o", "l_orderkey").alias("subject_event_id"),
        F.col("l_shipdate").cast("timestamp").alias("value"),
        F.when(line == 0, "second").when(line == 1, "day").otherwise("approximate").alias("precision"),
        F.concat(key("ev-l", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_evidence_id"),
    )
    claims = orders.unionByName(lines)
    # No digest is dealt: ids are made where the claims end up.
    claims = (claims if parts is None else claims.repartition(parts)).withColumn("asserted_by", F.lit("trade"))
    ident = hashing.assertion_id(
        F.col("subject_event_id"), F.col("value"), F.col("precision"), F.col("source_evidence_id"), F.col("asserted_by")
    )
    return (
        claims.withColumn("id", ident)
        .withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
        .select("id", "subject_event_id", "value", "precision", "source_evidence_id", "asserted_by", "created_at")
    )


# --- user events as a case with sources --------------------------------------------


def event_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributed = F.create_map(F.lit("type"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        key("ne-", "event_id").alias("id"),
        "event_type",
        F.array().cast("array<string>").alias("entity_ids"),
        F.when(F.col("event_id") % 7 != 0, attributed).otherwise(_no_attributes()).alias("attributes"),
        F.array(key("ev-", "event_id")).alias("derived_from"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = key("ev-", "event_id")
    return table(spark, sf_dir, "events").select(
        ident.alias("id"),
        F.lit("events").alias("source_adapter"),
        F.lit("0.1.0").alias("adapter_version"),
        key("events:", "event_id").alias("source_locator"),
        ident.alias("raw_content_hash"),
        F.octet_length("props").cast("bigint").alias("raw_size_bytes"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        _no_attributes().alias("ingest_parameters"),
    )


def event_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sources: one per user, none for every tenth, two for some errors."""
    user = key("u", "user_id")
    digit = F.col("user_id") % 10
    declared = F.when(digit == 9, F.array(F.lit(None).cast("string"))).when(
        (digit == 8) & (F.col("event_type") == "error"), F.array(user, key("x", "user_id"))
    ).otherwise(F.array(user))
    return table(spark, sf_dir, "events").select(
        key("ev-", "event_id").alias("evidence_id"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("seq"),
        F.lit("adapter:events@0.1.0").alias("actor"),
        F.lit("ingested").alias("action"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        key("events:", "event_id").alias("source_locator"),
        F.explode(declared).alias("source_id"),
    )


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    precision = F.when(kind == 0, "exact").when(kind == 1, "second").when(kind == 2, "minute").otherwise("hour")
    return (
        table(spark, sf_dir, "events")
        .where(~((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)))
        .select(
            key("ta-", "event_id").alias("id"),
            key("ne-", "event_id").alias("subject_event_id"),
            F.col("ts").cast("timestamp").alias("value"),
            precision.alias("precision"),
            key("ev-", "event_id").alias("source_evidence_id"),
            F.lit("adapter:events").alias("asserted_by"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )


def event_case(spark: SparkSession, sf_dir: str) -> Case:
    empty = Case.empty(spark)
    return Case(
        evidence=event_evidence(spark, sf_dir),
        custody=event_custody(spark, sf_dir),
        blobs=empty.blobs,
        events=event_events(spark, sf_dir),
        assertions=event_claims(spark, sf_dir),
        entities=empty.entities,
        relationships=empty.relationships,
        hypotheses=empty.hypotheses,
        tracked_gaps=empty.tracked_gaps,
        tracked_contradictions=empty.tracked_contradictions,
    )


# --- trade as a graph ------------------------------------------------------------------


def _edge(kind: str, source: Column, target: Column, refs: Column) -> list[Column]:
    return [
        F.lit(kind).alias("relationship_type"),
        source.alias("source_entity_id"),
        target.alias("target_entity_id"),
        refs.alias("derived_from"),
    ]


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to order; every eleventh order also cites an id that does not exist."""
    refs = F.when(
        F.col("o_orderkey") % 11 == 0, F.array(key("ev-o", "o_orderkey"), key("dangling-", "o_orderkey"))
    ).otherwise(F.array(key("ev-o", "o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct().select(
        *_edge("placed", key("C", "o_custkey"), key("O", "o_orderkey"), refs)
    )


def _line_event(prefix: str = "ne-l") -> Column:
    return F.concat(key(prefix, "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))


def supplied_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The edge is made of these three numbers; equal ones go before they become texts.
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").distinct().select(
        *_edge("supplied_by", key("O", "l_orderkey"), key("S", "l_suppkey"), F.array(_line_event()))
    )


def located_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        *_edge("located_in", key("C", "c_custkey"), key("N", "c_nationkey"), F.array(key("ev-c", "c_custkey")))
    ).distinct()
    suppliers = table(spark, sf_dir, "supplier").select(
        *_edge("located_in", key("S", "s_suppkey"), key("N", "s_nationkey"), F.array(key("ev-s", "s_suppkey")))
    ).distinct()
    return customers.unionByName(suppliers)


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        *_edge("part_of", key("N", "n_nationkey"), key("R", "n_regionkey"), F.array(key("ev-n", "n_nationkey")))
    ).distinct()


def as_relationships(edges: DataFrame) -> DataFrame:
    """Edges with content ids; the kinds of edges above hold equal ones once, and no two kinds share one."""
    attributes = _no_attributes()
    ident = hashing.relationship_id(
        F.col("relationship_type"), F.col("source_entity_id"), F.col("target_entity_id"), attributes, F.col("derived_from")
    )
    return (
        edges.withColumn("id", ident)
        .withColumn("attributes", attributes)
        .withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
        .select("id", "relationship_type", "source_entity_id", "target_entity_id", "attributes", "derived_from", "created_at")
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = (
        placed(spark, sf_dir)
        .unionByName(supplied_by(spark, sf_dir))
        .unionByName(located_in(spark, sf_dir))
        .unionByName(part_of(spark, sf_dir))
    )
    return as_relationships(edges)


def trade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line events derive from order events, which derive from order evidence."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        _line_event().alias("id"), F.array(key("ne-o", "l_orderkey")).alias("derived_from")
    )
    orders = table(spark, sf_dir, "orders").select(
        key("ne-o", "o_orderkey").alias("id"), F.array(key("ev-o", "o_orderkey")).alias("derived_from")
    )
    return lines.unionByName(orders)


def trade_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").select(key("ev-o", "o_orderkey").alias("id"))
        .unionByName(table(spark, sf_dir, "customer").select(key("ev-c", "c_custkey").alias("id")))
        .unionByName(table(spark, sf_dir, "supplier").select(key("ev-s", "s_suppkey").alias("id")))
        .unionByName(table(spark, sf_dir, "nation").select(key("ev-n", "n_nationkey").alias("id")))
    )


def trade_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as entities; orders, nations and regions stay without a record."""

    def entity(name: str, prefix: str, k: str, label: str, refs: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            key(prefix, k).alias("id"),
            F.lit(name).alias("entity_type"),
            F.create_map(F.lit("name"), F.col(label)).alias("identifiers"),
            F.lit(None).cast("timestamp").alias("first_seen"),
            F.lit(None).cast("timestamp").alias("last_seen"),
            F.array(key(refs, k)).alias("derived_from"),
        )

    return entity("customer", "C", "c_custkey", "c_name", "ev-c").unionByName(
        entity("supplier", "S", "s_suppkey", "s_name", "ev-s")
    )


def customer_to_supplier_queries(spark: SparkSession, sf_dir: str, supplier: str = "S1") -> DataFrame:
    """One query per customer: which shortest chains lead to one supplier?"""
    return table(spark, sf_dir, "customer").select(
        key("C", "c_custkey").alias("query_id"), key("C", "c_custkey").alias("source"), F.lit(supplier).alias("target")
    )


def to_region_queries(spark: SparkSession, sf_dir: str, region: str = "R0") -> DataFrame:
    """One query per customer and supplier: how does it connect to one region?"""
    return trade_entities(spark, sf_dir).select(
        F.col("id").alias("query_id"), F.col("id").alias("source"), F.lit(region).alias("target")
    )


# --- documents and events as evaluation input -------------------------------------------


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two length rules as predictors of the quality label, by language."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("lang").alias("group"),
        (F.col("quality") == 1).alias("truth"),
        F.explode(
            F.array(
                F.struct(F.lit("m1").alias("method"), (F.col("n_chars") >= 1000).alias("predicted")),
                F.struct(F.lit("m2").alias("method"), (F.col("n_chars") >= 300).alias("predicted")),
            )
        ).alias("m"),
    ).select("group", "truth", "m.method", "m.predicted")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as study responses, with faults of every kind."""
    e = F.col("event_id")

    def pick(modulus: int, names: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), (e % modulus).cast("int"))

    answers = ("shared_root_evidence", "disjoint_root_evidence", "indeterminate")
    return table(spark, sf_dir, "events").select(
        e.alias("index"),
        key("p", "user_id").alias("participant_id"),
        F.get(
            F.array(F.lit("path_only"), F.lit("direct_evidence"), F.lit("root_evidence")),
            (F.col("user_id") % 3).cast("int"),
        ).alias("condition"),
        F.concat(F.lit("case-"), (e % 9).cast("string")).alias("case_id"),
        F.when(e % 8 == 7, F.concat(F.lit("case-"), (e % 9).cast("string"), F.lit("-q-single")))
        .otherwise(F.concat(F.lit("q-"), (e % 4).cast("string"))).alias("question_id"),
        F.when(e % 43 == 0, "maybe").otherwise(pick(3, answers)).alias("answer"),
        pick(2, answers).alias("correct_answer"),
        F.when(e % 41 == 0, "-5").otherwise(F.floor(F.col("value") * 1000).cast("bigint").cast("string")).alias("response_time_ms"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(None).cast("string").alias("optional_notes"),
        F.when(e % 47 == 0, "study-v0").otherwise("study-v1").alias("study_version"),
        (e % 53 == 0).alias("is_developer_validation"),
    )


# --- tables as raw log lines -----------------------------------------------------------


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines; every thirteenth line is damaged."""
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    whole = F.concat(
        F.lit('{"event_type": "'), F.col("event_type"), F.lit('", "timestamp": "'), stamp,
        F.lit('", "user": '), F.col("user_id").cast("string"),
        F.lit(', "note": null, "props": '), F.col("props"), F.lit("}"),
    )
    line = F.when(F.col("event_id") % 13 == 0, F.concat(whole, F.lit(" junk"))).otherwise(whole)
    return _lines(table(spark, sf_dir, "events"), line, F.lit("events.jsonl"))


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """The JSON lines as text files, one per event type and 20,000 ids; a blank line after every 17th id.

    Returns the folder; a file's lines are in order of event id.
    """
    path = scratch_path(spark, "text")
    written = json_lines(spark, sf_dir).withColumn("event_id", F.col("line_no") - 1).join(
        table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"
    )
    name = F.concat_ws("-", "event_type", F.floor(F.col("event_id") / 20_000).cast("string"))
    value = F.when(F.col("event_id") % 17 == 0, F.concat("text", F.lit("\n \t"))).otherwise(F.col("text"))
    rows = written.select(name.alias("file"), "event_id", value.alias("value"))
    dealt = rows.repartition("file").sortWithinPartitions("file", "event_id").drop("event_id")
    dealt.write.partitionBy("file").text(path)
    return path


def log_folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The JSON, CSV and syslog lines as folders of text files, named so that a parser takes each."""
    root = scratch_path(spark, "logs")
    json_lines(spark, sf_dir).select("text").write.text(f"{root}/events.jsonl")
    syslog_lines(spark, sf_dir).select("text").write.text(f"{root}/events.syslog")
    # A CSV file begins with its header: one file per event type, rows in line order.
    rows = csv_lines(spark, sf_dir).repartition("path").sortWithinPartitions("path", "line_no")
    rows.select(F.col("path").alias("file"), "text").write.partitionBy("file").text(f"{root}/parts.csv")
    return [f"{root}/events.jsonl", f"{root}/parts.csv/*.csv", f"{root}/events.syslog"]


def customer_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.array(F.struct(F.lit("evidence_item").alias("kind"), key("ev-c", "c_custkey").alias("id")))
    return table(spark, sf_dir, "customer").select(
        key("h", "c_custkey").alias("id"), F.lit("pays").alias("statement"), F.lit("proposed").alias("status"),
        ref.alias("supporting_evidence"), F.array().cast("array<struct<kind:string,id:string>>").alias("contradicting_evidence"),
        F.lit("ana").alias("inferred_by"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def package_files(spark: SparkSession, sf_dir: str) -> str:
    """One JSON package per supplier, all six collections, with faults by supplier key; returns the folder."""
    path = scratch_path(spark, "packages")
    k = F.col("s_suppkey")
    when = F.lit("2026-01-01T00:00:00Z")
    text = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    plain = text(local_id=F.lit("e1"), content=key("supplier ", "s_suppkey"), source_locator=key("suppliers:", "s_suppkey"), collected_at=when, source_id=F.lit("erp"))
    packed = text(local_id=F.lit("e2"), content_base64=F.when(k % 5 == 0, "/w A=").otherwise(F.base64(F.encode("s_name", "UTF-8"))),
                  source_locator=key("names:", "s_suppkey"), collected_at=when)
    extra = F.when(k % 7 == 0, F.lit("?")).alias("remark")
    event = F.struct(F.lit("v1").alias("local_id"), F.lit("joined").alias("event_type"), F.array(F.lit("e1"), F.lit("e2")).alias("derived_from"), when.alias("created_at"), extra)
    owner = text(local_id=key("s", "s_suppkey"), entity_type=F.lit("supplier"), derived_from=F.array(F.lit("v1")))
    home = text(local_id=key("n", "s_nationkey"), entity_type=F.lit("nation"), derived_from=F.array(F.when(k % 13 == 0, "e9").otherwise("e1")))
    edge = text(relationship_type=F.lit("located_in"), source_entity=key("s", "s_suppkey"), target_entity=key("n", "s_nationkey"), derived_from=F.array(F.lit("v1")), created_at=when)
    claim = text(subject_event=F.lit("v1"), value=when, precision=F.lit("day"), source_evidence=F.lit("e1"), asserted_by=F.lit("erp"), created_at=when)
    guess = text(local_id=F.when(k % 2 == 0, key("h", "s_suppkey")), statement=F.lit("trades"), inferred_by=F.lit("ana"), created_at=when,
                 supporting_evidence=F.array(text(kind=F.lit("evidence_item"), local_id=F.lit("e1"))))
    as_json = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(i) for i in items]), F.lit("]"))
    parts = {
        "evidence_items": as_json(plain, packed), "normalized_events": as_json(event), "entities": as_json(owner, home),
        "relationships": as_json(edge), "time_assertions": as_json(claim), "hypotheses": as_json(guess),
    }
    head = F.concat(F.lit('{"schema_version": '), F.when(k % 11 == 0, "2").otherwise("1"), F.lit(', "package_version": "1", "case_metadata": {}'))
    doc = F.concat(head, *[x for name, items in parts.items() for x in (F.lit(f', "{name}": '), items)], F.lit("}"))
    table(spark, sf_dir, "supplier").select(k.alias("supplier"), doc.alias("doc")).repartition(4, "supplier").write.partitionBy("supplier").text(path)
    return path


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one CSV file per type, with quoted, short and long rows."""
    events = table(spark, sf_dir, "events")
    path = F.concat(F.col("event_type"), F.lit(".csv"))
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('""')), F.lit('"'))
    full = F.concat_ws(",", F.col("event_id").cast("string"), F.lit(" seen "), quoted)
    line = (
        F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string"))
        .when(F.col("event_id") % 7 == 0, F.concat(full, F.lit(",more,still")))
        .otherwise(full)
    )
    data = _lines(events, line, path).withColumn("row_no", F.col("line_no") + 1).withColumn("line_no", F.col("line_no") + 1)
    header = F.lit("key,event_type,props")
    heads = events.select(path.alias("path")).distinct().select(
        "path", F.lit(1).cast("bigint").alias("line_no"), F.lit(1).cast("bigint").alias("row_no"),
        header.cast("binary").alias("raw"), header.alias("text"),
    )
    return data.select("path", "line_no", "row_no", "raw", "text").unionByName(heads)


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.date_format(F.col("ts").cast("timestamp"), "MMM d HH:mm:ss")
    body = F.concat(F.lit("value="), F.col("user_id").cast("string"), F.lit(" ok"))
    line = (
        F.when(F.col("event_id") % 13 == 0, F.lit("no syslog line "))
        .when(F.col("event_id") % 3 == 0, F.concat(clock, F.lit(" host"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(": "), body))
        .otherwise(F.concat(clock, F.lit("  host"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit("["), F.col("event_id").cast("string"), F.lit("]: "), body))
    )
    return _lines(table(spark, sf_dir, "events"), line, F.lit("events.syslog"))


def _lines(df: DataFrame, line: Column, path: Column) -> DataFrame:
    return df.select(
        path.alias("path"), (F.col("event_id") + 1).alias("line_no"), line.cast("binary").alias("raw"), line.alias("text")
    )


# --- customers as case packages ---------------------------------------------------------


def customer_packages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One package per customer: orders as evidence, lines as events and claims.

    In open orders the second line cites the first, which is not always there.
    """
    from provenir.sources.packages import LAYOUTS

    when = F.lit("2026-01-01 00:00:00").cast("timestamp")
    orders = table(spark, sf_dir, "orders").withColumn("package_id", key("p", "o_custkey"))
    lines = (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
        .agg(F.min("l_shipdate").cast("timestamp").alias("shipped")).join(orders, "o_orderkey")
        .withColumn("position", F.col("o_orderkey") * 10 + F.col("line"))
        .withColumn("name", F.concat(key("l", "o_orderkey"), F.lit("-"), F.col("line").cast("string")))
    )
    own = key("o", "o_orderkey")
    first = F.concat(key("l", "o_orderkey"), F.lit("-1"))
    chained = (F.col("o_orderstatus") == "P") & (F.col("line") == 2)
    made = {
        "evidence_items": orders.select(
            "package_id", F.col("o_orderkey").alias("position"), own.alias("local_id"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus")).alias("content"),
            key("orders:", "o_orderkey").alias("source_locator"), when.alias("collected_at"),
        ),
        "normalized_events": lines.select(
            "package_id", "position", F.col("name").alias("local_id"), F.lit("line").alias("event_type"),
            F.when(chained, F.array(own, first)).otherwise(F.array(own)).alias("derived_from"), when.alias("created_at"),
        ),
        "entities": orders.groupBy("package_id", "o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select(
            "package_id", F.lit(0).cast("bigint").alias("position"), key("c", "o_custkey").alias("local_id"),
            F.lit("customer").alias("entity_type"), F.array(own).alias("derived_from"),
        ),
        "time_assertions": lines.select(
            "package_id", "position", F.col("name").alias("subject_event"), F.col("shipped").alias("value"),
            F.lit("day").alias("precision"), own.alias("source_evidence"), F.lit("carrier").alias("asserted_by"), when.alias("created_at"),
        ),
    }
    out = {}
    for kind, ddl in LAYOUTS.items():
        empty = spark.createDataFrame([], f"package_id STRING, position BIGINT, {ddl}")
        out[kind] = empty.unionByName(made[kind], allowMissingColumns=True) if kind in made else empty
    return out
