"""Packages, snapshots, reports, manifests and streams on small inputs."""

import hashlib
import json
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provenir.operators import provenance, report, study
from provenir.schemas import ASSERTIONS, HYPOTHESES, RESPONSES, Case
from provenir.session import cut
from provenir.sources import tables
from provenir.sources.packages import export_objects, read_packages, resolve_packages, strict_base64
from provenir.sources.responses import append_responses, read_responses
from provenir.streaming.ingest import start_ingest
from provenir.streaming.tracking import read_tracked, start_tracking

NOW = datetime(2026, 1, 1, tzinfo=UTC)
T = "2026-01-01T00:00:00Z"


def package(**changes):
    doc = {
        "schema_version": 1, "package_version": "1.0.0",
        "case_metadata": {"title": "t", "created_by": "me", "created_at": T},
        "evidence_items": [
            {"local_id": "e1", "content": "line one", "source_locator": "f:1", "collected_at": T, "source_id": "h1"},
            {"local_id": "e2", "content_base64": "/wA=", "source_locator": "f:2", "collected_at": T},
        ],
        "normalized_events": [
            {"local_id": "v1", "event_type": "k", "derived_from": ["e1"], "attributes": {"a": "1"}, "created_at": T},
            {"local_id": "v2", "event_type": "k", "derived_from": ["v1", "e2"], "created_at": T},
        ],
        "entities": [
            {"local_id": "n1", "entity_type": "host", "derived_from": ["e1"]},
            {"local_id": "n2", "entity_type": "ip", "derived_from": ["v2"]},
        ],
        "relationships": [{"relationship_type": "r", "source_entity": "n1", "target_entity": "n2", "derived_from": ["v2", "e1"], "created_at": T}],
        "time_assertions": [{"subject_event": "v1", "value": T, "precision": "second", "source_evidence": "e1", "asserted_by": "a", "created_at": T}],
        "hypotheses": [{"local_id": "h", "statement": "s", "supporting_evidence": [{"kind": "normalized_event", "local_id": "v1"}], "inferred_by": "me", "created_at": T}],
    }
    doc.update(changes)
    return doc


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_packages_resolve_and_reject(spark, tmp_path):
    base = package()
    docs = {
        "good": base,
        "dup": package(entities=base["entities"] + [{"local_id": "e1", "entity_type": "x", "derived_from": ["e1"]}]),
        "chain": package(normalized_events=[
            {"local_id": "v1", "event_type": "k", "derived_from": ["gone"], "created_at": T},
            {"local_id": "v2", "event_type": "k", "derived_from": ["v1"], "created_at": T}]),
        "later": package(normalized_events=[base["normalized_events"][1], base["normalized_events"][0]]),
        "loop": package(relationships=[{**base["relationships"][0], "target_entity": "n1"}]),
        "b64": package(evidence_items=[base["evidence_items"][0], {**base["evidence_items"][1], "content_base64": "???"}]),
        "version": package(schema_version=2),
        "field": package(surprise=1),
        "nested": package(entities=[{**base["entities"][0], "color": "red"}, base["entities"][1]]),
        "ref": package(hypotheses=[{**base["hypotheses"][0], "supporting_evidence": [{"kind": "evidence_item", "local_id": "v1"}]}]),
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    declared, shape = read_packages(spark, str(tmp_path))
    done = resolve_packages(declared, shape)
    got = {}
    for r in done.errors.collect():
        got.setdefault(r.package_id.split("/")[-1][:-5], set()).add((r.path, r.message))
    assert set(got) == set(docs) - {"good"}
    assert got["dup"] == {("entities[2] (e1)", "duplicate local_id e1")}
    assert ("normalized_events[0] (v1)", "derived_from references unknown local_id gone") in got["chain"]
    assert ("normalized_events[1] (v2)", "derived_from references unknown local_id v1") in got["chain"]
    assert ("time_assertions[0]", "subject_event references unknown local_id v1") in got["chain"]
    assert ("normalized_events[0] (v2)", "derived_from references unknown local_id v1") in got["later"]
    assert got["loop"] == {("relationships[0]", "endpoints are equal")}
    assert ("evidence_items[1] (e2)", "invalid content_base64") in got["b64"]
    assert got["version"] == {("<root>", "unsupported schema_version")}
    assert got["field"] == {("<root>", "unknown field")}
    assert got["nested"] == {("entities[0]", "unknown field")}
    assert got["ref"] == {("hypotheses[0] (h)", "supporting_evidence references unknown local_id v1")}

    case = Case(**{k: cut(v, k) for k, v in done.case.tables().items()})
    e1, e2 = hashlib.sha256(b"line one").hexdigest(), hashlib.sha256(b"\xff\x00").hexdigest()
    v1 = sha({"_type": "NormalizedEvent", "event_type": "k", "attributes": {"a": "1"}, "derived_from": [e1]})
    v2 = sha({"_type": "NormalizedEvent", "event_type": "k", "attributes": {}, "derived_from": [v1, e2]})
    assert {r.id for r in case.evidence.collect()} == {e1, e2}
    assert {r.id for r in case.events.collect()} == {v1, v2}
    (rel,) = case.relationships.collect()
    assert rel.derived_from == [v2, e1] and rel.source_entity_id == "n1"
    assert rel.id == sha({"_type": "Relationship", "relationship_type": "r", "source_entity_id": "n1",
                          "target_entity_id": "n2", "attributes": {}, "derived_from": [v2, e1]})
    (hyp,) = case.hypotheses.collect()
    assert hyp.id == "h" and hyp.status == "proposed" and hyp.supporting_evidence[0].id == v1

    # Export, re-import: the manifest stays the same.
    out = package(**{k: [] for k in ("evidence_items", "normalized_events", "entities", "relationships", "time_assertions", "hypotheses")})
    for r in export_objects(case).collect():
        out[r.collection].append(json.loads(r.json))
    out["normalized_events"].sort(key=lambda e: e["local_id"] == v2)
    again = tmp_path / "again"
    again.mkdir()
    (again / "case.json").write_text(json.dumps(out))
    back = resolve_packages(*read_packages(spark, str(again)))
    assert back.errors.count() == 0
    one = {r.collection: r.hash for r in provenance.list_manifest(case).collect()}
    two = {r.collection: r.hash for r in provenance.list_manifest(back.case).collect()}
    assert one == two


# Fixed values of a published worked case: its record ids, three whole-file evidence ids and its manifest.
GOLDEN_EVENT = "a0000000-0000-0000-0000-000000000001"
GOLDEN_ASSERTION = "b0000000-0000-0000-0000-000000000001"
GOLDEN_ENTITY = "c0000000-0000-0000-0000-000000000001"
GOLDEN_HYPOTHESIS = "d0000000-0000-0000-0000-000000000001"
GOLDEN_EVIDENCE = (
    "23da92a458f02aa20db9198ff4df4f31f15547b40b58a3e6b9fa55aa312c7ef2",
    "704c1143475a2165aac8af1d0a7330e79e0d0ca99fb4fef3cbb2db47e0fa37e2",
    "b2651b60d40d64679b4ee7506795fbc6f7baf76aa1882a63bbbf43d281623ead",
)
GOLDEN_MANIFEST = "7de0a333d0c096ba3d7815ede59de97703182647029ac292f0d847028457fc73"


def golden_case(spark):
    empty = Case.empty(spark)
    jsonl, log, _ = GOLDEN_EVIDENCE
    return replace(
        empty,
        evidence=spark.createDataFrame(
            [(e, "a", "0.1.0", "l", e, 1, NOW, None, {}) for e in GOLDEN_EVIDENCE], empty.evidence.schema),
        events=spark.createDataFrame(
            [(GOLDEN_EVENT, "process_start", [], {"host": "corp-ws-042", "process": "powershell.exe"}, [jsonl], NOW)],
            empty.events.schema),
        assertions=spark.createDataFrame(
            [(GOLDEN_ASSERTION, GOLDEN_EVENT, NOW + timedelta(hours=8, minutes=30), "second", jsonl, "adapter:jsonl", NOW)], ASSERTIONS),
        entities=spark.createDataFrame(
            [(GOLDEN_ENTITY, "host", {"hostname": "corp-ws-042"}, None, None, [jsonl])], empty.entities.schema),
        hypotheses=spark.createDataFrame(
            [(GOLDEN_HYPOTHESIS, "corp-ws-042 ran obfuscated PowerShell after opening a macro document", "supported",
              [("evidence_item", jsonl), ("evidence_item", log)], [], "analyst:golden-report-test", NOW)], HYPOTHESES),
    )


def test_golden_manifest_verdict_and_snapshots(spark, tmp_path):
    case = golden_case(spark)
    manifest = cut(provenance.list_manifest(case), "m")
    assert manifest.where("collection = 'manifest'").first().hash == GOLDEN_MANIFEST
    root = str(tmp_path / "case")
    assert tables.write_snapshot(case, root) == 0 and tables.write_snapshot(case, root, 0) == 0
    stored = tables.read_snapshot(spark, root)
    assert provenance.list_manifest(stored).where("collection = 'manifest'").first().hash == GOLDEN_MANIFEST
    assert provenance.verdict(manifest, None).first().verdict == "NO_RECORDED_MANIFEST"
    assert provenance.verdict(manifest, manifest).first().verdict == "MATCH"
    other = manifest.withColumn("hash", F.lit("x"))
    assert provenance.verdict(manifest, other).first().verdict == "MISMATCH"
    tree = provenance.tree_manifest(case)
    assert provenance.verdict(tree, manifest).first().verdict == "NOT_COMPARABLE"
    shuffled = replace(case, evidence=case.evidence.orderBy(F.desc("id")).repartition(3))
    deep = cut(provenance.tree_manifest(case, digits=2), "m")
    assert {r.collection: r.hash for r in deep.collect()} == {r.collection: r.hash for r in provenance.tree_manifest(shuffled, digits=2).collect()}
    assert provenance.verdict(tree, deep).first().verdict == "NOT_COMPARABLE"
    # One more event changes its own collection and the whole, no other collection.
    more = replace(case, events=case.events.unionByName(case.events.withColumn("id", F.lit("e"))))
    one, two = ({r.collection: r.hash for r in provenance.tree_manifest(c).collect()} for c in (case, more))
    assert {k for k in one if one[k] != two[k]} == {"manifest", "normalized_events"}
    for recorded in (manifest, tree, deep):
        assert provenance.verify(shuffled, cut(recorded, "m")).first().verdict == "MATCH"
        assert provenance.verify(more, cut(recorded, "m")).first().verdict == "MISMATCH"
    assert provenance.verify(case, None).first().matches
    assert provenance.diff(case, replace(case, entities=case.entities.limit(0))).first().change == "removed"
    parts = report.sections(stored, manifest, manifest)
    assert parts["coverage_gaps"] is None
    names = report.write_report(parts, str(tmp_path / "report"))
    assert "coverage_gaps" not in names and spark.read.json(str(tmp_path / "report/timeline")).count() == 1


def test_ordered_digest_over_many_chunks(spark, monkeypatch):
    import hashlib

    from provenir.operators import digest

    monkeypatch.setattr(digest, "CHUNK_BYTES", 40)
    rows = [(c, i, f"{c}{i}é") for c in ("a", "b") for i in range(300)] + [("c", 0, "only")]
    df = spark.createDataFrame(rows, "c string, i int, t string").repartition(7)
    got = {r.c: r.hash for r in digest.ordered_digest(df, "c", ["i"], "t", "[", ",", "]").collect()}
    want = {c: hashlib.sha256(("[" + ",".join(t for k, _, t in rows if k == c) + "]").encode()).hexdigest() for c in ("a", "b", "c")}
    assert got == want


@pytest.mark.parametrize("text,ok", [
    ("", True), ("/w==", True), ("/wA=", True), ("AAAA", True), ("/wA", False), ("/w A=", False), ("/wA==", False), ("====", False), ("/w=A", False), ("é===", False), ("_-8=", False),
])
def test_strict_base64(spark, text, ok):
    import base64

    got = spark.createDataFrame([(text,)], "t string").select(strict_base64(F.col("t"))).first()[0]
    assert (None if got is None else bytes(got)) == (base64.b64decode(text, validate=True) if ok else None)


def test_new_hypothesis_ids_do_not_change(spark):
    from provenir.sources.packages import LAYOUTS

    declared = {k: spark.createDataFrame([], f"package_id STRING, position BIGINT, {ddl}") for k, ddl in LAYOUTS.items()}
    some = [("p", 0, "e", "x", None, "l", NOW, None, None, None)]
    declared["evidence_items"] = spark.createDataFrame(some, declared["evidence_items"].schema)
    made = [("p", i, None, f"s{i}", None, [("evidence_item", "e")], [], "me", NOW) for i in range(20)]
    declared["hypotheses"] = spark.createDataFrame(made, declared["hypotheses"].schema)
    found = resolve_packages(declared).case.hypotheses
    first = {(r.statement, r.id) for r in found.collect()}
    assert len(first) == 20 and first == {(r.statement, r.id) for r in found.repartition(5).collect()}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    line = '{"event_type": "k", "timestamp": "2026-01-15T09:00:00Z"}'
    (folder / "a.jsonl").write_text(f"{line}\nbad\n")
    args = dict(kind="jsonl", root=root, checkpoint=str(tmp_path / "cp"), collected_at=NOW, source_id="h")
    start_ingest(spark, str(folder), **args).awaitTermination()
    (folder / "b.jsonl").write_text(f"{line}\n\n" + '{"event_type": "j"}\n')
    start_ingest(spark, str(folder), **args).awaitTermination()
    case = tables.read_deltas(spark, root)
    assert tables.versions(spark, root) == [0, 1]
    assert sorted(p.name for p in (tmp_path / "out").glob("v=*1/*") if not p.name.startswith(".")) == ["_COMPLETE", "assertions", "blobs", "custody", "events", "evidence"]
    assert (case.evidence.count(), case.custody.count(), case.events.count(), case.assertions.count()) == (3, 4, 2, 1)
    assert {r.source_locator.split("/")[-1] for r in case.custody.collect()} == {"a.jsonl:1", "a.jsonl:2", "b.jsonl:1", "b.jsonl:3"}


def test_many_batches_leave_few_files(spark, tmp_path):
    from provenir.session import scratch_root

    folder, root = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for i in range(10):
        (folder / f"{i:02d}.jsonl").write_text(f'{{"event_type": "k{i}", "timestamp": "2026-01-15T09:00:{i:02d}Z"}}\n{{"event_type": "all"}}\n')
    before = {p.name for p in Path(scratch_root(spark).removeprefix("file://")).glob("*")}
    start_ingest(
        spark, str(folder), kind="jsonl", root=str(root), checkpoint=str(tmp_path / "cp"), collected_at=NOW, files_per_batch=1, compact_after=3
    ).awaitTermination()
    case = tables.read_deltas(spark, str(root))
    assert (case.evidence.count(), case.custody.count(), case.events.count(), case.assertions.count()) == (11, 20, 11, 10)
    assert len(list(root.glob("v=*"))) <= 6 and len(list(root.glob("base=*"))) <= 2
    assert {p.name for p in Path(scratch_root(spark).removeprefix("file://")).glob("*")} == before
    store = tables.Deltas(spark, str(root), tables.SCHEMAS)
    assert all(store.holds(i) for i in range(10)) and not store.holds(10)


def test_stream_tracking(spark, tmp_path):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame([(i, s, NOW + timedelta(seconds=t), "exact", "e", "a", NOW) for i, s, t in r], ASSERTIONS)
    args = dict(root=root, checkpoint=str(tmp_path / "cp"))
    rows(("a1", "s", 0), ("a2", "s", 5), ("b1", "u", 0)).write.mode("append").parquet(incoming)
    start_tracking(spark, incoming, **args).awaitTermination()
    rows(("a1", "s", 0), ("b2", "u", 9)).write.mode("append").parquet(incoming)
    start_tracking(spark, incoming, **args).awaitTermination()
    tracked = read_tracked(spark, root)
    assert {tuple(r.assertion_ids) for r in tracked.collect()} == {("a1", "a2"), ("b1", "b2")}


def test_responses_source(spark, tmp_path):
    row = {"participant_id": "p", "condition": "path_only", "case_id": "c", "question_id": "q", "answer": "indeterminate",
           "correct_answer": "indeterminate", "response_time_ms": 5, "timestamp": T, "study_version": "study-v1", "is_developer_validation": False}
    path = tmp_path / "r.jsonl"
    times = [12.7, "12", " +1_000 ", "12.7", "1__0", True, None, "x", -3, "-3", 10**30, "9" * 30, "1e3", 1e3, -0.5]
    timed = [{**row, "question_id": f"t{i}", "response_time_ms": t} for i, t in enumerate(times)]
    nulls = [{**row, "question_id": "n0", "case_id": None}, {**row, "question_id": "n1", "answer": None}]
    lines = [row, row, {**row, "answer": "x"}, {k: v for k, v in row.items() if k != "case_id"}, *timed, *nulls]
    path.write_text("\n".join(json.dumps(r) for r in lines))
    valid, rejected = study.validate_responses(read_responses(spark, str(path)))
    assert {r.question_id: r.response_time_ms for r in valid.collect()} == {"q": 5, "t0": 12, "t1": 12, "t2": 1000, "t5": 1, "t13": 1000, "t14": 0, "n0": 5}
    reasons = {r.question_id: r.reason for r in rejected.where("question_id LIKE 't%' OR question_id = 'n1'").collect()}
    assert reasons == {"t3": "non-integer response_time_ms", "t4": "non-integer response_time_ms", "t6": "non-integer response_time_ms",
                       "t7": "non-integer response_time_ms", "t8": "negative response_time_ms", "t9": "negative response_time_ms",
                       "t10": "response_time_ms out of range", "t11": "response_time_ms out of range", "t12": "non-integer response_time_ms",
                       "n1": "malformed answer"}
    assert sorted(r.reason for r in rejected.where("question_id = 'q'").collect()) == ["duplicate response", "malformed answer", "missing required field"]
    valid = valid.where("question_id = 'q'")
    append_responses(valid.drop("index"), str(tmp_path / "store"))
    append_responses(valid.drop("index").withColumn("is_developer_validation", F.lit(True)), str(tmp_path / "store"))
    stored = spark.read.schema(RESPONSES).json(str(tmp_path / "store"))
    assert study.study_summary(stored).first().total_participant_responses == 1
    none = study.study_summary(stored.where("is_developer_validation")).first()
    assert not none.has_participant_data


def test_package_files_are_opened_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": 1, "package_version": "1", "case_metadata": {}, "entities": []}))
    declared, shape = read_packages(spark, str(tmp_path))
    for df in [*declared.values(), shape]:
        assert not [f for f in df.inputFiles() if f.startswith(f"file://{tmp_path}")]
    assert shape.collect() == []


def test_tracked_pairs_deal_ids_and_times_alone(spark):
    from provenir.operators import contradictions
    from provenir.schemas import ASSERTIONS
    from tests.models import T0, at

    claims = spark.createDataFrame(
        [(f"a{i}", f"n{i % 3}", at(i * 500_000), "day", f"e{i}", "x", T0) for i in range(20)], ASSERTIONS)
    narrow, wide = contradictions.detect(claims, ids_only=True), contradictions.detect(claims)
    assert narrow.schema["a"].dataType.names == ["id"] and "source_evidence_id" in wide.schema["a"].dataType.names
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert "source_evidence_id" in plan(wide) and "source_evidence_id" not in plan(narrow).split("RepartitionByExpression")[0]
    pairs = lambda df: sorted((r.subject_event_id, r.a.id, r.b.id) for r in df.collect())
    assert pairs(narrow) == pairs(wide) and len(pairs(wide)) > 20


def test_a_batch_is_not_dealt_again_for_what_is_known(spark):
    from provenir.operators.merge import fresh_rows

    ids = ["0f" * 32, "F" * 64, "é", "x", "x"]
    batch = spark.createDataFrame([(x, i, str(i)) for i, x in enumerate(ids)], "id string, n int, seq string")
    empty = batch.drop("seq").limit(0).rdd.toDF(batch.drop("seq").schema)
    fresh = fresh_rows(empty, batch)
    assert "Exchange hashpartitioning" not in fresh._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.n) for r in fresh.collect()) == sorted(zip(ids[:4], range(4)))
    assert [r.id for r in fresh_rows(fresh.where("n < 3"), batch).collect()] == ["x"]


def test_report_sections_are_compressed_lines(spark, tmp_path):
    import glob

    from provenir.operators import report

    rows = spark.createDataFrame([("f" * 64, None, ["é", "b"]), ("0" * 64, 1, [])], "id string, n int, a array<string>")
    assert report.write_report({"one": rows, "none": None}, f"{tmp_path}/r/") == ["one"]
    assert glob.glob(f"{tmp_path}/r/one/*") and all(f.endswith(".json.gz") for f in glob.glob(f"{tmp_path}/r/one/part-*"))
    back = spark.read.schema(rows.schema).json(f"{tmp_path}/r/one")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert '"n":null' in spark.read.text(f"{tmp_path}/r/one").orderBy("value").collect()[-1].value


@pytest.mark.parametrize("most", [0, 100])
def test_large_batches_meet_the_store_in_one_shuffle(spark, tmp_path, monkeypatch, most):
    """A batch that touches many events takes no semi-join with the store; the pairs are the same either way."""
    from provenir.operators.tracking import contradiction_rows
    from provenir.streaming import tracking as streaming

    claims = [(f"a{i:02d}", f"s{i % 7}", datetime(2024, 1, 1 + i % 20, tzinfo=UTC), "second", "e", "t", datetime(2024, 1, 1, tzinfo=UTC)) for i in range(30)]
    claims = spark.createDataFrame(claims, ASSERTIONS)
    for part in (claims.where("id < 'a12'"), claims.where("id >= 'a12' AND id < 'a16'"), claims.where("id >= 'a10'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, real = [], streaming.contradiction_rows
    monkeypatch.setattr(streaming, "MAX_BROADCAST_KEYS", most)
    monkeypatch.setattr(streaming, "contradiction_rows", lambda rows, *a: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), real(rows, *a))[1])
    streaming.start_tracking(
        spark, str(tmp_path / "in"), root=str(tmp_path / "out"), checkpoint=str(tmp_path / "c"), files_per_batch=1).awaitTermination()
    assert len(seen) == 3 and ("LeftSemi" in seen[-1]) == bool(most)
    got = [r.id for r in streaming.read_tracked(spark, str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(r.id for r in contradiction_rows(claims).collect()) and got
