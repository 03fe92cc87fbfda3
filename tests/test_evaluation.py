"""Labelled graphs, published scores, study metrics, and catalogue spot checks."""

import random
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenir.operators import evaluation, lineage, study, traversal
from provenir.plans.catalog import QUERIES
from provenir.plans.oracles import ORACLES
from provenir.session import cut
from tests import labelled_graphs
from tests.compare import compare, connect
from tests.test_graph import rel_frame


@pytest.fixture(scope="module")
def scored(spark):
    edges, lines, evidence, truth = labelled_graphs.tables()
    rels = rel_frame(spark, edges)
    queries = spark.createDataFrame([(t[0], f"{t[0]}/A", f"{t[0]}/D") for t in truth], "query_id string, source string, target string")
    found = traversal.all_shortest_paths(rels, queries)
    summary, chains = cut(found.summary), cut(found.chains)
    events = spark.createDataFrame(lines, "id string, derived_from array<string>")
    known = spark.createDataFrame([(e,) for e in evidence], "id string")
    roots = cut(lineage.chain_roots(chains, events, known))
    overlap = cut(lineage.evidence_overlap(summary, roots))
    truth_frame = spark.createDataFrame(
        truth, "query_id string, class string, is_adversarial boolean, root_disjoint boolean, direct_disjoint boolean, "
               "expected_paths int, expected_root_sets array<array<string>>, expected_direct_sets array<array<string>>")
    evaluated = cut(evaluation.evaluate(evaluation.predictions(summary, chains, overlap), truth_frame))
    return dict(summary=summary, chains=chains, roots=roots, overlap=overlap, truth=truth_frame, evaluated=evaluated)


def in_sets(versions):
    return [g["id"] for g in labelled_graphs.GRAPHS if g["version"] in versions]


def test_ground_truth_and_verdicts(scored):
    rows = evaluation.ground_truth_matches(scored["summary"], scored["chains"], scored["roots"], scored["truth"]).collect()
    assert len(rows) == 27 and all(r.path_count_matches and r.root_sets_match and r.direct_sets_match for r in rows)
    verdicts = {r.query_id: r.fully_evidence_independent for r in scored["overlap"].collect()}
    assert verdicts == {g["id"]: g["root"] for g in labelled_graphs.GRAPHS}


# Published confusion counts: versions, group, method -> tp, fp, fn, tn.
PUBLISHED = [
    ((1,), "binary", "path_count", (2, 3, 0, 0)), ((1,), "binary", "root_evidence", (2, 0, 0, 3)),
    ((1, 2), "binary", "path_count", (4, 7, 0, 0)), ((1, 2), "binary", "structure", (4, 7, 0, 0)),
    ((1, 2), "binary", "direct_refs", (4, 4, 0, 3)), ((1, 2), "binary", "root_evidence", (4, 0, 0, 7)),
    ((1, 2), "partial_overlap", "path_count", (0, 2, 0, 0)), ((1, 2), "partial_overlap", "structure", (0, 2, 0, 0)),
    ((1, 2), "partial_overlap", "direct_refs", (0, 0, 0, 2)), ((1, 2), "partial_overlap", "root_evidence", (0, 0, 0, 2)),
    ((3,), "binary", "path_count", (3, 6, 0, 0)), ((3,), "binary", "structure", (3, 6, 0, 0)),
    ((3,), "binary", "direct_refs", (2, 5, 1, 1)), ((3,), "binary", "root_evidence", (3, 0, 0, 6)),
]


def test_published_confusion_counts(scored):
    for versions in {p[0] for p in PUBLISHED}:
        part = scored["evaluated"].where(F.col("query_id").isin(in_sets(versions)))
        got = {(r.group, r.method): (r.tp, r.fp, r.fn, r.tn) for r in evaluation.group_metrics(part).collect()}
        for v, group, method, counts in PUBLISHED:
            if v == versions:
                assert got[(group, method)] == counts, (v, group, method)


def test_published_pairs_and_discriminator(scored):
    pairs = {r.query_id: r for r in evaluation.pair_accounting(
        scored["summary"], scored["roots"], scored["chains"], scored["overlap"]).collect()}
    for fid, masked, total in (("partial-overlap-01", 2, 3), ("partial-multi-root-01", 4, 6), ("v3-partial-overlap-complex-01", 4, 6)):
        assert (pairs[fid].root_pairs_masked, pairs[fid].total_chain_pairs) == (masked, total)
        assert pairs[fid].information_loss_rate == pytest.approx(2 / 3)
    outcome = evaluation.discriminator(scored["evaluated"].where(F.col("query_id").isin(in_sets((3,)))))
    c = evaluation.discriminator_counts(outcome).first()
    assert (c.discriminator_count, c.correct_discriminator_count, c.root_evidence_error_count) == (6, 6, 0)


def test_pairs_are_counted_over_classes(spark):
    rng = random.Random(9)
    rows = [(f"q{q}", c, f"m{m}") for q in range(12) for c in range(14) for m in rng.sample(range(9), rng.choice([1, 1, 2, 3])) if rng.random() < 0.8]
    rows += [("all", c, m) for c in range(40) for m in ("common", f"own{c}")] + [("one", 0, "m"), ("two", 0, "a"), ("two", 1, "b")]
    held = {}
    for q, c, m in rows:
        held.setdefault(q, {}).setdefault(c, set()).add(m)
    want = {q: n for q, by in held.items() if (n := sum(bool(by[i] & by[j]) for i in by for j in by if i < j))}
    frame = spark.createDataFrame(rows, "query_id string, chain_index long, ref string")
    got = {r.query_id: r.n for r in evaluation.overlapping_pairs(frame, "ref").collect()}
    assert got == want and got["all"] == 780
    # Ten thousand chains on one root: a number, and no pair of classes.
    many = spark.range(10_000).select(F.lit("q").alias("query_id"), F.col("id").alias("chain_index"), F.explode(F.array(F.lit("root"), F.concat(F.lit("own"), "id"))).alias("ref"))
    assert [(r.query_id, r.n) for r in evaluation.overlapping_pairs(many, "ref").collect()] == [("q", 10_000 * 9_999 // 2)]


def test_questions_and_answers(scored):
    key = {r.question_id: r.correct_answer for r in study.answer_key(scored["summary"], scored["roots"]).collect()}
    assert key["single-path-01-q-single"] == "indeterminate"
    assert key["shared-root-01-q-1-2"] == "shared_root_evidence"
    assert key["disjoint-roots-01-q-1-2"] == "disjoint_root_evidence"
    assert sum(q.startswith("path-count-deception-01") for q in key) == 28


def test_exact_medians(spark):
    rng = random.Random(12)
    held = {f"g{g}": [rng.choice([1, -1]) * rng.randrange(2 ** rng.randrange(1, 45)) for _ in range(rng.randrange(1, 60))] for g in range(25)}
    held |= {"one": [7], "two": [63, 64], "same": [5] * 40, "zero": [0, 0, 1], "wide": [-(2**62), 2**62]}
    rows = [(g, v) for g, own in held.items() for v in own] + [("one", None), ("none", None)]
    got = {r.g: r["median"] for r in study.exact_medians(spark.createDataFrame(rows, "g string, t long"), "g", "t").collect()}
    assert got == {g: pytest.approx(median(own)) for g, own in held.items()}


def test_condition_metrics(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", "path_only" if i % 3 else "direct_evidence", f"c{i}", rng.choice(["q-1", "x-q-single"]),
             rng.choice(study.ANSWERS), rng.choice(study.ANSWERS[:2]), rng.randint(0, 9000), i % 10 == 0) for i in range(200)]
    frame = spark.createDataFrame(
        rows, "participant_id string, condition string, case_id string, question_id string, answer string, correct_answer string, response_time_ms bigint, is_developer_validation boolean")
    got = {r.condition: r for r in study.condition_metrics(frame, expected_per_condition=150).collect()}
    for name in ("path_only", "direct_evidence"):
        real = [r for r in rows if r[1] == name and not r[7]]
        r = got[name]
        assert r.response_count == len(real)
        assert r.accuracy == pytest.approx(sum(x[4] == x[5] for x in real) / len(real))
        assert r.mean_response_time_ms == pytest.approx(mean(x[6] for x in real))
        assert r.median_response_time_ms == pytest.approx(median(x[6] for x in real))
        assert r.missing_response_rate == pytest.approx(max(150 - len(real), 0) / 150)
    assert got["root_evidence"].response_count == 0 and got["root_evidence"].accuracy is None
    assert got["root_evidence"].missing_response_rate == 1.0


def test_entry_points(spark):
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["contradictions_report", "coverage_gaps_refined", "gap_tracking", "csv_events", "response_validation"])
def test_queries_match_sql(spark, sf_dir, name):
    ok, note, _ = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, note
