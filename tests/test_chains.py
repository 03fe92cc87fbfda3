"""Counting, paging and comparing chains without listing them, and searches of any depth."""

import os
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from provenir.operators import chains, evaluation, lineage, traversal
from provenir.session import Growing, cut
from tests.test_graph import bfs_model, chains_model, many_graphs, rel_frame

QUERY = "query_id string, source string, target string"


#: A hop is a job or more, so the deepest graphs take minutes; without this the tests take shallower ones.
SLOW = os.environ.get("SLOW_TESTS") == "1"


def ladder(rungs, ways):
    """``rungs`` diamonds in a row, each with so many ways round."""
    edges = []
    for i in range(rungs):
        a, b = f"n{i:03d}", f"n{i + 1:03d}"
        for w in range(ways):
            edges += [(f"r{i:03d}-{w:04d}-1", a, f"m{w:04d}-{i:03d}", [f"e{i}-{w}"]), (f"r{i:03d}-{w:04d}-2", f"m{w:04d}-{i:03d}", b, [f"e{i}-{w}"])]
    return edges


def small_shuffles(spark):
    """Hundreds of tiny jobs: one partition each, and no plan at run time."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    return held


def restore(spark, held):
    for k, v in held.items():
        spark.conf.set(k, v)


def listed(found):
    out = defaultdict(dict)
    for r in found.chains.collect():
        out[r.query_id].setdefault(r.chain_index, []).append((r.position, r.to_id, r.rel_id, r.walked_direction))
    return {q: {i: [s[1:] for s in sorted(c)] for i, c in by.items()} for q, by in out.items()}


@pytest.mark.parametrize("direction", ["out", "both"])
def test_counts_and_pages_match_the_list(spark, monkeypatch, direction):
    monkeypatch.setattr(chains, "WINDOW_EDGES", 3)
    monkeypatch.setattr(chains, "BLOCK", 2)
    monkeypatch.setattr(traversal, "ONE_WINDOW", 2)
    graphs = many_graphs(11, 10, n_nodes=6, n_edges=22)
    rels = cut(rel_frame(spark, [e for _, edges in graphs for e in edges]), "graph")
    asked = [(f"{i}-{t}", nodes[0], nodes[t]) for i, (nodes, _) in enumerate(graphs) for t in (0, 1, 3, 5)] + [("far", "g0-a", "g1-a"), ("gone", "no", "node")]
    graph = traversal.chain_graph(rels, spark.createDataFrame(asked, QUERY), max_depth=5, direction=direction)
    want = {q: chains_model(graphs[int(q[0])][1], src, dst, 5, direction) for q, src, dst in asked[:-2]} | {"far": [], "gone": []}
    counts = {r.query_id: (r.found, int(r.n_chains), r.hop_count) for r in chains.totals(graph).collect()}
    assert counts == {q: (bool(c), len(c), len(c[0]) if c else None) for q, c in want.items()}
    assert any(len(c) > 3 for c in want.values())
    for first, limit in ((0, None), (0, 2), (1, 2), (2, None)):
        last = None if limit is None else first + limit
        page = traversal.list_chains(graph, rels, first=first, limit=limit)
        assert listed(page) == {q: p for q, c in want.items() if (p := {i: s for i, s in enumerate(c) if s and i >= first and (last is None or i < last)})}
        shown = {r.query_id: (r.n_chains, r.truncated) for r in page.summary.collect()}
        assert shown == {q: (len(c[first:last]), last is not None and len(c) > last) for q, c in want.items()}


@pytest.mark.parametrize("rungs,ways", [(6, 1024), *([(60, 2)] if SLOW else [])])
def test_a_ladder_of_diamonds(spark, rungs, ways):
    """2**60 chains: counted, paged and compared by their edges."""
    held = small_shuffles(spark)
    try:
        rels = cut(rel_frame(spark, ladder(rungs, ways)), "graph")
        graph = traversal.chain_graph(rels, spark.createDataFrame([("q", "n000", f"n{rungs:03d}")], QUERY))
        total = chains.totals(graph).first()
        assert (total.hop_count, total.n_chains) == (2 * rungs, Decimal(2**60))

        def name(i):
            return [i // ways**k % ways for k in reversed(range(rungs))]

        def shown(page):
            return {i: [int(s[0][1:5]) for s in c[::2]] for i, c in listed(page)["q"].items()}

        page = traversal.list_chains(graph, rels, limit=3)
        assert shown(page) == {i: name(i) for i in range(3)}
        assert [(r.n_chains, r.truncated) for r in page.summary.collect()] == [(3, True)]
        assert shown(traversal.list_chains(graph, rels, first=2**59 + 2, limit=1)) == {2**59 + 2: name(2**59 + 2)}
        edges = cut(chains.marked_edges(graph), "marked")
        evidence = spark.createDataFrame([(f"e{i}-{w}",) for i in range(rungs) for w in range(ways)], "id string")
        events = spark.createDataFrame([], "id string, derived_from array<string>")
        overlap = lineage.counted_overlap(graph, edges, rels, events, evidence).first()
        assert len(overlap.shared_evidence_ids) == rungs * ways and overlap.fully_evidence_independent is False
    finally:
        restore(spark, held)


def test_counts_stop_at_38_digits(spark):
    held = small_shuffles(spark)
    try:
        rels = cut(rel_frame(spark, [(f"r{i:02d}-{k:02d}", f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) for k in range(100)]), "graph")
        graph = traversal.chain_graph(rels, spark.createDataFrame([("q", "n00", "n20"), ("p", "n02", "n20")], QUERY))
        got = {r.query_id: r.n_chains for r in chains.totals(graph).collect()}
        assert got == {"q": Decimal(chains.MOST), "p": Decimal(10**36)}
        found = listed(traversal.list_chains(graph, rels, first=101, limit=2))
        assert {i: "".join(s[1][-2:] for s in c) for i, c in found["q"].items()} == {101: "00" * 18 + "0101", 102: "00" * 18 + "0102"}
    finally:
        restore(spark, held)


def overlap_frames(spark, seed):
    rng = random.Random(seed)
    graphs = many_graphs(seed, 14, n_nodes=6, n_edges=16)
    refs = [f"e{i}" for i in range(9)] + [f"v{i}" for i in range(6)] + ["gone"]
    edges = [(*e, rng.sample(refs, rng.choice([0, 1, 1, 2]))) for _, edges in graphs for e in edges]
    evidence = spark.createDataFrame([(f"e{i}",) for i in range(9)], "id string")
    events = spark.createDataFrame([(f"v{i}", rng.sample(refs, 2)) for i in range(6)], "id string, derived_from array<string>")
    asked = [(f"{i}-{t}", nodes[0], nodes[t]) for i, (nodes, _) in enumerate(graphs) for t in range(6)]
    return cut(rel_frame(spark, edges), "graph"), evidence, events, spark.createDataFrame(asked, QUERY)


@pytest.mark.parametrize("seed", [1, 2])
def test_what_chains_share_follows_from_their_edges(spark, seed):
    rels, evidence, events, asked = overlap_frames(spark, seed)
    found = traversal.all_shortest_paths(rels, asked, direction="both")
    listing, summary = cut(found.chains, "chains"), cut(found.summary, "summary")
    overlap = cut(lineage.evidence_overlap(summary, lineage.chain_roots(listing, events, evidence)), "overlap")
    graph = traversal.chain_graph(rels, asked, direction="both")
    edges = cut(chains.marked_edges(graph), "marked")
    counted = cut(lineage.counted_overlap(graph, edges, rels, events, evidence), "counted")
    rows = lambda df: sorted((r.query_id, int(r.n_chains), tuple(r.shared_evidence_ids), r.fully_evidence_independent) for r in df.collect())
    assert rows(counted) == rows(overlap)
    assert {v for *_, v in rows(counted)} == {True, False, None}
    votes = lambda df: sorted((r.query_id, r.method, r.predicted) for r in df.collect())
    assert votes(evaluation.counted_predictions(graph, edges, rels, counted)) == votes(evaluation.predictions(summary, listing, overlap))


def test_nothing_to_count(spark):
    rels = rel_frame(spark, [("r", "a", "b", ["x"])])
    none = spark.createDataFrame([], QUERY)
    for asked in (none, spark.createDataFrame([("q", "b", "a"), ("s", "b", "b")], QUERY)):
        graph = traversal.chain_graph(rels, asked)
        assert chains.prefixes(graph).count() == 0 and chains.marked_edges(graph).count() == 0
        assert traversal.list_chains(graph, rels, limit=4).chains.count() == 0
        assert {r.query_id: int(r.n_chains) for r in chains.totals(graph).collect()} == ({} if asked is none else {"q": 0, "s": 1})
    with pytest.raises(ValueError):
        traversal.list_chains(graph, rels, limit=0)


def test_a_long_walk(spark, monkeypatch):
    """Rows do not grow with the depth, and neither does a plan."""
    hops = 1000 if SLOW else 80
    held = small_shuffles(spark)
    widths = set()
    real = Growing.add
    monkeypatch.setattr(Growing, "add", lambda self, df, **m: (lambda made: (widths.add(made[0].schema.simpleString()), made)[1])(real(self, df, **m)))
    try:
        rels = cut(rel_frame(spark, [(f"r{i:04d}", f"n{i:04d}", f"n{i + 1:04d}") for i in range(hops)]), "graph")
        origins = spark.createDataFrame([("q", "n0000")], "query_id string, origin string")
        got = {r.entity_id: r.hop_count for r in traversal.distances(rels, origins, max_depth=None).collect()}
        assert got == {f"n{i:04d}": i for i in range(hops + 1)} and len(widths) == 1 and "array" not in widths.pop()
    finally:
        restore(spark, held)


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("fewer", ["sources", "targets"])
def test_least_chain_from_either_end(spark, direction, fewer):
    """Searches from the sources and from the targets give the chain that a queue meets first."""
    graphs = many_graphs(21, 6, n_nodes=9, n_edges=16)
    rels = cut(rel_frame(spark, [e for _, edges in graphs for e in edges]), "graph")
    asked = [(f"{i}-{n}", *((nodes[0], n) if fewer == "sources" else (n, nodes[0]))) for i, (nodes, _) in enumerate(graphs) for n in nodes]
    found = traversal.shortest_path(rels, spark.createDataFrame(asked, QUERY), direction=direction)
    got = defaultdict(list)
    for r in found.chains.collect():
        got[r.query_id].append((r.to_id, r.rel_id, r.walked_direction))
    lengths = {r.query_id: (r.found, r.hop_count) for r in found.summary.collect()}
    for q, src, dst in asked:
        first, node, back = bfs_model(graphs[int(q.split("-")[0])][1], src, 9, direction), dst, []
        while node != src and node in first:
            _, prev, rel, way = first[node]
            back.append((node, rel, way))
            node = prev
        there = src == dst or dst in first
        assert got.get(q, []) == (back[::-1] if there else []) and lengths[q] == (there, len(back) if there else None)


def test_queries_that_share_an_end_share_its_search(spark, monkeypatch):
    """Forty sources, one target: one search, and nothing beyond what leads to it."""
    sizes = []
    real = traversal.cut_counted
    monkeypatch.setattr(traversal, "cut_counted", lambda df, label="stage": (lambda r: (sizes.append((label, r[1])), r)[1])(real(df, label)))
    edges = [(f"a{i:02d}", f"s{i:02d}", "m") for i in range(40)] + [("b", "m", "t")] + [(f"x{i:03d}", "s00", f"y{i:03d}") for i in range(300)]
    q = spark.createDataFrame([(f"q{i:02d}", f"s{i:02d}", "t") for i in range(40)], QUERY)
    graph = traversal.chain_graph(rel_frame(spark, edges), q)
    assert [n for label, n in sizes if label == "level"] == [1, 40, 0]
    assert {(r.hop_count, int(r.n_chains)) for r in chains.totals(graph).collect()} == {(2, 1)}


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_levels_numbered_over_range_partitions(spark, monkeypatch, direction):
    monkeypatch.setattr(traversal, "ONE_WINDOW", 1)
    graphs = many_graphs(23, 6, n_nodes=9, n_edges=16)
    rels = cut(rel_frame(spark, [e for _, edges in graphs for e in edges]), "graph")
    origins = spark.createDataFrame([(f"{i}", nodes[0]) for i, (nodes, _) in enumerate(graphs)], "query_id string, origin string")
    got = defaultdict(dict)
    for r in traversal.neighbors(rels, origins, max_depth=None, direction=direction).collect():
        got[r.query_id][r.entity_id] = (r.hop_count, r.from_id, r.rel_id, r.walked_direction)
    assert got == {f"{i}": want for i, (nodes, edges) in enumerate(graphs) if (want := bfs_model(edges, nodes[0], 9, direction))}


def roots_model(events, evidence):
    out = {}
    for ref in {*evidence, *[e for e, _ in events]}:
        seen, todo, roots = set(), [ref], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in evidence:
                roots.add(at)
            else:
                todo += [n for e, refs in events if e == at for n in refs]
        if roots:
            out[ref] = roots
    return out


def test_roots_of_a_long_line_and_rings(spark, monkeypatch):
    """Five thousand events in a line, rings with and without a way out: written pairs follow the output."""
    line = [(f"l{i:04d}", [f"l{i + 1:04d}"]) for i in range(4999)] + [("l4999", ["e0"])]
    rings = [("c0", ["c1"]), ("c1", ["c2"]), ("c2", ["c0"]), ("into", ["c1"]), ("d0", ["d1"]), ("d1", ["d0", "e1"]), ("from", ["d0", "l0000"]), ("self", ["self", "e2"]), ("own", ["own"])]
    ids = ["e0", "e1", "e2"]
    written = []
    real = Growing.add
    monkeypatch.setattr(Growing, "add", lambda self, df, **m: (lambda made: (written.append(made[1]["n"]), made)[1])(real(self, df, **m)))
    events = spark.createDataFrame(line + rings, "id string, derived_from array<string>")
    got = defaultdict(set)
    for r in lineage.root_map(events, spark.createDataFrame([(i,) for i in ids], "id string")).collect():
        assert r.root_id not in got[r.ref_id]
        got[r.ref_id].add(r.root_id)
    want = {f"l{i:04d}": {"e0"} for i in range(5000)} | {i: {i} for i in ids} | {"d0": {"e1"}, "d1": {"e1"}, "from": {"e0", "e1"}, "self": {"e2"}}
    assert got == want
    assert sum(written) < 10 and len(written) < 6


@pytest.mark.parametrize("near", [0, 6])
def test_roots_match_a_walk(spark, monkeypatch, near):
    monkeypatch.setattr(lineage, "NEAR_LEVELS", near)
    rng = random.Random(12)
    ids = [f"e{i}" for i in range(12)]
    names = [f"v{i}" for i in range(60)]
    events = [(v, rng.sample(ids + names + ["gone", "lost"], rng.choice([0, 1, 1, 2, 3]))) for v in names] + [("e3", ["v1"])]
    frame, known = spark.createDataFrame(events, "id string, derived_from array<string>"), spark.createDataFrame([(i,) for i in ids], "id string")
    want = roots_model(events, set(ids))
    got = defaultdict(set)
    for r in lineage.root_map(frame, known).collect():
        got[r.ref_id].add(r.root_id)
    assert got == want
    some = spark.createDataFrame([("v5",), ("v5",), ("e3",), ("gone",), ("v40",)], "ref_id string")
    few = {(r.ref_id, r.root_id) for r in lineage.root_map(frame, known, some).collect()}
    assert few == {(ref, root) for ref in ("v5", "e3", "v40") for root in want.get(ref, ())}
