"""Traversal, chains, lineage and components against plain models."""

import random

import pytest

from provenir.operators import components, lineage, traversal
from tests.models import T0

REL = "id string, relationship_type string, source_entity_id string, target_entity_id string, attributes map<string,string>, derived_from array<string>, created_at timestamp"


def rel_frame(spark, edges):
    """edges: (id, src, dst[, refs])"""
    return spark.createDataFrame(
        [(e[0], "r", e[1], e[2], {}, list(e[3]) if len(e) > 3 else ["x"], T0) for e in edges], REL)


def steps_of(edges, node, direction):
    out = []
    if direction in ("out", "both"):
        out += [(e[2], e[0], "forward") for e in sorted(edges) if e[1] == node]
    if direction in ("in", "both"):
        out += [(e[1], e[0], "backward") for e in sorted(edges) if e[2] == node]
    return out


def bfs_model(edges, origin, depth, direction):
    found, seen, frontier = {}, {origin}, [origin]
    for hop in range(1, depth + 1):
        nxt = []
        for node in frontier:
            for to, rel, way in steps_of(edges, node, direction):
                if to not in seen:
                    seen.add(to)
                    found[to] = (hop, node, rel, way)
                    nxt.append(to)
        frontier = nxt
    return found


def chains_model(edges, src, dst, depth, direction):
    """All shortest chains in order: lists of (to, rel, way)."""
    if src == dst:
        return [[]]
    layer = [(src, [])]
    for _ in range(depth):
        grown = [(to, c + [(to, rel, way)]) for node, c in layer for to, rel, way in steps_of(edges, node, direction)
                 if to != src and to not in [s[0] for s in c]]
        hits = [c for node, c in grown if node == dst]
        if hits:
            return sorted(hits, key=lambda c: [(s[0], s[1]) for s in c])
        layer = grown
    return []


def random_edges(rng, nodes, n):
    out = []
    while len(out) < n:
        a, b = rng.choice(nodes), rng.choice(nodes)
        if a != b:
            out.append((f"r{rng.randint(0, 10**6):06d}", a, b))
    return list({e[0]: e for e in out}.values())


def many_graphs(seed, count, n_nodes=7, n_edges=11):
    """Disjoint random graphs in one edge list, so one job tests all of them."""
    rng = random.Random(seed)
    graphs = []
    for g in range(count):
        nodes = [f"g{g}-{chr(97 + i)}" for i in range(n_nodes)]
        edges = [(f"{e[0]}-{g}", e[1], e[2]) for e in random_edges(rng, nodes, n_edges)]
        graphs.append((nodes, edges))
    return graphs


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_neighbors_match_model(spark, direction):
    graphs = many_graphs(5, 12)
    rels = rel_frame(spark, [e for _, edges in graphs for e in edges]).cache()
    origins = spark.createDataFrame(
        [(f"{i}", nodes[0]) for i, (nodes, _) in enumerate(graphs)] + [("x", "unknown")], "query_id string, origin string")
    got = {}
    for r in traversal.neighbors(rels, origins, max_depth=4, direction=direction).collect():
        got.setdefault(r.query_id, {})[r.entity_id] = (r.hop_count, r.from_id, r.rel_id, r.walked_direction)
    for i, (nodes, edges) in enumerate(graphs):
        assert got.get(str(i), {}) == bfs_model(edges, nodes[0], 4, direction)
    assert "x" not in got


def test_more_than_500_ties(spark):
    mids = [f"m{i:03d}" for i in range(30)]
    ends = [f"n{i:03d}" for i in range(30)]
    edges = [(f"a-{m}", "s", m) for m in mids] + [(f"{m}-{n}", m, n) for m in mids for n in ends] + [(f"{n}-z", n, "t") for n in ends]
    q = spark.createDataFrame([("q", "s", "t"), ("r", "s", "n001")], "query_id string, source string, target string")
    found = traversal.all_shortest_paths(rel_frame(spark, edges), q)
    assert {(r.query_id, r.n_chains, r.truncated) for r in found.summary.collect()} == {("q", 900, False), ("r", 30, False)}
    chains = {}
    for r in found.chains.collect():
        chains.setdefault((r.query_id, r.chain_index), []).append(r.to_id)
    assert [chains["q", i] for i in range(900)] == [[m, n, "t"] for m in mids for n in ends]


@pytest.mark.parametrize("broadcast", [True, False])
def test_hub_steps_are_dealt_out(spark, monkeypatch, broadcast):
    monkeypatch.setattr(traversal, "HUB_STEPS", 10)
    if not broadcast:
        monkeypatch.setattr(traversal, "MAX_BROADCAST_KEYS", 0)
    edges = [(f"r{i:04d}", "hub", f"x{i:04d}") for i in range(300)] + [(f"s{i:04d}", f"x{i:04d}", "t") for i in range(0, 300, 3)] + [("in", "a", "hub")]
    rels = rel_frame(spark, edges)
    walk = traversal._walk(rels, "out")
    assert walk.steps.where("from_id = 'hub'").select("part").distinct().count() == 30
    origins = spark.createDataFrame([("q", "a")], "query_id string, origin string")
    got = {r.entity_id: r.hop_count for r in traversal.distances(rels, origins, max_depth=None).collect()}
    assert got == {"a": 0, "hub": 1, **{f"x{i:04d}": 2 for i in range(300)}, "t": 3}
    q = spark.createDataFrame([("q", "a", "t")], "query_id string, source string, target string")
    assert traversal.all_shortest_paths(rels, q).summary.first().n_chains == 100


def test_only_forward_edges_are_walked_back(spark, monkeypatch):
    """Edges into the target from nodes that the search never met are not in any frame of it."""
    seen = []
    real = traversal.cut_counted
    monkeypatch.setattr(traversal, "cut_counted", lambda df, label="stage": (lambda r: (seen.append((label, r[1])), r)[1])(real(df, label)))
    edges = [("r1", "a", "t")] + [(f"z{i:03d}", f"z{i}", "t") for i in range(200)]
    q = spark.createDataFrame([("q", "a", "t")], "query_id string, source string, target string")
    assert traversal.all_shortest_paths(rel_frame(spark, edges), q).summary.first().n_chains == 1
    assert [n for label, n in seen if label == "level"] == [1, 0]


@pytest.mark.parametrize("direction,limit", [("out", 2), ("both", None)])
def test_paths_match_model(spark, direction, limit):
    graphs = many_graphs(9, 14, n_nodes=6, n_edges=14)
    rels = rel_frame(spark, [e for _, edges in graphs for e in edges]).cache()
    queries = [(f"{i}-{t}", nodes[0], nodes[t]) for i, (nodes, _) in enumerate(graphs) for t in (0, 2, 5)]
    frame = spark.createDataFrame(queries + [("far", "g0-a", "g1-a")], "query_id string, source string, target string")
    one = traversal.shortest_path(rels, frame, max_depth=5, direction=direction)
    every = traversal.all_shortest_paths(rels, frame, max_depth=5, direction=direction, limit=limit)
    one_summary = {r.query_id: r for r in one.summary.collect()}
    all_summary = {r.query_id: r for r in every.summary.collect()}
    one_chain, all_chains = {}, {}
    for r in one.chains.collect():
        one_chain.setdefault(r.query_id, []).append((r.to_id, r.rel_id, r.walked_direction))
    for r in every.chains.collect():
        all_chains.setdefault(r.query_id, {}).setdefault(r.chain_index, []).append((r.to_id, r.rel_id, r.walked_direction))
    for q, src, dst in queries:
        edges = graphs[int(q.split("-")[0])][1]
        want = chains_model(edges, src, dst, 5, direction)
        s, a = one_summary[q], all_summary[q]
        assert s.found == a.found == bool(want)
        if not want:
            assert s.hop_count is None and a.n_chains == 0 and not a.truncated
            continue
        assert s.hop_count == a.hop_count == len(want[0])
        shown = want[:limit]
        assert a.n_chains == len(shown) and a.truncated == (len(want) > len(shown))
        got = [all_chains.get(q, {}).get(i, []) for i in range(a.n_chains)]
        assert got == want[:limit]
        first = bfs_model(edges, src, 5, direction)
        node, back = dst, []
        while node != src:
            _, prev, rel, way = first[node]
            back.append((node, rel, way))
            node = prev
        assert one_chain.get(q, []) == back[::-1]
    assert not one_summary["far"].found


def test_long_chain_and_argument_checks(spark):
    rels = rel_frame(spark, [(f"r{i:02d}", f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)])
    q = spark.createDataFrame([("q", "n00", "n14")], "query_id string, source string, target string")
    assert traversal.shortest_path(rels, q, max_depth=14).summary.first().hop_count == 14
    assert not traversal.shortest_path(rels, q, max_depth=13).summary.first().found
    assert traversal.shortest_path(rels, q).summary.first().hop_count == 14
    with pytest.raises(ValueError):
        traversal.shortest_path(rels, q, max_depth=0)
    with pytest.raises(ValueError):
        traversal.all_shortest_paths(rels, q, limit=0)
    with pytest.raises(ValueError):
        traversal.steps(rels, "sideways")


def test_parallel_edges_and_distances(spark):
    rels = rel_frame(spark, [("r1", "a", "b"), ("r2", "a", "b"), ("r3", "b", "c")])
    q = spark.createDataFrame([("q", "a", "c")], "query_id string, source string, target string")
    got = traversal.all_shortest_paths(rels, q, limit=2)
    s = got.summary.first()
    assert (s.n_chains, s.truncated, s.hop_count) == (2, False, 2)
    origins = spark.createDataFrame([("q", "a")], "query_id string, origin string")
    d = {r.entity_id: r.hop_count for r in traversal.distances(rels, origins, max_depth=9).collect()}
    assert d == {"a": 0, "b": 1, "c": 2}


def test_roots_and_overlap(spark):
    evidence = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("both",)], "id string")
    events = spark.createDataFrame(
        [("v1", ["e1"]), ("v2", ["v1", "gone"]), ("v3", ["v2", "e2"]), ("c1", ["c2", "e3"]), ("c2", ["c1"]),
         ("both", ["e1"]), ("lost", ["gone"])], "id string, derived_from array<string>")
    got = {}
    for r in lineage.root_map(events, evidence).collect():
        got.setdefault(r.ref_id, set()).add(r.root_id)
    assert got == {"e1": {"e1"}, "e2": {"e2"}, "e3": {"e3"}, "both": {"both"}, "v1": {"e1"}, "v2": {"e1"},
                   "v3": {"e1", "e2"}, "c1": {"e3"}, "c2": {"e3"}}
    chains = spark.createDataFrame(
        [("q1", 0, ["e1"]), ("q1", 1, ["v2"]), ("q2", 0, ["e1", "gone"]), ("q2", 1, ["e2", "gone"]), ("q3", 0, ["v3"])],
        "query_id string, chain_index int, derived_from array<string>")
    summary = spark.createDataFrame([("q1", 2), ("q2", 2), ("q3", 1)], "query_id string, n_chains int")
    verdict = {r.query_id: r for r in lineage.evidence_overlap(summary, lineage.chain_roots(chains, events, evidence)).collect()}
    assert verdict["q1"].fully_evidence_independent is False and verdict["q1"].shared_evidence_ids == ["e1"]
    assert verdict["q2"].fully_evidence_independent is True
    assert verdict["q3"].fully_evidence_independent is None


def components_model(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return groups


def test_components_match_model(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03d}" for i in range(150)]
    edges = random_edges(rng, nodes, 95) + [(f"p{i:02d}", f"z{i:02d}", f"z{i + 1:02d}") for i in range(30)]
    edges += [("hub%02d" % i, "hub", f"leaf{i:02d}") for i in range(20)]
    want = components_model(edges)
    got = components.find_components(rel_frame(spark, edges), min_size=3)
    big = sorted(k for k, v in want.items() if len(v) >= 3)
    rows = sorted(got.components.collect(), key=lambda r: r.component_index)
    assert [(r.component, r.n_entities) for r in rows] == [(k, len(want[k])) for k in big]
    assert [r.component_index for r in rows] == list(range(len(big)))
    members = {}
    for r in got.members.collect():
        members.setdefault(r.component, set()).add(r.entity_id)
    assert members == {k: want[k] for k in big}
    s = got.stats.first()
    assert (s.total_entities_in_graph, s.total_relationships, s.total_components_found) == (
        sum(map(len, want.values())), len(edges), len(want))
    assert got.relationships.count() == sum(1 for e in edges if any(e[1] in want[k] for k in big))


def test_components_of_nothing(spark):
    got = components.find_components(rel_frame(spark, [("r", "a", "b")]).limit(0))
    assert got.components.count() == 0 and got.stats.first().total_components_found == 0
    with pytest.raises(ValueError):
        components.find_components(rel_frame(spark, [("r", "a", "b")]), min_size=0)


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, w int").repartition(6)
    want, sums = {}, {"a": 0, "b": 0}
    for k, t, w in sorted(rows):
        want[k, t] = sums[k]
        sums[k] += w
    assert {(r.k, r.t): r.before for r in components.running_totals(df, "k", "t", "w", "before").collect()} == want


def test_star_centers_meet_their_least_by_broadcast(spark, monkeypatch):
    edges = [(f"r{i}", "a" if i % 3 else "b", f"n{i:02}") for i in range(40)] + [("x", "b", "n01"), ("y", "p", "q"), ("z", "n00", "q")]
    whole = {(r.node, r.component) for r in components.labels(_pairs(spark, edges)).collect()}
    found, real = [], components.hot_keys
    monkeypatch.setattr(components, "HOT_LINKS", 3)
    monkeypatch.setattr(components, "hot_keys", lambda *a: (found.append(out := real(*a)), out)[1])
    assert {(r.node, r.component) for r in components.labels(_pairs(spark, edges)).collect()} == whole
    assert whole == {(n, "a") for n in ["a", "b", "p", "q", *[f"n{i:02}" for i in range(40)]]}
    assert any(h is not None for h in found)


def _pairs(spark, edges):
    return spark.createDataFrame([(a, b) for _, a, b in edges], "a string, b string")


def test_hops_deal_relationship_ids_as_bytes(spark):
    """Steps go through joins with ids as bytes; ids that are no digests keep their order and come back."""
    ids = ["zz", "0f" * 32, "F" * 64, "é", ""]
    rels = spark.createDataFrame(
        [(x, "k", "a", "b", ["e"]) for x in ids] + [("last", "k", "b", "c", ["e"])],
        "id string, relationship_type string, source_entity_id string, target_entity_id string, derived_from array<string>")
    walk = traversal._walk(rels, "out")
    assert dict(walk.steps.dtypes)["rel_id"] == "binary"
    queries = spark.createDataFrame([("q", "a", "c")], "query_id string, source string, target string")
    every = traversal.all_shortest_paths(rels, queries).chains.where("position = 0").collect()
    assert sorted(r.rel_id for r in every) == sorted(ids)
    near = traversal.neighbors(rels, spark.createDataFrame([("q", "a")], "query_id string, origin string"), max_depth=None)
    assert [(r.entity_id, r.rel_id) for r in near.collect()] == [("b", ""), ("c", "last")]
