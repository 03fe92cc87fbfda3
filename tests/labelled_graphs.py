"""Labelled graphs for chain evidence, as edges and lineage.

Each entry: fixture id, set, class, branches, lineage, expected roots per chain,
truth on roots and on direct references, adversarial flag. A branch is a list of
cited-id lists, one per edge from A to D.
"""


def events(prefix, n, root):
    return {f"{prefix}{i}": [root] for i in range(1, n + 1)}


def star(*cites):
    """Two-hop branches; each names what its two edges cite."""
    return [[[a], [b]] for a, b in cites]


def G(fid, version, kind, branches, lineage, roots, root, direct, adversarial=False):
    return dict(id=fid, version=version, kind=kind, branches=branches, lineage=lineage, roots=roots,
                root=root, direct=direct, adversarial=adversarial)


# Ids, classes and expected results of the published graphs.
GRAPHS = [
    G("single-path-01", 1, "SINGLE_PATH", [[["E1"]]], {}, [["E1"]], None, None),
    G("shared-root-01", 1, "SHARED_ROOT", star(("E1", "E1"), ("E1", "E2")), {}, [["E1"], ["E1", "E2"]], False, False),
    G("disjoint-roots-01", 1, "DISJOINT_ROOTS", star(("E1", "E1"), ("E2", "E2")), {}, [["E1"], ["E2"]], True, True),
    G("identical-root-sets-01", 1, "IDENTICAL_ROOT_SETS", star(*[("E1", "E1")] * 3), {}, [["E1"]] * 3, False, False),
    G("partial-overlap-01", 1, "PARTIAL_OVERLAP", star(("E1", "E2"), ("E2", "E3"), ("E4", "E4")), {},
      [["E1", "E2"], ["E2", "E3"], ["E4"]], False, False),
    G("path-count-deception-01", 1, "PATH_COUNT_DECEPTION", star(*[("E1", "E1")] * 8), {}, [["E1"]] * 8, False, False),
    G("disjoint-multi-evidence-01", 1, "DISJOINT_MULTI_EVIDENCE", star(("E1", "E2"), ("E3", "E4")), {}, [["E1", "E2"], ["E3", "E4"]], True, True),
    G("byte-distinct-same-source-01", 1, "BYTE_DISTINCT_SAME_SOURCE", star(("E1", "E1"), ("E2", "E2")), {}, [["E1"], ["E2"]], True, True, True),
    G("direct-different-shared-root-01", 2, "DIRECT_DIFFERENT_SHARED_ROOT", star(("V1", "V1"), ("V2", "V2")), events("V", 2, "E1"), [["E1"]] * 2, False, True),
    G("direct-same-root-disjoint-01", 2, "DIRECT_SAME_ROOT_DISJOINT", star(("V1", "V1"), ("V2", "V2")), {"V1": ["E1"], "V2": ["E2"]}, [["E1"], ["E2"]], True, True),
    G("multi-level-lineage-01", 2, "MULTI_LEVEL_LINEAGE", star(("V1", "V2"), ("V3", "V4")), events("V", 4, "E1"), [["E1"]] * 2, False, True),
    G("mixed-direct-derived-01", 2, "MIXED_DIRECT_DERIVED", star(("E1", "E1"), ("V1", "V1")), {"V1": ["E1"]}, [["E1"]] * 2, False, True),
    G("high-path-shared-root-01", 2, "HIGH_PATH_SHARED_ROOT", star(*[(f"V{i}", f"V{i}") for i in range(1, 7)]), events("V", 6, "E1"), [["E1"]] * 6, False, True),
    G("high-path-disjoint-root-01", 2, "HIGH_PATH_DISJOINT_ROOT", star(*[(f"E{i}", f"E{i}") for i in range(1, 7)]), {}, [[f"E{i}"] for i in range(1, 7)], True, True),
    G("partial-multi-root-01", 2, "PARTIAL_MULTI_ROOT", star(("E1", "E2"), ("E2", "E3"), ("E3", "E4"), ("E5", "E5")), {},
      [["E1", "E2"], ["E2", "E3"], ["E3", "E4"], ["E5"]], False, False),
    G("v3-multi-level-lineage-01", 3, "MULTI_LEVEL_LINEAGE", [[["E1"]], [["V2"]]], {"V1": ["E1"], "V2": ["V1"]}, [["E1"]] * 2, False, True),
    G("v3-mixed-root-depth-01", 3, "MIXED_ROOT_DEPTH", [[["E1"]], [["V1"]]], {"V1": ["E1"]}, [["E1"]] * 2, False, True),
    G("v3-cross-branch-shared-root-01", 3, "CROSS_BRANCH_SHARED_ROOT", star(("E1", "E1"), ("E1", "E1")), {}, [["E1"]] * 2, False, False),
    G("v3-cross-branch-disjoint-root-01", 3, "CROSS_BRANCH_DISJOINT_ROOT", star(("E1", "E1"), ("E2", "E2")), {}, [["E1"], ["E2"]], True, True),
    G("v3-high-multiplicity-collapse-01", 3, "HIGH_MULTIPLICITY_COLLAPSE", [[[f"V{3 * b + h}"] for h in (1, 2, 3)] for b in range(5)], events("V", 15, "E1"), [["E1"]] * 5, False, True),
    G("v3-high-multiplicity-disjoint-01", 3, "HIGH_MULTIPLICITY_DISJOINT", [[[f"V{3 * b + h}"] for h in (1, 2, 3)] for b in range(5)],
      {f"V{3 * b + h}": [f"E{b + 1}"] for b in range(5) for h in (1, 2, 3)}, [[f"E{i}"] for i in range(1, 6)], True, True),
    G("v3-partial-overlap-complex-01", 3, "PARTIAL_OVERLAP_COMPLEX", star(("E1", "E2"), ("E2", "E3"), ("E3", "E4"), ("E5", "E5")), {},
      [["E1", "E2"], ["E2", "E3"], ["E3", "E4"], ["E5"]], False, False),
    G("v3-redundant-representations-01", 3, "REDUNDANT_REPRESENTATIONS", [[["V1"]], [["V2"]]], events("V", 2, "E1"), [["E1"]] * 2, False, True),
    G("v3-direct-reference-decoy-01", 3, "DIRECT_REFERENCE_DECOY", [[["V1"], ["V2"], ["V3"]], [["V4"], ["V5"], ["V6"]]], events("V", 6, "E1"), [["E1"]] * 2, False, True),
    G("v3-direct-reference-convergence-01", 3, "DIRECT_REFERENCE_CONVERGENCE", [[["E1", "decoy"]], [["E2", "decoy"]]], {}, [["E1"], ["E2"]], True, False),
    G("v3-same-source-disjoint-root-01", 3, "SAME_SOURCE_DISJOINT_ROOT", [[["E1"]], [["E2"]]], {}, [["E1"], ["E2"]], True, True, True),
    G("v3-byte-identical-different-source-01", 3, "BYTE_IDENTICAL_DIFFERENT_SOURCE", [[["E1"]], [["E1"]]], {}, [["E1"]] * 2, False, False, True),
]


def tables():
    """Edges, lineage and evidence of all graphs in one id space."""
    edges, lineage, evidence, truth = [], [], set(), []
    for g in GRAPHS:
        name = lambda x, g=g: f"{g['id']}/{x}"
        for b, branch in enumerate(g["branches"]):
            nodes = ["A", *[f"m{b}-{i}" for i in range(1, len(branch))], "D"]
            for i, refs in enumerate(branch):
                edges.append((f"{g['id']}-r{b}-{i}", name(nodes[i]), name(nodes[i + 1]), [name(r) for r in refs]))
        lineage += [(name(v), [name(r) for r in refs]) for v, refs in g["lineage"].items()]
        evidence |= {name(r) for s in g["roots"] for r in s}
        direct = [sorted({name(r) for refs in branch for r in refs}) for branch in g["branches"]]
        truth.append((g["id"], g["kind"], g["adversarial"], g["root"], g["direct"], len(g["branches"]),
                      [[name(r) for r in s] for s in g["roots"]], direct))
    return edges, lineage, sorted(evidence), truth
