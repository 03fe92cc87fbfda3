"""Substring removal, near-duplicates and components against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from provenir.llm import minhash, stars, substrings
from tests.llm.rows import documents, frame, sentence, shingles, words


def removed(texts, least=35):
    held = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + least]) for w in held for i in range(len(w) - least + 1))
    out = []
    for w in held:
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                gone[i : i + least] = [True] * least
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def passages(seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([20, 34, 35, 36, 60, 90]), 9) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([sentence(rng, rng.randrange(1, 60), 400), rng.choice(pool)]) for _ in range(rng.randrange(1, 5))]
        texts.append(" ".join(parts))
    return texts + ["q " * 90, "q " * 34, "q " * 36]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings_against_all_windows(spark, seed):
    texts = passages(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()}
    assert got == dict(enumerate(removed(texts)))


def test_substrings_odd_rows(spark):
    rows = documents()
    out = substrings.remove_repeats(frame(spark))
    got = Counter((r.doc_id, r.source, r.n_words, r.n_removed, r.kept) for r in out.collect())
    assert got == Counter((r[0], r[2], *x) for r, x in zip(rows, removed([r[1] for r in rows]), strict=True))
    assert set(out.columns) == {*frame(spark).columns, "n_words", "n_removed"}
    assert substrings.remove_repeats(frame(spark, [])).collect() == []


def components(rows):
    """By plain comparison of all sets; rows without id apart."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        group[find(i)].append(d)
    least = {k: min(v) if None not in v else None for k, v in group.items()}
    return Counter((d, len(sets[i]), least[find(i)], least[find(i)] is None or least[find(i)] == d) for i, (d, _) in enumerate(rows))


def test_near_duplicates_odd_rows(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark)).collect())
    assert got == components([(r[0], r[1]) for r in documents()])
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def chains(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        w = sentence(rng, 80, 4000).split()
        for _ in range(12):
            rows.append((rng.randrange(10**6), " ".join(w)))
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("tile", [256, 4])
def test_near_duplicates_chains_and_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = chains(7)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows)


def test_texts_on_one_template_are_taken_apart(spark, monkeypatch):
    """Sets of resemblance 0.33 meet in buckets by chance and form large groups; their first shingles part them."""
    monkeypatch.setattr(minhash, "TILE", 32)
    seen, plain = [], minhash.taken_apart

    def spy(sets):
        out = plain(sets)
        seen.append((sets.count(), out.count(), out.agg({"slots": "max"}).first()[0]))
        return out

    monkeypatch.setattr(minhash, "taken_apart", spy)
    rng = random.Random(12)
    template = sentence(rng, 84, 10**6)
    rows = [(i, f"{template} {sentence(rng, 80, 10**6)}") for i in range(300)]
    for i in range(300, 320):
        w = rows[i - 300][1].split()
        w[150] = "changed"
        rows.append((i, " ".join(w)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows) and sum(k[3] for k in got) == 300
    (before, after, slots), = seen
    assert before > 200 and after <= 40 and slots == 1


def test_linked_sets_share_a_first_shingle():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 400]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut_at in range(len(a)):
            b = np.unique(np.concatenate([a[cut_at:], rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)]))
            if len(b) and minhash.alike(a, b):
                counts = rng.integers(0, 3, minhash.COUNTERS)
                assert np.intersect1d(minhash.first_shingles(9, a, counts), minhash.first_shingles(9, b, counts)).size


def test_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5), (7, 6), (6, 7)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for n in sorted(near):
        todo = [n] if n not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = n
                todo += near[x]
    got = stars.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(want.items())


def test_buckets_find_alike_sets():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate([a[:172], rng.integers(0, 1 << 63, 28, dtype=np.uint64)])
        names = minhash.bands(minhash.minima(np.concatenate([a, b]), np.array([0, 200, 400])))
        missed += not (names[0] == names[1]).any()
    assert missed == 0


def test_queries_on_the_small_tables(spark, sf_dir):
    from provenir.llm.queries import op6_substrings, op7_near_duplicates

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, k, t) in zip(rows, removed([t for _, t in rows]), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substrings(spark, sf_dir).collect()} == want
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op7_near_duplicates(spark, sf_dir).collect())
    assert got == components(rows)


def test_finished_stars_take_no_further_round(spark, monkeypatch):
    labels, cut = [], stars.cut
    monkeypatch.setattr(stars, "cut", lambda df, label="stage": (labels.append(label), cut(df, label))[1])
    edges = spark.createDataFrame([(b, a) for a in (1, 100) for b in range(a + 1, a + 20)], "a long, b long")
    got = {r.node: r.component for r in stars.components(edges).collect()}
    assert got == {n: a for a in (1, 100) for n in range(a, a + 20)}
    assert "stars-large" not in labels


def test_only_texts_of_candidates_go_into_the_join(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-500, 500)] + [(None, "n")], "doc_id long, text string")
    wanted = [*range(-500, 500, 7), 10**12]
    got = {r.doc_id for r in minhash.with_id_among(rows, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()}
    assert got >= {i for i in wanted if i < 500}
    assert len(got) <= len(wanted) + 20
    assert minhash.with_id_among(rows, spark.createDataFrame([], "doc_id long")).collect() == []


@pytest.mark.parametrize("seed, chunk", [(1, 7), (2, 40), (3, None)])
def test_components_contracted_in_chunks(spark, seed, chunk):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1120)] + [(2000, i) for i in range(2001, 2060)]
    want = {x: x for edge in edges if edge[0] != edge[1] for x in edge}
    while any(want[a] != want[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = [(r.node, r.component) for r in stars.components(df, chunk=chunk).collect()]
    assert sorted(got) == sorted(want.items())


def test_few_edges_take_no_round(spark, monkeypatch):
    labels, cut = [], stars.cut
    monkeypatch.setattr(stars, "cut", lambda df, label="stage": (labels.append(label), cut(df, label))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").repartition(4)
    assert {r.component for r in stars.components(edges).collect()} == {0}
    assert labels == []
