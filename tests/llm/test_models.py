"""Language model, mixing, fingerprints, toxicity and top-k against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import fingerprints as fp
from provenir.llm import lm, mixing, topk, toxic_features, toxicity
from tests.llm.rows import documents, frame, shingles, words


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def base_scores(rows):
    counts = Counter()
    for i, t in rows:
        if fold(i, 5) != 1:
            counts.update([*words(t, True), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*words(t, True), None]
        score = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        out.append((i, fold(i, 5) == 1, len(own), sum(counts[x] > 0 for x in own), n, round(score, 6)))
    return Counter(out)


def trained():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1


def test_language_model_rows(spark):
    got = lm.score_texts(frame(spark).repartition(3), trained()).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base_scores([(r[0], r[1]) for r in documents()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(frame(spark, []), trained()).collect() == []
    untrained = lm.score_texts(frame(spark), F.lit(False)).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in untrained)


def test_language_model_is_a_distribution(spark):
    """Over all known words and one unknown word of every class, next-word probabilities sum to 1."""
    rows = [(i, t) for i, t in enumerate(["a b c a b", "b c d", "a a", "d e f g"])]
    blocks = lm.write_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(True))
    totals, _ = lm.count_words(blocks)
    core = lm.core_words(totals)
    bigrams = lm.unit_bigrams(blocks, core)
    member = lm.exchange(bigrams)
    model = lm.Model(bigrams, member, core, totals)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass = np.zeros(lm.CLASSES)
    for r in totals.collect():
        c = member[lm.unit_of(bytes(r.word), core)]
        mass[c] += (r.total + 0.5) / 10 ** model.bottom[c]
    assert np.allclose(mass + 0.5 / 10**model.bottom, 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 4, 40)
    table = np.array([[rng.poisson(50 if kind[j] == (kind[i] + 1) % 4 else 1) for j in range(40)] + [1] for i in range(40)] + [[1] * 41])
    found = lm.exchange(table, classes=4)
    assert all(len({found[i] for i in range(40) if kind[i] == k}) == 1 for k in range(4)) and found[40] == 4


def test_best_class_is_the_one_of_highest_likelihood():
    rng = np.random.default_rng(3)
    words, classes = 30, 5
    table = rng.poisson(0.7, (words + 1, words + 1))
    member = np.append(rng.integers(0, classes, words), classes)

    def pairs(member):
        onehot = np.eye(classes + 1, dtype=np.int64)[member]
        return onehot.T @ table @ onehot

    for u in range(words):
        out, inn = table[u] @ np.eye(classes + 1)[member], table[:, u] @ np.eye(classes + 1)[member]
        out[member[u]] -= table[u, u]
        inn[member[u]] -= table[u, u]
        cells = np.concatenate([out, inn, [table[u, u]]]).astype(np.int64)
        slot = np.flatnonzero(cells)
        found = lm.best_classes(pairs(member), np.zeros(len(slot), np.int64), slot, cells[slot], member[u : u + 1])[0]
        plain = [lm.likelihood(pairs(np.concatenate([member[:u], [c], member[u + 1 :]]))) for c in range(classes)]
        assert plain[found] > max(plain) - 1e-6


def test_rare_words_have_classes_of_their_own(spark):
    """Words outside the most frequent, alike in their last letters, are told apart by their contexts."""
    rng = random.Random(4)
    common = [f"c{i}x{i * 7 % 13}" for i in range(lm.CORE + 9)]
    rare = [f"r{i}zzz" for i in range(40)]
    # Four kinds of words follow one another in turn.
    pick = lambda k: rng.choice(rare[k % 4 :: 4] if rng.random() < 0.02 else common[k % 4 :: 4])
    texts = [" ".join(pick(k) for k in range(i, i + 100)) for i in range(150)]
    around = [(rng.choice(common[(i - 1) % 4 :: 4]), x, rng.choice(common[(i + 1) % 4 :: 4])) for i, x in enumerate(rare)]
    right, wrong = [" ".join(x) for x in around], [" ".join(x[::-1]) for x in around]
    docs = spark.createDataFrame(list(enumerate(texts + right + wrong)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in lm.score_texts(docs.repartition(3), F.col("doc_id") < len(texts)).collect()}
    better = [got[len(texts) + i] > got[len(texts) + len(rare) + i] + 1 for i in range(len(rare))]
    assert sum(better) >= 36


def test_words_moved_by_rounds_keep_the_counts(spark):
    """After the rounds, classes are one per word, known words by class add up, and partitioning plays no part."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 901), k=200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [sorted((x.doc_id, round(x.score, 6)) for x in lm.score_texts(docs.repartition(n), F.col("doc_id") % 5 != 1).collect()) for n in (1, 5)]
    assert scores[0] == scores[1]


def test_model_beats_the_base_on_held_out_texts(spark):
    from provenir.llm.queries import op4_class_scores

    rows = op4_class_scores(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_targets_stop_and_share_the_excess(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), (None, 0), ("d", 300)]
    got = {r.source: (r.weight, r.target) for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left, open_ = 1810 * 1.5, {s: w for s, w in zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True)}
    size, want = dict(sizes), {}
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) >= 2 * size[s]]
        if not over:
            want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            want[s] = 2 * size[s]
            open_.pop(s)
        left = 1810 * 1.5 - sum(want.values())
    assert got.keys() == want.keys() and all(abs(got[s][1] - want[s]) < 1e-9 for s in want)
    assert {s: w for s, (w, _) in got.items()} == {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}


def test_mixing_rows(spark, monkeypatch):
    rows = documents()
    first = mixing.mix(frame(spark).repartition(4)).collect()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    again = mixing.mix(frame(spark).repartition(2)).collect()
    look = lambda x: Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in x)
    assert look(first) == look(again) and len(first) == len(rows)
    taken, target = Counter(), {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_position_inverts_the_demand(spark):
    points = [(0.0, 1.0), (0.25, 3.0), (0.25, 0.0), (0.5, 0.0), (1.0, 2.0)]
    area = lambda t: sum((min(t, b) - a) * (x + (x + (y - x) * (min(t, b) - a) / (b - a))) / 2 for (a, x), (b, y) in zip(points, points[1:], strict=False) if b > a and t > a)
    goals = [i / 50 for i in range(50)]
    rows = spark.createDataFrame([(g * 1000,) for g in goals], "d double").select("d", mixing.position(F.col("d"), F.lit(1000.0), points).alias("t")).collect()
    for r in rows:
        assert abs(area(r.t) / area(1.0) - r.d / 1000) < 1e-9


def test_training_order(spark):
    docs = frame(spark).repartition(3)
    mixed = mixing.mix(docs)
    out = mixing.training_order(docs, mixed, {"s": [(0.0, 0.0), (1.0, 1.0)]})
    want = Counter()
    for r in mixed.collect():
        if r.size:
            want[r.doc_id, r.size] += round(r.taken / r.size + 1e-12)
    got = Counter((r.doc_id, len(words(r.text))) for r in out.collect())
    assert set(got) <= set(want) and abs(sum(got.values()) - sum(want.values())) <= 1
    assert out.columns == docs.columns


def test_mix_takes_the_passes_that_have_a_position(spark):
    """A plain walk through each source's stream, its positions found by halving the integrated schedule."""
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randrange(9)), "s" if i % 3 else rng.choice(["t", "u", None])) for i in range(120)]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in mixed.collect()}
    areas = [lambda t: 1.5 * t - t * t / 2, lambda t: 0.5 * t + t * t / 2, lambda t: 0.5 * t + t * t if t < 0.5 else 0.5 + 1.5 * (t - 0.5) - (t - 0.5) ** 2]
    for turn, source in enumerate(["s", "t", "u", None]):
        stream = sorted((d for d in docs if d[2] == source), key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest())
        demand, given, taken, first = round(got[stream[0][0]].target), 0, Counter(), {}
        while given < demand:
            for i, text, _ in stream:
                size = len(text.split())
                if size and given < demand:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        middle = (low + high) / 2
                        low, high = (middle, high) if areas[turn % 3](middle) < given / got[i].target else (low, middle)
                    first.setdefault(i, high)
                    taken[i] += min(size, demand - given)
                given += size
        for i, _, _ in stream:
            assert got[i].taken == taken[i] and (got[i].position is None) == (i not in first)
            assert i not in first or abs(got[i].position - first[i]) < 1e-9
    order = [r.position for r in mixing.by_position(mixed).collect()]
    assert order == sorted(order, key=lambda p: -1 if p is None else p)


def test_training_order_keeps_clashing_columns(spark):
    rows = [(1, "a b c", "s", "k", 0.5, "r"), (1, "a b c", "s", "k", 0.5, "r"), (1, "a b d", "s", None, 0.5, "r"), (2, None, None, "k", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string, mix_position double, mix_row string")
    out = mixing.training_order(docs, mixing.mix(docs))
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == set(rows[:3])
    other = mixing.training_order(docs.repartition(3), mixing.mix(docs.repartition(3)))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, other.collect()))


def test_fingerprints_of_edited_texts(spark):
    rows = sorted(((r[0], r[1] or "") for r in documents()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fp.compare_edited(frame(spark).repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want, prints = Counter(), {}
        for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
            want[i, len(t), hashlib.sha256(fp.edited(t, n).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert len({r.fingerprint for r in got}) == len({shingles(t) for _, t in rows})
        assert prints == {}
    assert fp.compare_edited(frame(spark, [])).collect() == []
    assert [r.near_edited for r in fp.compare_edited(frame(spark, [(1, "aa aa", None, None, None, None, None)])).collect()] == [1.0]


def test_fingerprints_estimate_and_merge(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(3000)]
    a = [rng.choice(pool) for _ in range(2000)]
    b = a[:1500] + [rng.choice(pool) for _ in range(500)]
    x, y = fp.bottom([" ".join(a), " ".join(b)], fp.WordHashes())
    s, t = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(fp.resemblance(x, y) - len(s & t) / len(s | t)) < 0.15
    assert abs(fp.containment(x, y) - len(s & t) / len(s)) < 0.2 and abs(fp.distinct(x) / len(s) - 1) < 0.3
    assert (fp.parsed(fp.printed(x)) == x).all()
    df = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, None), (None, "a b")], "doc_id long, text string")
    whole = {r.doc_id: r.fingerprint for r in fp.merge(fp.fingerprint(df.repartition(3)), "doc_id").collect()}
    assert whole[1] == np.union1d(x, y)[: fp.SIZE].view(np.int64).tolist() and whole[2] == []
    both = fp.fingerprint(df.filter("doc_id = 1")).agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    assert abs(both.select(fp.likeness(F.col("a"), F.col("b"))).first()[0] - fp.resemblance(x, y)) < 1e-12


def toxic_rows(n):
    rng = random.Random(8)
    clean = [f"word{i}" for i in range(300)]
    bad = ["rotter", "swinehund", "blighter"]
    rows = []
    for i in range(n):
        text = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        mark = i % 4 == 0
        if mark:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["you", *bad, *bad]))
            text.insert(0, rng.choice(bad))
        rows.append((i, " ".join(text), "s", 1, "k", 0.5, int(mark)))
    return rows


def test_toxicity_learns_from_its_fold_alone(spark):
    rows = toxic_rows(600)
    labels = [(r[0], r[6]) for r in rows] + [(None, 1), (5, None), (10**6, 1)]
    spoiled = [(i, y if i is None or fold(i, 4) != 2 else 1) for i, y in labels]
    docs = frame(spark, [*rows, (None, None, None, None, None, None, None), (9000, "", "s", 1, "k", 0.1, 0)])
    out = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = out.collect()
    assert set(out.columns) == {*docs.columns, "score", "held_out", "predicted"} and len(got) == 602
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    held = [(r.predicted, r.label) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    again = toxicity.classify(docs, spark.createDataFrame(spoiled, "doc_id long, toxic int")).collect()
    clash = {"measures": "int", "m_0": "string", "probability": "string", "raw_score": "double", "score": "string", "row": "int"}
    odd = docs.limit(20).select("*", *[F.lit(None).cast(k).alias(c) for c, k in clash.items()])
    found = toxicity.classify(odd.repartition(2), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(found.columns) == {*odd.columns, "held_out", "predicted"} and found.filter("score >= 0").count() == 20
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(frame(spark), none).collect()
    assert len(got) == len(documents()) and {r.score for r in got} == {0.0}
    assert toxicity.classify(frame(spark, []), none).collect() == []


def test_few_labels_still_fit_trees(spark):
    """A label that would miss a fold by chance does not; with two rows of a label all rows fit everything."""
    rows = toxic_rows(600)
    docs = frame(spark, rows)
    trained = [r for r in rows if fold(r[0], 4) != 2]
    few = [r for r in trained if r[6]][:8] + [r for r in trained if not r[6]][:52]
    got = toxicity.classify(docs, spark.createDataFrame([(r[0], r[6]) for r in few], "doc_id long, toxic int")).collect()
    assert sum(r.predicted == r.label for r in got) >= 0.9 * len(got)
    four = [r for r in trained if r[6]][:2] + [r for r in trained if not r[6]][:2]
    got = toxicity.classify(docs, spark.createDataFrame([(r[0], r[6]) for r in four], "doc_id long, toxic int")).collect()
    assert 0 < sum(r.predicted for r in got) < len(got) and all(0 <= r.score <= 1 for r in got)
    one = toxicity.classify(docs, spark.createDataFrame([(r[0], 0) for r in few], "doc_id long, toxic int")).collect()
    assert {r.score for r in one} == {0.0}


def test_fit_rows_keep_the_rarer_label(spark):
    """Beyond the bound the rarer label is kept first; weights restore the rate; every fold has both labels."""
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(20_000)], "doc_id long, toxic int")
    for most, rare in [(1000, None), (100, 50)]:
        got = toxicity.fit_rows(labels, F.lit(True), most=most).collect()
        toxic = [r for r in got if r.toxic]
        assert len(toxic) == 200 if rare is None else abs(len(toxic) - rare) < 30
        assert abs(len(got) - most) < 5 * most**0.5 + 30
        assert abs(sum(r.weight for r in toxic) / sum(r.weight for r in got) - 0.01) < 0.005
        assert {(r.toxic, r.fold) for r in got} == {(y, k) for y in (0, 1) for k in range(3)}
    every = toxicity.fit_rows(labels, F.lit(True), most=10**6)
    assert every.count() == 20_000 and every.filter("weight <> 1").count() == 0
    assert toxicity.fit_rows(labels.limit(0), F.lit(True)).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    """On the next larger tables: the smallest hold out two toxic texts."""
    from provenir.llm.queries import op9_toxicity

    sf_dir = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in op9_toxicity(spark, sf_dir).collect() if r.held_out and marks.get(r.doc_id) is not None]
    one, other = ([r.score for r in got if marks[r.doc_id] == y] for y in (1, 0))
    assert one and other
    above = sum((a > b) + (a == b) / 2 for a in one for b in other) / (len(one) * len(other))
    assert above > 0.8, above


def test_disguised_words_are_hits():
    lexicon = {b"=idiot": 3.0, b"^idio": 2.0}
    plain, hidden, clean = (toxic_features.measures(t, lexicon, {}) for t in ("you idiot", "you 1d!ot###", "you there"))
    name = toxic_features.FEATURES.index
    assert plain[name("word_density")] == hidden[name("word_density")] == 0.5 and clean[name("word_density")] == 0
    assert hidden[name("disguised_hits")] == 0.5 and plain[name("near_you")] == 1


VECTORS = "vec_id long, embedding array<float>, score double, rank int"


def vectors():
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.0, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0] * 6) for i in range(300, 420)]
    rows += [(450, None), (500, [None, 1.0]), (550, [float("nan")] * 6), (551, [float("inf")] * 6), (None, [1.0] * 6), (600, [0.5, 0.5]), (601, [0.5, -0.5]), (650, []), (700, []), (7, [0.1] * 6), (100, [2.0] * 6), (100, [-2.0] * 6)]
    return [(i, v, 0.5, 1) for i, v in rows]


def best(rows, k=5):
    good = [(i, [math.floor(np.float64(np.float32(x)) * 256) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 40])
def test_top_k(spark, shard):
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best(vectors())
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [2.0**20, 2.0**24, 2.0**40, 1e30])
@pytest.mark.parametrize("shard", [4096, 7])
def test_top_k_of_large_components(spark, size, shard):
    """Products beyond 53 bits, 64 bits and 38 digits: neighbours differ in their last digits."""
    rng = random.Random(int(size))
    rows = [(i, [size + rng.randrange(-3, 4) / 256, -size + rng.randrange(-3, 4) / 256, rng.randrange(-3, 4) * size]) for i in range(60)]
    rows += [(i, [rng.random(), rng.random(), 0.0]) for i in range(60, 80)] + [(100, [0.0, 0.0, 0.0])]
    least, most = -(2**63), 2**63 - 1
    held = [(i, [min(max(math.floor(x * 256), least), most) for x in v]) for i, v in rows]
    want = []
    for q, own in held:
        if q % 50 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(own, v, strict=True)), -topk.MOST), topk.MOST), i) for i, v in held if i != q)[:5]
            want += [(q, n + 1, i, min(max(-s, least), most)) for n, (s, i) in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_boxes_bound_the_scores():
    rng = np.random.default_rng(2)
    points, queries = rng.integers(-9, 9, (200, 5)).astype(float), rng.integers(-9, 9, (7, 5)).astype(float)
    tree = topk.Tree(np.arange(200), points, 16)
    for leaf, (a, z) in enumerate(tree.edges):
        assert (tree.bounds(queries)[:, leaf] >= (queries @ tree.points[a:z].T).max(axis=1)).all()
    assert sorted(tree.ids.tolist()) == list(range(200)) and max(z - a for a, z in tree.edges) <= 16
