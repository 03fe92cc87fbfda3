"""Filter interactions against a walk through every order, document by document."""

import random
from itertools import permutations

import pytest

from provenir.llm import interactions
from tests.compare import connect, rows_of

FLAGS = "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean"


def walk(rows, names):
    """``rows``: part, failed filters, good, toxic. Each order is applied document by document."""
    out, shapley = {}, {}
    for order in permutations(names):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, own in enumerate(order, 1):
                hit = [r for r in left if own in r[1]]
                left = [r for r in left if own not in r[1]]
                only = sum(1 for r in rows if r[0] == part and r[1] == {own})
                out[part, "".join(order), step] = (len(left), len(hit), sum(own in r[1] for r in gone), only, sum(r[2] for r in hit), sum(r[3] for r in hit), own)
                shapley[part, own] = shapley.get((part, own), 0) + len(hit)
                gone += hit
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def collected(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_matches_every_order(spark):
    rng = random.Random(3)
    raw = [(rng.choice(["x", "y", ""]), *[rng.choice([True, False, False, None]) for _ in range(5)], rng.random() < 0.4, rng.choice([True, False, None])) for _ in range(160)]
    raw += [("clean", *[False] * 5, True, False)] * 3 + [("hot", True, True, False, False, True, True, True)] * 500
    plain = [(r[0], {n for n, f in zip("ABCDE", r[1:6], strict=True) if f}, bool(r[6]), bool(r[7])) for r in raw]
    assert collected(interactions.audit(spark.createDataFrame(raw, FLAGS).repartition(4))) == walk(plain, "ABCDE")
    assert interactions.audit(spark.createDataFrame([], FLAGS)).count() == 0


def test_fewer_filters(spark):
    raw = [("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0) for i in range(100)]
    df = spark.createDataFrame(raw, "part string, A boolean, B boolean, C boolean, good boolean")
    got = collected(interactions.audit(df, ("A", "B", "C"), ("good",)))
    want = walk([(r[0], {n for n, f in zip("ABC", r[1:4], strict=True) if f}, r[4], False) for r in raw], "ABC")
    assert got == {k: (*v[:5], v[6]) for k, v in want.items()}


DOCS = "doc_id long, text string, lang string, source string, part string, digest string, first boolean, quality int, A int"


def plain_failures(docs, labels):
    out = []
    for doc, text, lang, *_ in docs:
        t = text or ""
        words = [w for w in t.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        failed = set()
        failed |= {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        failed |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        failed |= {"E"} if doc is not None and any(o[0] is not None and o[0] < doc and (o[1] or "") == t for o in docs) else set()
        own = [x for x in labels if x[0] is not None and x[0] == doc]
        out.append((lang or "", failed, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    return out


def test_failures_of_odd_documents(spark):
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", " \t\n", long, long, long.upper(), "x " * 120, "ÄÖÜ ärger 😀", "a | b", "100\x1f%", "z" * 40_000, "A" * 9 + "b" * 81, "A" * 10 + "b" * 90, "A" * 11 + "b" * 89,
             " ".join(["s"] * 21 + [f"w{i}" for i in range(79)]), " ".join(["s"] * 20 + [f"w{i}" for i in range(80)]), "one two"]
    docs = [(i * 2, t, rng.choice(["en", None, ""]), "s", "clash", "clash", False, 5, 5) for i, t in enumerate(texts)]
    docs += [docs[3], (6, "other text", "en", "s", "p", "d", True, 1, 1)] + [(None, t, "en", "s", "p", "d", True, 1, 1) for t in (long, long, "")] + [(100 + i, long, "fr", "s", "p", "d", True, 1, 1) for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (999, 1, 1)]
    found = interactions.failures(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = sorted((r.part, "".join(f for f in "ABCDE" if r[f]), bool(r.good), bool(r.toxic)) for r in found.collect())
    assert got == sorted((p, "".join(sorted(f)), g, t) for p, f, g, t in plain_failures(docs, labels))


@pytest.mark.parametrize("name", ["op13_filter_audit"])
def test_query_against_sql_and_a_walk(spark, sf_dir, name):
    from provenir.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    con = connect(sf_dir)
    cur = con.execute(ORACLES[name])
    rows = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, rows) == rows_of([c[0] for c in cur.description], cur.fetchall())
    docs = con.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    labels = con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()
    assert {r[:3]: r[3:] for r in rows} == walk(plain_failures(docs, labels), "ABCDE")
