"""Whitening against exact fractions and numpy on small tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from provenir.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int, whitened double"


def vectors():
    rng = random.Random(4)
    made = [(i, [3.5 + rng.gauss(0, s) for s in (2.0, 1.0, 0.5, 0.25, 0.1)], 1, "c", 9, 0.5) for i in range(300)]
    copies = [(1000 + i, made[7][1], 1, "c", 9, 0.5) for i in range(150)]
    odd = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [1.0, float("nan"), 1.0, 1.0, 1.0]), (2003, [float("inf")] * 5), (2004, []),
           (None, made[3][1]), (5, made[5][1]), (3000, [1.0, 2.0]), (3001, [2.0, -1.0]), (3002, [0.25, 0.5]), (4000, [7.0])]
    return made + copies + [(i, v, 1, "c", 9, 0.5) for i, v in odd]


def model(points, components=4):
    """Number of distinct vectors, mean and scaled leading axes, with an exact covariance."""
    fit = sorted(set(points))
    n, dims = len(fit), len(fit[0])
    mean = [Fraction(sum(p[d] for p in fit), n) for d in range(dims)]
    cov = [[float(sum((p[a] - mean[a]) * (p[b] - mean[b]) for p in fit) / n) for b in range(dims)] for a in range(dims)]
    values, axes = np.linalg.eigh(np.array(cov))
    return n, mean, values[::-1][:components], axes.T[::-1][:components], float(np.trace(cov))


def expected(rows):
    out, kept = {}, {}
    for key, v, *_ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.setdefault(len(v), []).append((key, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    for own in kept.values():
        n, mean, values, axes, trace = model([p for _, p in own])
        for key, p in own:
            away = [a - m for a, m in zip(p, mean, strict=True)]
            far = sum((n * a) ** 2 for a in away)
            for c, (e, axis) in enumerate(zip(values, axes, strict=True)):
                z = float(np.dot([float(a) for a in away], axis)) / math.sqrt(e) if e > 1e-9 else None
                out.setdefault((key, c + 1, n, int(far)), []).append((z, e / trace if trace else None))
    return out


def test_whitened_rows(spark):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(5)
    found = whitening.whiten(df)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, want = {}, expected(vectors())
    for r in found.collect():
        got.setdefault((r.vec_id, r.component, r.n, int(r.deviation)), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for key, rows in got.items():
        for r, (z, explained) in zip(rows, want[key], strict=True):
            if z is None:
                assert r.whitened is None
                continue
            assert abs(r.whitened) == pytest.approx(abs(z), abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
            if abs(z) > 1e-6:
                signs.setdefault((r.n, r.component), set()).add(r.whitened * z > 0)
            assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows
    single = [r for rows in got.values() for r in rows if r.vec_id == 4000]
    assert [(r.n, r.whitened, r.explained, r.identity_error) for r in single] == [(1, None, None, None)]


def test_partitions_and_nothing(spark):
    rows = vectors()[:60]
    one = sorted(whitening.whiten(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("vec_id", "component", "deviation").collect())
    many = sorted(whitening.whiten(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).select("vec_id", "component", "deviation").collect())
    assert one == many
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == whitening.whiten(spark.createDataFrame(rows, SCHEMA)).columns


@pytest.mark.parametrize("size", [3, 1 << 20, 1 << 31, 1 << 62])
def test_sums_are_exact_at_any_size(size):
    rng = random.Random(size)
    points = [[rng.randrange(-size, size) for _ in range(4)] for _ in range(50)]
    array = np.array(points, dtype=np.int64)
    centre = whitening.Centre(len(points), tuple(sum(p[d] for p in points) for d in range(4)))
    centred = whitening.shifted(array, centre.middle)
    n, sums = centre.n, centre.sums
    found = whitening.squares(centred)
    for i in range(4):
        for j in range(i, 4):
            own = [(n * (p[i] + (p[j] if j > i else 0)) - sums[i] - (sums[j] if j > i else 0)) ** 2 for p in points]
            rest = centre.rest[i] + (centre.rest[j] if j > i else 0)
            assert n * n * found[i, j] - n * rest**2 == sum(own)
    assert whitening.deviations(centred, centre) == [sum((n * v - s) ** 2 for v, s in zip(p, sums, strict=True)) for p in points]
    cov = whitening.covariance(found, centre)
    mean = [Fraction(s, n) for s in sums]
    exact = [[float(sum((p[a] - mean[a]) * (p[b] - mean[b]) for p in points) / n) for b in range(4)] for a in range(4)]
    assert np.allclose(cov, exact, rtol=1e-12)
    for total in found.values():
        assert sum(v << (whitening.LIMB_BITS * k) for k, v in enumerate(whitening.limbs(total))) == total


def test_a_far_mean_costs_no_digits(spark):
    """Entries near 2**30 that differ by little: squares of the raw entries would swallow the variance."""
    rng = random.Random(8)
    rows = [(i, [float(1 << 22) + rng.randrange(4) / 2, float(1 << 22) + rng.randrange(2) / 2, rng.random()]) for i in range(200)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, mean, values, axes, trace = model([tuple(math.floor(256 * c) for c in v) for _, v in rows])
    for r in found:
        away = [float(math.floor(256 * c) - m) for c, m in zip(rows[r.vec_id][1], mean, strict=True)]
        c = r.component - 1
        assert abs(r.whitened) == pytest.approx(abs(float(np.dot(away, axes[c]))) / math.sqrt(values[c]), abs=1e-8)
        assert r.explained == pytest.approx(values[c] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_query_against_numpy(spark, sf_dir):
    from provenir.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = expected(rows)
    got = QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == sum(len(v) for v in want.values())
    for r in got:
        (z, explained), = want[r.vec_id, r.component, r.n, r.deviation]
        assert abs(r.whitened) == pytest.approx(abs(z), abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-8) and r.identity_error < 1e-8
