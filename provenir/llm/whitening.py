"""Whitening of embeddings on their leading principal components, with covariances by polarisation.

Vectors become whole numbers. The fit list holds each distinct vector once. Tasks add
up squares for every dimension and for the sum of every two dimensions; as the
variance of a sum is both variances and twice the covariance, differences of these
variances give every cross-covariance. The matrix goes to ``eigh``, and a last pass
projects every vector.

All sums are exact. A vector is centred before anything is multiplied: first on the
mean rounded to a whole number, in whole numbers; what rounding left over is put back
into the totals as whole numbers too, so they equal the sums of (n*x - S)**2. Sums
leave a task as five limbs of 32 bits, which Spark adds up. Batches whose squares
might not fit 64 bits are added as Python integers.

There is one model for each length of vectors; models are made one after the other,
and a model of d dimensions holds d * d numbers, which is all that the driver sees.

Results of ``whiten``: a vector that is null, or has a null or non-finite entry, has
no rows; an empty vector has no components; a null id and repeated rows are kept; a
component whose eigenvalue is zero in double precision has a null ``whitened`` and
stays out of ``identity_error``, and with no variance at all ``explained`` is null
too; a vector shorter than ``components`` has as many components as dimensions; an
empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.topk import whole_numbers
from provenir.llm.words import bounded_batches
from provenir.session import cut

COMPONENTS = 4
#: Sums below this fit 64 bits with room to spare.
SAFE = 1 << 62
LIMBS, LIMB_BITS = 5, 32
#: Vectors of one batch are worked on in slices of so many numbers, pair sums included.
SLICE_NUMBERS = 1 << 21
SUMS = "i int, j int, " + ", ".join(f"limb{k} long" for k in range(LIMBS))
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


@dataclass(frozen=True)
class Centre:
    """Number of fit vectors and exact sums; ``middle``: means rounded down to whole numbers."""

    n: int
    sums: tuple[int, ...]

    @property
    def middle(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what is left of each mean beyond its middle; at most n / 2 either way."""
        return [s - self.n * m for s, m in zip(self.sums, self.middle, strict=True)]


@dataclass(frozen=True)
class Model:
    centre: Centre
    axes: np.ndarray  # one component per row
    values: np.ndarray  # eigenvalues of the leading components, 0 where there is no variance
    explained: np.ndarray


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def shifted(points: np.ndarray, middle: list[int]) -> np.ndarray:
    """``points - middle``, as Python integers where 64 bits might not do."""
    reach = max((int(points.max()), -int(points.min()), *map(abs, middle)), default=0) if points.size else 0
    if 2 * reach < SAFE:
        return points - np.array(middle, dtype=np.int64)
    return points.astype(object) - np.array(middle, dtype=object)


def squares(centred: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums over the rows of y_i**2, under (i, i), and of (y_i + y_j)**2, under (i, j)."""
    rows, dims = centred.shape
    if centred.dtype != object and centred.size and 4 * int(np.abs(centred).max()) ** 2 * rows >= SAFE:
        centred = centred.astype(object)
    out = {}
    for i in range(dims):
        own = centred[:, i]
        pairs = own[:, None] + centred[:, i + 1 :]
        out[i, i] = int((own * own).sum())
        totals = np.einsum("rp,rp->p", pairs, pairs) if centred.dtype != object else (pairs * pairs).sum(axis=0)
        out |= {(i, i + 1 + p): int(t) for p, t in enumerate(np.atleast_1d(totals))}
    return out


def limbs(total: int) -> list[int]:
    return [(total >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS)]


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, SLICE_NUMBERS // max(dims, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sum_entries(fit: DataFrame, dims: int) -> Centre:
    """Number of vectors and exact sums of their entries; a task's sums travel as a high and a low part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in _slices(batches, dims):
            points = matrix(batch.column(0), dims)
            reach = max(int(points.max()), -int(points.min()))
            here = (points if reach * len(points) < SAFE else points.astype(object)).sum(axis=0)
            n, sums = n + len(points), [a + int(b) for a, b in zip(sums, here, strict=True)]
        if n:
            low = [s & ((1 << LIMB_BITS) - 1) for s in sums]
            high = [s >> LIMB_BITS for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                names=["i", "n", "high", "low"],
            )

    parts = fit.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    found = sorted(parts.collect())
    return Centre(found[0].n, tuple((r.high << LIMB_BITS) + r.low for r in found))


def sum_squares(fit: DataFrame, dims: int, centre: Centre) -> dict[tuple[int, int], int]:
    """Exact sums of squares over all of ``fit`` (x), by dimension and pair of dimensions."""
    middle = centre.middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in _slices(batches, dims):
            for pair, value in squares(shifted(matrix(batch.column(0), dims), middle)).items():
                totals[pair] = totals.get(pair, 0) + value
        if totals:
            keys = np.array(list(totals), dtype=np.int32)
            values = np.array([limbs(t) for t in totals.values()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array(values[:, k]) for k in range(LIMBS)]],
                names=["i", "j", *[f"limb{k}" for k in range(LIMBS)]],
            )

    parts = fit.mapInArrow(run, SUMS).groupBy("i", "j").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)])
    return {(r.i, r.j): sum(r[f"limb{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for r in parts.collect()}


def covariance(found: dict[tuple[int, int], int], centre: Centre) -> np.ndarray:
    """The covariance matrix, divisor n, from sums of squares of dimensions and of their pairs.

    n * (sum of y**2) - (sum of y)**2, over n**2, is the variance of y; here for single
    dimensions and pair sums alike, in whole numbers up to the last division.
    """
    n, rest, dims = centre.n, centre.rest, len(centre.sums)
    spread = {(i, j): n * t - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), t in found.items()}
    out = np.zeros((dims, dims))
    for (i, j), v in spread.items():
        twice = 2 * v if i == j else v - spread[i, i] - spread[j, j]
        out[i, j] = out[j, i] = twice / (2 * n * n)
    return out


def fit_model(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Model:
    """Model of the distinct vectors ``fit`` (x), all of ``dims`` entries."""
    centre = sum_entries(fit, dims)
    cov = covariance(sum_squares(fit, dims, centre), centre)
    scale = np.abs(cov).max()
    values, vectors = np.linalg.eigh(cov / scale if scale else cov)
    values, axes = values[::-1][:components] * scale, vectors.T[::-1][:components]
    # Below this an eigenvalue is rounding alone.
    values = np.where(values > dims * np.finfo(float).eps * scale, values, 0.0)
    trace = float(np.trace(cov))
    return Model(centre, axes, values, values / trace if trace > 0 else np.full(len(values), np.nan))


def deviations(centred: np.ndarray, centre: Centre) -> list[int]:
    """Per row the exact sum of (n*x - S)**2."""
    n, rest = centre.n, centre.rest
    reach = int(np.abs(centred).max()) if centred.size and centred.dtype != object else 0
    if centred.dtype != object and n * (reach + 1) < 1 << 31 and (n * (reach + 1)) ** 2 * max(1, len(rest)) < SAFE:
        far = n * centred - np.array(rest, dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    return [sum((n * int(y) - r) ** 2 for y, r in zip(row, rest, strict=True)) for row in centred]


def project(model: Model, centred: np.ndarray) -> np.ndarray:
    """One row per vector, one column per component; without variance NaN."""
    away = centred.astype(np.float64) - np.array(model.centre.rest, dtype=np.float64) / model.centre.n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, (away @ model.axes.T) / np.sqrt(model.values), np.nan)


def _projected(rows: DataFrame, dims: int, model: Model) -> DataFrame:
    """``vec_id``, ``deviation`` and the array ``z`` of whitened values for every row of ``rows`` (vec_id, x)."""
    middle = model.centre.middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, dims):
            centred = shifted(matrix(batch.column(1), dims), middle)
            far = [d if d < 10**38 else None for d in deviations(centred, model.centre)]
            z = project(model, centred)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if d is None else str(d) for d in far], pa.string()), lists], names=["vec_id", "deviation", "z"]
            )

    return rows.mapInArrow(run, "vec_id long, deviation string, z array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(fit: DataFrame, dims: int, model: Model) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; measured, not inferred."""
    live = [c for c in range(len(model.values)) if model.values[c] > 0]
    if not live:
        return None
    z = _projected(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), dims, model).select(*[F.col("z")[c].alias(f"z{c}") for c in live])
    pairs = [(a, b) for a in live for b in live if a <= b]
    # Spark's covariance updates centred moments, so nothing is multiplied before it is centred.
    row = z.agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, vector: str | Column = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every remaining row (``vec_id``) on each leading component.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``;
    ``deviation`` is null beyond 38 digits.
    """
    bounded_batches(df.sparkSession)
    vector = F.col(vector) if isinstance(vector, str) else vector
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(vector).alias("x")).filter("size(x) > 0")
    # Copies of one vector meet on the map side first.
    fit = cut(rows.select("x").distinct().withColumn("dims", F.size("x")), "fit")
    done = []
    for dims in sorted(r.dims for r in fit.select("dims").distinct().collect()):
        own = fit.filter(F.col("dims") == dims).select("x")
        model = fit_model(own, dims, components)
        error = identity_error(own, dims, model)
        made = _projected(rows.filter(F.size("x") == dims), dims, model)
        shares = F.array(*[F.lit(float(e)) for e in model.explained])
        z = made.select("vec_id", "deviation", F.posexplode("z").alias("c", "whitened")).select(
            "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
            F.nanvl(F.get(shares, F.col("c")), F.lit(None).cast("double")).alias("explained"),
        )
        done.append(z.withColumn("identity_error", F.lit(error).cast("double")))
    if not done:
        return df.sparkSession.createDataFrame([], f"{WHITENED}, identity_error double")
    return reduce(DataFrame.unionByName, done)
