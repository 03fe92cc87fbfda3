"""Exact top-k by inner product over one KD-tree per shard of vectors.

A shard is a bounded run of vectors; its tree splits at the median of the widest
dimension down to leaves, and every leaf keeps the tight bounding box and the
smallest id of its vectors. The largest inner product that a query can have in a
box is the sum of the better corner in each dimension, so leaves are visited best
bound first and left out once the bound is below the kth score found so far; a
leaf whose bound equals it is visited only if it holds a smaller id. The kth score
is handed on: a first round over one shard of its length gives every query a floor
that all other shards start from.

Queries go in blocks against all shards, one task for a block and a run of
shards; only the best k of each run are shuffled. Scores are whole numbers and exact at
any size: a block and a run of shards are worked on as doubles while no sum can pass
2**53, as 64-bit integers up to 2**62, and as Python integers beyond.

Results: a component beyond 64 bits counts as the nearest 64-bit number; scores are
ranked exactly up to 38 digits, and one beyond 64 bits is given as the nearest; a vector that is null, or has a null or non-finite component, takes no
part; vectors are compared with those of their own length; an empty vector scores
0; equal scores go by smaller id; null ids take no part; rows that repeat an id
are candidates of their own except for the query with that id, and of rows that
share a query's id the smallest vector asks; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.session import cut

SHARD_ROWS = 4096
QUERY_ROWS = 512
LEAF_ROWS = 128
#: Runs of shards that a block of queries meets: at least so many, of about so many shards.
RUNS, RUN_SHARDS = 8, 8
#: ``down`` is the score with its sign turned, so that the best come first.
FOUND = "block long, query_id long, vec_id long, down decimal(38,0)"
MOST = 10**38 - 1


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """Each component x as floor(scale * x); null if any has no finite value."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Tree:
    """Leaves of a KD-tree by median splits, with boxes and smallest ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, edges, todo = np.arange(len(ids)), [], [(0, len(ids))]
        while todo:
            a, z = todo.pop()
            part = points[order[a:z]]
            spread = part.max(axis=0) - part.min(axis=0) if z > a and points.shape[1] else np.zeros(1)
            if z - a <= leaf_rows or not spread.max():
                edges.append((a, z))
                continue
            middle = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, spread.argmax()].astype(np.float64), middle, kind="introselect")]
            todo += [(a, a + middle), (a + middle, z)]
        for a, z in edges:
            order[a:z] = order[a:z][np.argsort(ids[order[a:z]], kind="stable")]
        self.ids, self.points, self.edges = ids[order], points[order], sorted(edges)
        self.low = np.array([self.points[a:z].min(axis=0) for a, z in self.edges])
        self.high = np.array([self.points[a:z].max(axis=0) for a, z in self.edges])
        self.least_id = np.array([self.ids[a] for a, _ in self.edges])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and leaf, the largest score a vector in the leaf's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def exact_type(queries: np.ndarray, points: list[np.ndarray]) -> np.dtype:
    """The fastest type in which no inner product of whole numbers loses a digit."""
    far = lambda a: max(int(a.max()), -int(a.min())) if a.size else 0
    most = far(queries) * max(map(far, points), default=0) * max(1, queries.shape[1])
    return np.dtype(np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object)


#: Below every score of a type.
LOWEST = {"f": -np.inf, "i": np.iinfo(np.int64).min, "O": -(10**60)}


class Best:
    """The k best (score, id) of each query of a block, and the floors that leaves are held against."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None, kind: np.dtype | type = np.float64):
        self.query_ids, self.k, kind = query_ids, k, np.dtype(kind)
        self.floor = np.full(len(query_ids), LOWEST[kind.kind], dtype=kind) if floor is None else floor.copy()
        self.last_id = np.full(len(query_ids), np.iinfo(np.int64).max)
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q, side="left")
        kept = np.arange(len(q)) - first < self.k
        self.q, self.score, self.id = q[kept], score[kept], ids[kept]
        ends = np.searchsorted(self.q, np.arange(len(self.floor)), side="right") - 1
        full = np.bincount(self.q, minlength=len(self.floor)) == self.k
        better = full & (self.score[ends] >= self.floor) if len(self.q) else full
        self.floor[better] = self.score[ends[better]]
        self.last_id[better] = self.id[ends[better]]

    def visit(self, tree: Tree, queries: np.ndarray) -> None:
        """Look into the leaves that may hold better vectors, each query's best leaf first."""
        bounds = tree.bounds(queries)
        best = bounds.argmax(axis=1)
        for leaf in np.unique(best):
            self._look(tree, queries, leaf, bounds[:, leaf], best == leaf)
        for leaf in np.argsort(-bounds.max(axis=0), kind="stable"):
            self._look(tree, queries, leaf, bounds[:, leaf], best != leaf)

    def _look(self, tree: Tree, queries: np.ndarray, leaf: int, bound: np.ndarray, among: np.ndarray) -> None:
        open_ = among & ((bound > self.floor) | ((bound == self.floor) & (tree.least_id[leaf] <= self.last_id)))
        at = np.flatnonzero(open_)
        if not len(at):
            return
        a, z = tree.edges[leaf]
        scores = queries[at] @ tree.points[a:z].T
        if scores.dtype == object:
            scores = np.clip(scores, -MOST, MOST)
        ids = tree.ids[a:z]
        good = (scores >= self.floor[at, None]) & (ids[None, :] != self.query_ids[at, None])
        good &= (scores > self.floor[at, None]) | (ids[None, :] <= self.last_id[at, None])
        row, col = np.nonzero(good)
        if len(row):
            self.add(at[row], scores[row, col], ids[col])


def _packed(rows: DataFrame, per: int, name: str) -> DataFrame:
    """Rows of (vec_id, point) packed into written runs of about ``per`` vectors of one length: (name, dims, ids, points)."""
    schema = pa.schema([(name, pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("points", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            ids, points = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, p in zip(ids, points, strict=True):
                a = held.setdefault(len(p), ([], []))
                a[0].append(i)
                a[1].append(p)
                if len(a[0]) == per:
                    yield from packed(task, seq, len(p), held.pop(len(p)))
                    seq += 1
        for dims, a in held.items():
            yield from packed(task, seq, dims, a)
            seq += 1

    def packed(task, seq, dims, a):
        yield pa.RecordBatch.from_pylist([{
            name: (task << 32) + seq, "dims": dims, "ids": np.array(a[0], dtype=np.int64).tobytes(),
            "points": np.array(a[1], dtype=np.int64).reshape(len(a[0]), dims).tobytes()}], schema=schema)

    return cut(rows.mapInArrow(run, f"{name} long, dims long, ids binary, points binary"), f"topk-{name}")


def _unpacked(ids: bytes, points: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, dtype=np.int64)
    return found, np.frombuffer(points, dtype=np.int64).reshape(len(found), dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: float = 256.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query row over all other rows."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("asked"), whole_numbers(F.col(embedding), scale).alias("point"),
    ).filter("vec_id IS NOT NULL AND point IS NOT NULL")
    asked = rows.filter("asked").groupBy("vec_id").agg(F.min("point").alias("point"))
    shards = _packed(rows.select("vec_id", "point"), shard_rows, "shard")
    blocks = _packed(asked, query_rows, "block")
    # Every block meets every run of shards of its length: the stated queries against all rows, in blocks.
    n_runs = max(RUNS, -(-shards.count() // RUN_SHARDS))
    runs = shards.select("shard", "dims", F.pmod(F.xxhash64("shard"), F.lit(n_runs)).alias("run"),
                         F.col("ids").alias("row_ids"), F.col("points").alias("row_points"))
    home = runs.groupBy("dims").agg(F.min("shard").alias("shard")).join(runs, ["dims", "shard"])
    first = blocks.join(home, "dims").groupBy("block").applyInPandas(_search(k), FOUND)
    floors = first.groupBy("block", "query_id").agg(F.when(F.count("*") == k, F.max("down")).alias("floor")).groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "floor"))).alias("floors"))
    ready = cut(blocks.join(floors, "block", "left"), "topk-ready")
    pairs = ready.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long")))).join(runs, ["dims", "run"])
    found = pairs.groupBy("block", "run").applyInPandas(_search(k), FOUND)
    merged = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("down", "vec_id"))).alias("all"))
    low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (1 - (1 << 63), 1 << 63))
    down = F.least(F.greatest(F.col("col.down"), low), high)
    return merged.select("query_id", F.posexplode(F.slice("all", 1, k))).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-down).cast("long").alias("score"))


def _search(k: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        dims, block = int(frame["dims"].iloc[0]), int(frame["block"].iloc[0])
        qids, queries = _unpacked(frame["ids"].iloc[0], frame["points"].iloc[0], dims)
        floors = dict(frame["floors"].iloc[0] or {}) if "floors" in frame else {}
        shards = [_unpacked(i, p, dims) for i, p in zip(frame["row_ids"], frame["row_points"], strict=True)]
        kind = exact_type(queries, [p for _, p in shards])
        lowest = LOWEST[kind.kind]
        # A floor is a score of another shard; where it has more digits than a type of this run, no score here reaches it.
        reach = {"f": 1 << 53, "i": 1 << 62, "O": 10**60}[kind.kind]
        known = [None if (f := floors.get(q)) is None else max(-reach, min(reach, -int(f))) for q in qids.tolist()]
        floor = np.array([lowest if f is None else f for f in known], dtype=kind)
        queries = queries.astype(kind)
        best = Best(qids, k, floor, kind)
        trees = [Tree(ids, points.astype(kind)) for ids, points in shards]
        for tree in sorted(trees, key=lambda t: -max(t.bounds(queries).max(axis=None), lowest) if len(queries) else 0):
            best.visit(tree, queries)
        down = [Decimal(max(-MOST, min(MOST, -int(s)))) for s in best.score.tolist()]
        return pd.DataFrame({"block": block, "query_id": qids[best.q], "vec_id": best.id, "down": pd.Series(down, dtype=object)})

    return search
