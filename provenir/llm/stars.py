"""Connected components by alternating large-star and small-star rounds.

Large-star links every larger neighbour of a node to the smallest of the node and
its neighbours; small-star does so with the node and its smaller neighbours. Both
keep the components; in the end every node hangs on its smallest.
A node's smallest neighbour comes from an aggregate that is combined before the
shuffle, and goes back to its edges by a join whose heavy keys Spark can split.

Before a round, tasks contract the edges they hold, ``CHUNK`` at a time and without a
shuffle: a chunk's edges become stars around the smallest node of each of its
components. Contraction is repeated as long as it halves the edges; what is left in
one chunk is settled by it. So small graphs need no round, and large ones few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.session import cut, cut_counted, cut_observed, release

#: Edges that one task holds at a time (two 64-bit numbers each).
CHUNK = 1 << 18


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.max("b").alias("most"))


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of each component of these edges, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        # Roots hang on smaller ones only, so a tree's root is its smallest node.
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(deeper := root[root], root):
            root = deeper
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame, chunk: int | None = None) -> DataFrame:
    """Edges (a, b) as stars, a larger than b: each task by itself, ``chunk`` edges at a time."""
    most = chunk or CHUNK

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in settled(a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                if n + part.num_rows > most:
                    # Stars of a chunk take part in the next one while they fill less than half of it.
                    held = [stars(held)]
                    n = held[0].num_rows
                    if 2 * n > most or n + part.num_rows > most:
                        yield held[0]
                        held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield stars(held)

    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int | None = None) -> DataFrame:
    """node, component: every node of an edge and the smallest node it can reach (written)."""
    most = chunk or CHUNK
    now, n = cut_counted(contracted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), most), "stars")
    while n:
        tasks, before = -(-n // most), n
        fewer, n = cut_counted(contracted(now.coalesce(tasks), most), "stars")
        release(now)
        now = fewer
        # One chunk had all edges: they are stars now.
        if tasks == 1:
            break
        if 2 * n <= before:
            continue
        now = cut(now.distinct(), "stars")
        release(fewer)
        turned = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        # All is settled when each node is the least of its neighbours or has but one, a smaller one.
        least, seen = cut_observed(_least(now.unionByName(turned)), "stars-least", open=F.count_if(F.expr("least < a AND least < most")))
        if not seen["open"]:
            release(least)
            break
        # Large-star: larger neighbours go to the smallest. An edge gives one row at most.
        larger = turned.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = cut(larger, "stars-large")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        small = cut(_least(large), "stars-least")
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        own = small.select("a", F.col("least").alias("b"))
        new, n = cut_counted(moved.unionByName(own).filter("a <> b").distinct(), "stars")
        release(now, least, large, small)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
