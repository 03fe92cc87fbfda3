"""Breadth-first traversal and shortest chains, many queries at once.

Each hop is one join of the frontier with the steps and one grouping. The nodes of
a level are numbered in the order in which a queue-based search meets them: by the
number of the node they were met from, then direction and relationship id. A node
keeps the least of these and the node it was met from, so a row has the same size at
any depth. A hub's steps are dealt out over several join keys, so that no task holds
them all. Without ``max_depth`` a search ends when it finds nothing new. Chains tied
for shortest are edges between levels, counted before any is listed (``chains``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions import hashing
from provenir.functions.checks import require_depth, require_direction, require_limit, reverse_direction
from provenir.operators import chains
from provenir.operators.chains import ChainGraph
from provenir.operators.components import number_in_order
from provenir.operators.skew import MAX_BROADCAST_KEYS
from provenir.session import Growing, cut, cut_counted, cut_observed

# Steps of one node that share a join key; a node with more has several keys.
HUB_STEPS = 50_000

# A level of so many nodes is numbered by one window; a larger one over range partitions.
ONE_WINDOW = 200_000

_VIA = "struct<rank:bigint,flag:int,rel_id:string,parent:string>"
_MET = ("key", "node", "hop", "ways", "hit")


@dataclass(frozen=True)
class Paths:
    """``chains``: one row per chain and hop. ``summary``: one row per query."""

    chains: DataFrame
    summary: DataFrame


def steps(relationships: DataFrame, direction: str = "out") -> DataFrame:
    """``from_id, to_id, rel_id, flag`` with flag 0 along the arrow and 1 against it."""
    require_direction(direction)
    forward = relationships.select(
        F.col("source_entity_id").alias("from_id"),
        F.col("target_entity_id").alias("to_id"),
        F.col("id").alias("rel_id"),
        F.lit(0).alias("flag"),
    )
    backward = forward.select(
        F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "rel_id", F.lit(1).alias("flag")
    )
    if direction == "out":
        return forward
    return backward if direction == "in" else forward.unionByName(backward)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class Walk:
    """Written steps, relationship ids as bytes; ``hubs`` tells over how many keys the steps of a hub are dealt."""

    steps: DataFrame
    hubs: DataFrame | None
    both_ways: bool = False

    def expand(self, frontier: DataFrame) -> DataFrame:
        """The frontier joined with the steps that leave its nodes."""
        if self.hubs is None:
            return frontier.join(self.steps, frontier.node == self.steps.from_id)
        dealt = frontier.join(self.hubs, F.col("node") == F.col("hub"), "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        )
        steps = self.steps.withColumnRenamed("part", "_part")
        return dealt.join(steps, (F.col("node") == F.col("from_id")) & (F.col("part") == F.col("_part"))).drop(
            "hub", "parts", "part", "_part"
        )


def _walk(relationships: DataFrame, direction: str) -> Walk:
    every = steps(relationships, direction)
    if not hasattr(relationships, "scratch_folder"):  # a written graph is read again, not written twice
        every = cut(every, "steps")
    # A hop may deal all steps, of which the id is the most.
    every = every.withColumn("rel_id", hashing.packed_id(F.col("rel_id")))
    counts = every.groupBy(F.col("from_id").alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_STEPS)
    hubs, n = cut_counted(counts.select("hub", F.ceil(F.col("n") / HUB_STEPS).cast("int").alias("parts")), "hubs")
    if n == 0:
        return Walk(every, None, direction == "both")
    hubs = F.broadcast(hubs) if n <= MAX_BROADCAST_KEYS else hubs
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rel_id", "to_id"), F.col("parts"))).otherwise(0)
    dealt = every.join(hubs, F.col("from_id") == F.col("hub"), "left").withColumn("part", part.cast("int"))
    return Walk(cut(dealt.drop("hub", "parts"), "steps"), hubs, direction == "both")


def _in_order(level: DataFrame, n: int) -> DataFrame:
    """``rank``: the place of each of the ``n`` rows in the order a queue meets them, the same across partitions."""
    order = ["query_id", "via.rank", "via.flag", "via.rel_id", "node"]
    if n <= ONE_WINDOW:
        return level.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    flat = level.select("*", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    return number_in_order(flat, keys, "rank").drop(*keys)


def _seen(found: Growing, walk: Walk, last: list[DataFrame], by: str) -> DataFrame:
    """Nodes that need not be met again; where steps lead both ways, only the last two levels can be met."""
    return _union([f.select(by, "node") for f in last]) if walk.both_ways else found.read().select(by, "node")


def _search(walk: Walk, origins: DataFrame, max_depth: int | None, ordered: bool = True) -> DataFrame:
    """All nodes met: ``query_id, node, hop`` and, if ``ordered``, ``via``: rank and id of the node before, and the step.

    Hop 0 holds the origins; the search ends when no frontier is left.
    """
    start = origins.select("query_id", F.col("origin").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast(_VIA).alias("via"))
    found = Growing(origins.sparkSession, "found")
    frontier, seen = found.add(start, n=F.count(F.lit(1)))
    last = [frontier]
    hop = 0
    while seen["n"] and (max_depth is None or hop < max_depth):
        hop += 1
        met = walk.expand(_in_order(frontier, seen["n"]) if ordered else frontier.withColumn("rank", F.lit(0).cast("long")))
        rel_id = hashing.unpacked_id(F.col("rel_id")).alias("rel_id")
        step = F.struct("rank", "flag", rel_id, F.col("node").alias("parent")) if ordered else F.lit(None)
        reached = met.select("query_id", F.col("to_id").alias("node"), step.cast(_VIA).alias("via")).groupBy("query_id", "node").agg(F.min("via").alias("via"))
        fresh = reached.join(_seen(found, walk, last, "query_id"), ["query_id", "node"], "left_anti")
        frontier, seen = found.add(fresh.select("query_id", "node", F.lit(hop).alias("hop"), "via"), n=F.count(F.lit(1)))
        last = [last[-1], frontier]
    return found.read()


def _levels(walk: Walk, pairs: DataFrame, max_depth: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """Hop count of every pair (``key, other``) that is connected, and the edges between the levels of each ``key``.

    One search per distinct ``key``, however many pairs it has; it stops once it has
    met all of their other ends. Level ``n`` holds the edges that lead from a node first
    met at hop ``n`` to one first met at hop ``n + 1``: all edges that any shortest chain
    can use. ``ways``: shortest chains between the key and the edge's nearer end.
    """
    found = Growing(pairs.sparkSession, "found")
    ends = pairs.select("key", F.col("other").alias("node"), F.lit(True).alias("_end"))
    met = lambda nodes: nodes.join(ends, ["key", "node"], "left").withColumn("hit", F.col("_end").isNotNull()).drop("_end")
    hits = {"hits": F.count_if("hit")}
    start = pairs.select("key").distinct().select(
        "key", F.col("key").alias("node"), F.lit(0).alias("hop"), F.lit(1).cast(chains.COUNT).alias("ways")
    )
    frontier, seen = found.add(met(start).select(*_MET), **hits)
    levels: list[DataFrame] = []
    last, missing = [frontier], pairs
    while max_depth is None or len(levels) < max_depth:
        if seen["hits"]:
            done = frontier.where("hit").select("key", F.col("node").alias("other"))
            missing = cut(missing.join(done, ["key", "other"], "left_anti"), "missing")
        open_ = frontier.join(missing.select("key").distinct(), "key", "left_semi")
        grown = walk.expand(open_).select("key", F.col("node").alias("prev_id"), F.col("to_id").alias("next_id"), "rel_id", "flag", "hop", "ways")
        known = _seen(found, walk, last, "key").withColumnRenamed("node", "next_id")
        fresh = grown.join(known, ["key", "next_id"], "left_anti").withColumn("rel_id", hashing.unpacked_id(F.col("rel_id")))
        edges, n = cut_counted(fresh, "level")
        if n == 0:
            break
        levels.append(edges)
        reached = edges.groupBy("key", F.col("next_id").alias("node")).agg(chains.capped(F.try_sum("ways")).alias("ways"))
        frontier, seen = found.add(met(reached).withColumn("hop", F.lit(len(levels))).select(*_MET), **hits)
        last = [last[-1], frontier]
    length = found.read().where("hit").select("key", F.col("node").alias("other"), F.col("hop").alias("hop_count"), "ways")
    length, reach = cut_observed(length, "length", longest=F.max("hop_count"))
    # Levels beyond the last end belong to searches that found nothing.
    return length, levels[: reach["longest"] or 0]


def _attach_steps(hops: DataFrame, relationships: DataFrame) -> DataFrame:
    """Resolve ``flag, rel_id`` to the walked endpoints; the stored edge is never flipped."""
    edges = relationships.select(
        F.col("id").alias("rel_id"), "relationship_type", "source_entity_id", "target_entity_id", "derived_from"
    )
    forward = F.col("flag") == 0
    return hops.join(edges, "rel_id").select(
        *[c for c in hops.columns if c != "flag"],
        "relationship_type",
        F.when(forward, F.col("source_entity_id")).otherwise(F.col("target_entity_id")).alias("from_id"),
        F.when(forward, F.col("target_entity_id")).otherwise(F.col("source_entity_id")).alias("to_id"),
        F.when(forward, "forward").otherwise("backward").alias("walked_direction"),
        "derived_from",
    )


def neighbors(
    relationships: DataFrame,
    origins: DataFrame,
    *,
    max_depth: int | None,
    direction: str = "out",
) -> DataFrame:
    """Entities within ``max_depth`` hops (None: any number) of each ``(query_id, origin)``.

    One row per query and entity with its hop count and the step that found it;
    the origin itself is left out.
    """
    require_depth(max_depth)
    walk = _walk(relationships, direction)
    found = _search(walk, origins, max_depth).where("hop > 0")
    via = found.select("query_id", F.col("node").alias("entity_id"), F.col("hop").alias("hop_count"), "via.flag", "via.rel_id")
    return _attach_steps(via, relationships).orderBy("query_id", "hop_count", "entity_id")


def distances(
    relationships: DataFrame, origins: DataFrame, *, max_depth: int | None, direction: str = "out"
) -> DataFrame:
    """Hop count per query and entity, the origin included with 0."""
    require_depth(max_depth)
    walk = _walk(relationships, direction)
    return _search(walk, origins, max_depth, ordered=False).select(
        "query_id", F.col("node").alias("entity_id"), F.col("hop").alias("hop_count")
    )


def chain_graph(
    relationships: DataFrame,
    queries: DataFrame,
    *,
    max_depth: int | None = None,
    direction: str = "out",
) -> ChainGraph:
    """All edges of all chains tied for shortest, with the number of chains, none of them listed.

    Queries that share an end share its search: from the targets, against the steps, where
    there are fewer of them than of sources, else from the sources. Either way only edges
    that lie on a chain of a query are kept for it, with the number of ways on to its target.
    """
    require_depth(max_depth)
    queries = cut(queries.select("query_id", "source", "target"), "queries")
    n = queries.agg(F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets")).first()
    near, far = ("target", "source") if n.targets < n.sources else ("source", "target")
    pairs = cut(queries.select(F.col(near).alias("key"), F.col(far).alias("other")).dropna().distinct(), "pairs")
    walk = _walk(relationships, direction if near == "source" else reverse_direction(direction))
    length, levels = _levels(walk, pairs, max_depth)
    ends = cut(
        queries.withColumns({"key": F.col(near), "other": F.col(far)}).join(length, ["key", "other"]).select(
            "query_id", "key", "other", "hop_count", "ways"
        ),
        "ends",
    )
    return chains.from_sources(queries, ends, levels) if near == "source" else chains.from_targets(queries, ends, levels)


def shortest_path(
    relationships: DataFrame,
    queries: DataFrame,
    *,
    max_depth: int | None = None,
    direction: str = "out",
) -> Paths:
    """One shortest chain per ``(query_id, source, target)``: the one that a queue-based search meets first.

    Equal ends are found with no hops. A pair that is not connected within
    ``max_depth`` has ``found`` false and no steps.
    """
    graph = chain_graph(relationships, queries, max_depth=max_depth, direction=direction)
    hops = chains.least_chains(graph).withColumn("chain_index", F.lit(0))
    summary = chains.totals(graph).drop("n_chains")
    return Paths(_attach_steps(hops, relationships).orderBy("query_id", "position"), summary.orderBy("query_id"))


def list_chains(graph: ChainGraph, relationships: DataFrame, *, limit: int | None = None, first: int = 0) -> Paths:
    """Chains number ``first`` and after of each query, ``limit`` of them at most, in the order of their entities.

    ``truncated`` tells that there are more after them. The work follows the chains that
    are listed, not those that there are.
    """
    require_limit(limit)
    last = None if limit is None else first + limit
    steps_ = _attach_steps(chains.prefixes(graph, first, last), relationships)
    rows = chains.spread(steps_, first, last).orderBy("query_id", "chain_index", "position")
    n = F.col("n_chains")
    shown = F.greatest(n - first, F.lit(0)) if limit is None else F.least(F.greatest(n - first, F.lit(0)), F.lit(limit))
    counted = chains.totals(graph)
    summary = counted.select(
        "query_id", "source", "target", "found", "hop_count", shown.cast("long").alias("n_chains"),
        (F.lit(False) if last is None else n > last).alias("truncated"),
    )
    return Paths(rows, summary.orderBy("query_id"))


def all_shortest_paths(
    relationships: DataFrame,
    queries: DataFrame,
    *,
    max_depth: int | None = None,
    direction: str = "out",
    limit: int | None = None,
    first: int = 0,
) -> Paths:
    """Every chain tied for shortest, ordered; with ``limit`` so many per query, from number ``first`` on."""
    require_limit(limit)
    graph = chain_graph(relationships, queries, max_depth=max_depth, direction=direction)
    return list_chains(graph, relationships, limit=limit, first=first)
