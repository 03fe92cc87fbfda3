"""Chains tied for shortest, counted and paged without listing them.

The edges of all chains of all queries lie in levels, each with the number of ways
that lead on from it to the target. The chains of a query are numbered
in the order of their steps, so the chains that begin with some steps are a run of
numbers, and the run of an edge starts where those of the edges before it end. A page
of numbers is found by following only the runs that touch it.

Forwards, a node gets the number of ways that lead to it, up to two. An edge with one
way to it and one way on lies on a single chain, which is named by its first such edge;
every other edge lies on several. So what two chains share follows from the edges.

Counts are whole numbers of up to 38 digits and stop there: ``MOST`` means so many or
more. Pages among the first 10**38 - 1 chains are exact all the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.operators.components import running_totals
from provenir.session import cut, cut_counted

COUNT = "decimal(38,0)"
MOST = "9" * 38
# Edges of one level that a plain window takes, whatever their nodes; beyond, sums go over range partitions.
WINDOW_EDGES = 1_000_000
# Chain numbers that one row is turned into at a time.
BLOCK = 4096


@dataclass(frozen=True)
class ChainGraph:
    """``levels``: per hop ``query_id, prev_id, next_id, rel_id, flag, ways``; ``counts``: chains per connected query."""

    queries: DataFrame
    lengths: DataFrame
    levels: list[DataFrame]
    sizes: list[int]
    counts: DataFrame


def capped(total: Column) -> Column:
    return F.coalesce(total, F.lit(MOST).cast(COUNT))


def from_sources(queries: DataFrame, ends: DataFrame, levels: list[DataFrame]) -> ChainGraph:
    """The graph from searches that began at the sources.

    ``ends``: ``query_id, key, other, hop_count`` of connected queries, other the target.
    From there back, level by level, only edges that lead on to it stay, and are counted.
    """
    one = F.lit(1).cast(COUNT).alias("ways")
    arrived = ends.select("query_id", "key", F.col("other").alias("next_id"), "hop_count", one)
    ahead = arrived.where("hop_count < 0").drop("hop_count")
    kept: list[DataFrame] = []
    sizes: list[int] = []
    for hop in range(len(levels), 0, -1):
        arriving = arrived.where(F.col("hop_count") == hop).drop("hop_count").unionByName(ahead)
        edges, n = cut_counted(levels[hop - 1].drop("ways", "hop").join(arriving, ["key", "next_id"]), "on_chain")
        kept.insert(0, edges)
        sizes.insert(0, n)
        ahead = edges.groupBy("query_id", "key", F.col("prev_id").alias("next_id")).agg(capped(F.try_sum("ways")).alias("ways"))
    # What is ahead of the first level is ahead of the sources; ends that meet are one empty chain.
    counts = ahead.select("query_id", F.col("ways").alias("n_chains")).unionByName(
        ends.where("hop_count = 0").select("query_id", one.alias("n_chains"))
    )
    return ChainGraph(queries, ends.select("query_id", "hop_count"), kept, sizes, cut(counts, "counts"))


def from_targets(queries: DataFrame, ends: DataFrame, levels: list[DataFrame]) -> ChainGraph:
    """The graph from searches that began at the targets, against the steps.

    Their edges count the ways on to the target already, and every one of them leads there,
    so the edges of a query are those met on the way from its source, other in ``ends``.
    """
    counts = ends.select("query_id", F.col("ways").alias("n_chains"))
    graph = ChainGraph(queries, ends.select("query_id", "hop_count"), [], [], counts)
    if not levels:
        return graph
    every = ends.sparkSession.read.schema(levels[0].schema).parquet(*[f.scratch_folder for f in levels]).select(
        "key", F.col("next_id").alias("prev_id"), F.col("prev_id").alias("next_id"), "rel_id", (1 - F.col("flag")).alias("flag"), F.col("hop").alias("left"), "ways"
    )
    at = ends.select("query_id", "key", F.col("other").alias("prev_id"), (F.col("hop_count") - 1).alias("left"))
    for _ in levels:
        edges, n = cut_counted(at.join(every, ["key", "prev_id", "left"]), "on_chain")
        graph.levels.append(edges.drop("left"))
        graph.sizes.append(n)
        at = edges.select("query_id", "key", F.col("next_id").alias("prev_id"), (F.col("left") - 1).alias("left")).distinct()
    return graph


def least_chains(graph: ChainGraph) -> DataFrame:
    """Per connected query the steps of its least chain by direction and relationship id: ``query_id, position, flag, rel_id``.

    Every edge leads on to the target, so the least step from where a chain stands is right.
    """
    at = graph.queries.join(graph.lengths, "query_id").select("query_id", F.col("source").alias("prev_id"))
    out = []
    for position, edges in enumerate(graph.levels):
        least = at.join(edges, ["query_id", "prev_id"]).groupBy("query_id").agg(F.min(F.struct("flag", "rel_id", "next_id")).alias("s"))
        level = cut(least.select("query_id", F.lit(position).alias("position"), "s.flag", "s.rel_id", "s.next_id"), "least")
        out.append(level.drop("next_id"))
        at = level.select("query_id", F.col("next_id").alias("prev_id"))
    if not out:
        return graph.counts.limit(0).select("query_id", F.lit(0).alias("position"), F.lit(0).alias("flag"), F.lit("").alias("rel_id"))
    return reduce(DataFrame.unionByName, out)


def totals(graph: ChainGraph) -> DataFrame:
    """One row per query: ``query_id, source, target, found, hop_count, n_chains``, the number of all its chains."""
    return graph.queries.join(graph.lengths, "query_id", "left").join(graph.counts, "query_id", "left").select(
        "query_id", "source", "target",
        F.col("hop_count").isNotNull().alias("found"),
        "hop_count",
        F.coalesce("n_chains", F.lit(0).cast(COUNT)).alias("n_chains"),
    )


def _with_before(edges: DataFrame, n: int, last: int | None) -> DataFrame:
    """``before``: ways over the edges of the same node that come first."""
    none = F.lit(0).cast(COUNT)
    inside = Window.partitionBy("query_id", "prev_id").orderBy("next_id", "rel_id", "flag")
    if last is not None:
        # Every edge has a way at least, so no page needs more edges of a node than it ends at.
        edges = edges.withColumn("_nth", F.row_number().over(inside)).where(F.col("_nth") <= last).drop("_nth")
    elif n > WINDOW_EDGES:
        named = edges.withColumns({"_by": F.struct("query_id", "prev_id"), "_order": F.struct("next_id", "rel_id", "flag")})
        return running_totals(named, "_by", "_order", "ways", "before").withColumn("before", F.col("before").cast(COUNT)).drop("_by", "_order")
    ahead = F.try_sum("ways").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(inside) == 1
    return edges.withColumn("before", F.when(first, none).otherwise(capped(ahead)))


def prefixes(graph: ChainGraph, first: int = 0, last: int | None = None) -> DataFrame:
    """Beginnings of the chains numbered from ``first`` to before ``last``: a row per beginning, for its last step.

    ``query_id, position, rel_id, flag, start, ways``: the chains that begin so are ``ways``
    in number from ``start`` on. A page has no more rows per position than chains.
    """
    at = graph.queries.join(graph.lengths, "query_id").select(
        "query_id", F.col("source").alias("prev_id"), F.lit(0).cast(COUNT).alias("start")
    )
    out = []
    for position, (edges, n) in enumerate(zip(graph.levels, graph.sizes, strict=True)):
        grown = at.join(_with_before(edges, n, last), ["query_id", "prev_id"]).withColumn("start", F.try_add("start", "before"))
        end = F.try_add("start", "ways")
        grown = grown.where(F.col("start").isNotNull() & F.coalesce(end > F.lit(first), F.lit(True)))
        if last is not None:
            grown = grown.where(F.col("start") < F.lit(last))
        level = cut(grown.select("query_id", "next_id", "rel_id", "flag", "start", "ways"), "prefixes")
        out.append(level.select("query_id", F.lit(position).alias("position"), "rel_id", "flag", "start", "ways"))
        at = level.select("query_id", F.col("next_id").alias("prev_id"), "start")
    if not out:
        nothing = graph.counts.limit(0).select("query_id", F.col("n_chains").alias("start"), F.col("n_chains").alias("ways"))
        return nothing.withColumns({"position": F.lit(0), "rel_id": F.lit(""), "flag": F.lit(0)})
    return reduce(DataFrame.unionByName, out)


def spread(beginnings: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """A row per chain in place of a row per beginning, with ``chain_index``."""
    low = F.greatest(F.col("start"), F.lit(first).cast(COUNT))
    end = capped(F.try_add("start", "ways"))
    high = end if last is None else F.least(end, F.lit(last).cast(COUNT))
    runs = beginnings.withColumns({"_low": low.cast("long"), "_size": (high - low).cast("long")}).drop("start", "ways")
    short = runs.where(F.col("_size") <= BLOCK).withColumn("_block", F.lit(0).cast("long"))
    # A beginning that very many chains share is dealt out in blocks.
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / BLOCK).cast("long"))
    long = runs.where(F.col("_size") > BLOCK).withColumn("_block", F.explode(blocks)).repartition("query_id", "position", "_block")
    inside = F.least(F.col("_size") - F.col("_block") * BLOCK, F.lit(BLOCK).cast("long"))
    numbers = F.sequence(F.lit(0).cast("long"), inside - 1)
    every = short.unionByName(long).withColumn("_n", F.explode(numbers))
    return every.withColumn("chain_index", F.col("_low") + F.col("_block") * BLOCK + F.col("_n")).drop("_low", "_size", "_block", "_n")


def marked_edges(graph: ChainGraph) -> DataFrame:
    """``query_id, prev_id, next_id, rel_id, flag, chain``: the name of the one chain an edge lies on, null if on several."""
    heads = graph.queries.join(graph.lengths, "query_id").select(
        "query_id", F.col("source").alias("prev_id"), F.lit(1).alias("heads"), F.lit(None).cast("struct<hop:int,rel_id:string,flag:int>").alias("before")
    )
    out = []
    for hop, edges in enumerate(graph.levels):
        alone = (F.col("heads") == 1) & (F.col("ways") == 1)
        own = F.struct(F.lit(hop).alias("hop"), "rel_id", "flag")
        level = cut(
            edges.join(heads, ["query_id", "prev_id"]).select(
                "query_id", "prev_id", "next_id", "rel_id", "flag", "heads", F.when(alone, F.coalesce("before", own)).alias("chain")
            ),
            "marked",
        )
        out.append(level.drop("heads"))
        met = F.least(F.sum("heads"), F.lit(2)).cast("int")
        heads = level.groupBy("query_id", F.col("next_id").alias("prev_id")).agg(
            met.alias("heads"), F.when(F.sum("heads") == 1, F.max("chain")).alias("before")
        )
    if not out:
        nothing = graph.queries.limit(0).select("query_id", *[F.lit("").alias(c) for c in ("prev_id", "next_id", "rel_id")], F.lit(0).alias("flag"))
        return nothing.withColumn("chain", F.lit(None).cast("struct<hop:int,rel_id:string,flag:int>"))
    return reduce(DataFrame.unionByName, out)


def shared_by_chains(members: DataFrame, member: str) -> DataFrame:
    """``query_id, member`` that lie on two chains of a query or more; ``members`` has ``chain`` as ``marked_edges`` gives it."""
    several = F.bool_or(F.col("chain").isNull()) | (F.min("chain") != F.max("chain"))
    return members.groupBy("query_id", member).agg(several.alias("_several")).where(F.coalesce("_several", F.lit(True))).select("query_id", member)


def inner_members(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, member, chain``: relationships and non-endpoint entities."""
    ends = queries.select("query_id", F.col("target").alias("next_id"))
    inner = edges.join(ends, ["query_id", "next_id"], "left_anti").select("query_id", F.concat(F.lit("entity:"), "next_id").alias("member"), "chain")
    return inner.unionByName(edges.select("query_id", F.concat(F.lit("relationship:"), "rel_id").alias("member"), "chain"))


def cited(edges: DataFrame, relationships: DataFrame) -> DataFrame:
    """``query_id, ref_id, chain``: what the relationships on the chains derive from."""
    refs = relationships.select(F.col("id").alias("rel_id"), F.explode("derived_from").alias("ref_id"))
    return edges.select("query_id", "rel_id", "chain").join(refs, "rel_id").select("query_id", "ref_id", "chain").distinct()
