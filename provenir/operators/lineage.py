"""Root evidence behind references, and overlap of chains in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators import chains as counting
from provenir.operators.lookups import kinds_of
from provenir.session import Growing, cut, cut_counted, cut_observed, release


# Levels below the wanted references that are looked up by id before all events are taken.
NEAR_LEVELS = 6


def _reachable(events: DataFrame, refs: DataFrame) -> DataFrame | None:
    """Ids that ``refs`` lead to, each once; None if they go deeper than ``NEAR_LEVELS``."""
    found = Growing(events.sparkSession, "reach")
    fresh, seen = found.add(refs.select(F.col("ref_id").alias("id")).distinct(), n=F.count(F.lit(1)))
    for _ in range(NEAR_LEVELS):
        if not seen["n"]:
            break
        below = events.join(fresh, "id", "left_semi").select(F.explode("derived_from").alias("id")).distinct()
        fresh, seen = found.add(below.join(found.read(), "id", "left_anti"), n=F.count(F.lit(1)))
    return None if seen["n"] else found.read()


def _links(events: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known evidence ids, and the links of events to what they derive from: ``at, next, rooted``.

    Evidence is tried before an event of the same id, so no link leaves it. Links to
    unknown ids and to the event itself lead nowhere and are left out.
    """
    known = cut(evidence.select("id").distinct(), "known")
    here = events.join(known, "id", "left_anti").select(F.col("id").alias("at"), F.explode("derived_from").alias("next"))
    ids = known.withColumn("rooted", F.lit(True)).unionByName(events.select("id").distinct().withColumn("rooted", F.lit(False)))
    kinds = ids.groupBy(F.col("id").alias("next")).agg(F.bool_or("rooted").alias("rooted"))
    return known, here.where("at != next").distinct().join(kinds, "next").select("at", "next", "rooted")


def _shortened(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with one link stand for what it leads to: ``at, rep, rooted`` for them, and the links of the others.

    Pointers are doubled, so a line of any length takes logarithmic rounds. An event
    that leads into a ring of such events and nowhere else has no roots and is left out.
    """
    one = links.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("next").alias("next"), F.bool_or("rooted").alias("rooted"))
    first, thin = cut_counted(one.where("n = 1").select("at", F.col("next").alias("rep"), "rooted"), "pointers")
    forks, pointers, written, reach = links.join(first.select("at"), "at", "left_anti"), first, None, 1
    while thin and reach <= 2 * thin:
        onward = pointers.select(F.col("at").alias("rep"), F.col("rep").alias("_rep"), F.col("rooted").alias("_rooted"))
        moved = pointers.join(onward, "rep", "left")
        jumped, seen = cut_observed(
            moved.select("at", F.coalesce("_rep", "rep").alias("rep"), F.coalesce("_rooted", "rooted").alias("rooted"), F.col("_rep").isNotNull().alias("open")),
            "pointers", open=F.count_if("open"),
        )
        if written is not None:
            release(written)
        written, pointers, reach = jumped, jumped.select("at", "rep", "rooted"), 2 * reach
        if not seen["open"]:
            break
    ended = pointers.join(pointers.select(F.col("at").alias("rep")), "rep", "left_anti").select("at", "rep", "rooted")
    led = forks.join(ended.select(F.col("at").alias("next"), "rep", F.col("rooted").alias("_rooted")), "next", "left").select(
        "at", F.coalesce("rep", "next").alias("next"), F.coalesce("_rooted", "rooted").alias("rooted")
    )
    return ended, cut(led.where("at != next").distinct(), "forks")


def root_map(events: DataFrame, evidence: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``ref_id, root_id``: the evidence each reference finally rests on.

    Evidence is its own root and is tried before an event of the same id; dangling ids
    add nothing. Lines of events with one link each are shortened first. Then roots are
    handed up from the evidence, level by level, and a pair that is known is not handed
    up again: every pair is written once, however many ways lead to it, and rings of
    events end. With ``refs`` only those are returned, and where what they lead to lies
    near, only that is looked at.
    """
    near = None if refs is None else _reachable(events, refs)
    if near is not None:
        events, evidence = events.join(near, "id", "left_semi"), evidence.join(near, "id", "left_semi")
    known, links = _links(events, evidence)
    lines, forks = _shortened(cut(links, "links"))
    up = cut(forks.where("NOT rooted").select("at", F.col("next").alias("from_at")), "up")
    found = Growing(events.sparkSession, "roots")
    fresh, seen = found.add(forks.where("rooted").select("at", F.col("next").alias("root_id")), n=F.count(F.lit(1)))
    while seen["n"]:
        handed = up.join(fresh.withColumnRenamed("at", "from_at"), "from_at").select("at", "root_id").distinct()
        fresh, seen = found.add(handed.join(found.read(), ["at", "root_id"], "left_anti"), n=F.count(F.lit(1)))
    pairs = found.read()
    through = lines.where("NOT rooted").join(pairs.withColumnRenamed("at", "rep"), "rep").select("at", "root_id")
    own = known.select(F.col("id").alias("at"), F.col("id").alias("root_id"))
    every = own.unionByName(lines.where("rooted").select("at", F.col("rep").alias("root_id"))).unionByName(pairs).unionByName(through)
    out = every.withColumnRenamed("at", "ref_id")
    return out if refs is None else out.join(refs.select("ref_id").distinct(), "ref_id", "left_semi")


def chain_roots(chains: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, chain_index, root_id``, distinct, for chains with ``derived_from``."""
    cited = chains.select("query_id", "chain_index", F.explode("derived_from").alias("ref_id")).distinct()
    cited = cut(cited, "cited")
    roots = root_map(events, evidence, cited.select("ref_id"))
    return cited.join(roots, "ref_id").select("query_id", "chain_index", "root_id").distinct()


def shared_members(members: DataFrame, member: str) -> DataFrame:
    """``query_id, member`` that occur in two or more chains of a query."""
    return (
        members.groupBy("query_id", member)
        .agg(F.min("chain_index").alias("lo"), F.max("chain_index").alias("hi"))
        .where("lo != hi")
        .select("query_id", member)
    )


def evidence_overlap(summary: DataFrame, roots: DataFrame) -> DataFrame:
    """Per query: number of chains, shared roots, and the verdict.

    The verdict is null below two chains, false when any root is shared by two
    chains, else true.
    """
    return overlap_verdicts(summary, shared_members(roots, "root_id"))


def counted_overlap(
    graph: counting.ChainGraph, edges: DataFrame, relationships: DataFrame, events: DataFrame, evidence: DataFrame
) -> DataFrame:
    """The same for all chains of a graph, from its ``marked_edges``; no chain is listed."""
    refs = cut(counting.cited(edges, relationships), "cited")
    roots = root_map(events, evidence, refs.select("ref_id"))
    rooted = refs.join(roots, "ref_id").select("query_id", "root_id", "chain")
    return overlap_verdicts(counting.totals(graph), counting.shared_by_chains(rooted, "root_id"))


def overlap_verdicts(summary: DataFrame, shared: DataFrame) -> DataFrame:
    """``summary`` with the shared roots of each query in one row, and the verdict."""
    shared = shared.groupBy("query_id").agg(F.sort_array(F.collect_list("root_id")).alias("shared_evidence_ids"))
    none = F.array().cast("array<string>")
    return (
        summary.join(shared, "query_id", "left")
        .withColumn("shared_evidence_ids", F.coalesce("shared_evidence_ids", none))
        .withColumn(
            "fully_evidence_independent",
            F.when(F.col("n_chains") >= 2, F.size("shared_evidence_ids") == 0),
        )
    )


def explain_chains(chains: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Every reference of every step, in recorded order, with its kind."""
    refs = chains.select(
        "query_id", "chain_index", "position", "rel_id", F.posexplode("derived_from").alias("ref_position", "ref_id")
    )
    return kinds_of(refs, evidence, events).orderBy("query_id", "chain_index", "position", "ref_position")


def chain_entities(chains: DataFrame, queries: DataFrame) -> DataFrame:
    """Every entity id a result mentions, the queried ends included."""
    return (
        chains.select("query_id", F.col("from_id").alias("entity_id"))
        .unionByName(chains.select("query_id", F.col("to_id").alias("entity_id")))
        .unionByName(queries.select("query_id", F.col("source").alias("entity_id")))
        .unionByName(queries.select("query_id", F.col("target").alias("entity_id")))
        .distinct()
    )
