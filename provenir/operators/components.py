"""Weakly connected components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.checks import require_positive
from provenir.operators.skew import MAX_BROADCAST_KEYS, hot_keys
from provenir.session import cut, cut_counted, cut_observed, release

# Links of one node above which they are not dealt by it. At most as many nodes have them as
# the graph has links / HOT_LINKS, so their rows are few.
HOT_LINKS = 100_000


@dataclass(frozen=True)
class Components:
    """``members``: entity and component. ``components``: size and index. ``stats``: totals."""

    members: DataFrame
    relationships: DataFrame
    components: DataFrame
    stats: DataFrame


def labels(edges: DataFrame) -> DataFrame:
    """``node, component`` with the smallest node id of the component as label.

    Alternates large-star and small-star rounds: every node hands its larger,
    then its smaller neighbours to the least id it knows, until the edges form
    stars. The number of rounds grows with the logarithm of the graph, and no
    node's neighbour list is ever collected.
    """
    pairs = edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    # Order-free fingerprint of the edge set, taken while it is written; stars do not change any more.
    state = dict(n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    pairs, mark = cut_observed(pairs, "stars", **state)
    while True:
        large = cut(_large_star(pairs), "stars")
        new, now = cut_observed(_small_star(large), "stars", **state)
        release(pairs, large)
        pairs = new
        if now == mark:
            break
        mark = now
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centers = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centers)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v > u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # A star's center is in very many links: those meet its one row by broadcast, not in one task.
    hot = hot_keys(pairs.select(F.col("v").alias("u")), ["u"], HOT_LINKS)
    if hot is None:
        met = both.join(least, "u", "left")
    else:
        centers = F.broadcast(least.join(hot, "u", "left_semi"))
        met = both.join(hot, "u", "left_anti").join(least, "u", "left").unionByName(
            both.join(hot, "u", "left_semi").join(centers, "u", "left")
        )
    # A node without a smaller neighbour is its own least; its links stay as they are.
    return met.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def number_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A running number from 0 over a total order, without one global window.

    Rows are range-partitioned and written with their partition number; a small
    table of partition sizes gives the offsets.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = cut(ranged, "ranged")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition; broadcast once its number is known to be small.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    offsets, n = cut_counted(offsets, "offsets")
    if n <= MAX_BROADCAST_KEYS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_part", "_base")
    )


def running_totals(df: DataFrame, by: str, order: str, weight: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the same ``by`` that come before in ``order``.

    As in ``number_in_order``, rows are range-partitioned and a small table of sums per
    part gives the offsets, so one ``by`` may hold any number of rows.
    """
    placed = cut(df.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = placed.groupBy(by, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select(by, "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base")), "offsets")
    inside = Window.partitionBy("_part", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(offsets, [by, "_part"]).withColumn(
        name, F.col("_base") + F.col("_in")
    ).drop("_part", "_base", "_in")


def find_components(relationships: DataFrame, *, min_size: int = 1) -> Components:
    """Clusters of entities joined by relationships, direction ignored.

    ``min_size`` only hides small components; totals are taken before it, and
    ``component_index`` is numbered after it, by smallest member id.
    """
    require_positive("min_size", min_size)
    edges = relationships.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    label = cut(labels(edges), "labels")
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n_entities"))
    sized = (
        relationships.select(F.col("id").alias("rel_id"), F.col("source_entity_id").alias("node"))
        .join(label, "node")
        .select("rel_id", "component")
    )
    rel_counts = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n_relationships"))
    sizes = cut(sizes.join(rel_counts, "component"), "sizes")
    shown = number_in_order(sizes.where(F.col("n_entities") >= min_size), ["component"], "component_index")
    members = label.join(shown.select("component", "component_index"), "component").select(
        "component_index", "component", F.col("node").alias("entity_id")
    )
    shown_rels = sized.join(shown.select("component", "component_index"), "component").select(
        "component_index", "component", "rel_id"
    )
    stats = sizes.agg(
        F.coalesce(F.sum("n_entities"), F.lit(0)).alias("total_entities_in_graph"),
        F.coalesce(F.sum("n_relationships"), F.lit(0)).alias("total_relationships"),
        F.count(F.lit(1)).alias("total_components_found"),
    )
    return Components(members, shown_rels, shown, stats)
