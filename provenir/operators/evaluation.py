"""How well simple readings of shortest chains predict evidence independence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators import chains as counting
from provenir.operators.lineage import shared_members
from provenir.session import cut

METHODS = ("path_count", "structure", "direct_refs", "root_evidence")
# Fixture classes scored apart from the binary group.
PARTIAL_CLASSES = ("PARTIAL_OVERLAP", "PARTIAL_MULTI_ROOT", "PARTIAL_OVERLAP_COMPLEX")


def direct_references(chains: DataFrame) -> DataFrame:
    """``query_id, chain_index, ref_id``: the raw ids each chain cites."""
    return chains.select("query_id", "chain_index", F.explode("derived_from").alias("ref_id")).distinct()


def inner_members(chains: DataFrame, summary: DataFrame) -> DataFrame:
    """``query_id, chain_index, member``: relationships and non-endpoint entities of chains."""
    entities = chains.select("query_id", "chain_index", F.explode(F.array("from_id", "to_id")).alias("node"))
    ends = summary.select("query_id", F.explode(F.array("source", "target")).alias("node"))
    inner = entities.join(ends, ["query_id", "node"], "left_anti").select(
        "query_id", "chain_index", F.concat(F.lit("entity:"), "node").alias("member")
    )
    rels = chains.select("query_id", "chain_index", F.concat(F.lit("relationship:"), "rel_id").alias("member"))
    return inner.unionByName(rels).distinct()


def predictions(summary: DataFrame, chains: DataFrame, overlap: DataFrame) -> DataFrame:
    """``query_id, method, predicted``: does the method call the chains independent?

    ``path_count``: two chains suffice. ``structure``: no two share an inner
    entity or a relationship. ``direct_refs``: no two cite one id.
    ``root_evidence``: the verdict of the overlap analysis, null below two chains.
    """
    structural = shared_members(inner_members(chains, summary), "member")
    direct = shared_members(direct_references(chains), "ref_id")
    return _methods(summary, structural, direct, overlap)


def counted_predictions(graph: counting.ChainGraph, edges: DataFrame, relationships: DataFrame, overlap: DataFrame) -> DataFrame:
    """The same for all chains of a graph, from its ``marked_edges``; no chain is listed."""
    structural = counting.shared_by_chains(counting.inner_members(edges, graph.queries), "member")
    direct = counting.shared_by_chains(counting.cited(edges, relationships), "ref_id")
    return _methods(counting.totals(graph), structural, direct, overlap)


def _methods(summary: DataFrame, structural: DataFrame, direct: DataFrame, overlap: DataFrame) -> DataFrame:
    """One row per query and method; ``structural`` and ``direct``: what two chains of a query share."""
    structural, direct = structural.select("query_id").distinct(), direct.select("query_id").distinct()
    several = F.col("n_chains") >= 2
    wide = (
        summary.select("query_id", "n_chains")
        .join(structural.withColumn("_s", F.lit(True)), "query_id", "left")
        .join(direct.withColumn("_d", F.lit(True)), "query_id", "left")
        .join(overlap.select("query_id", "fully_evidence_independent"), "query_id", "left")
        .select(
            "query_id",
            several.alias("path_count"),
            (several & F.col("_s").isNull()).alias("structure"),
            (several & F.col("_d").isNull()).alias("direct_refs"),
            F.col("fully_evidence_independent").alias("root_evidence"),
        )
    )
    return wide.unpivot(["query_id"], list(METHODS), "method", "predicted")


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions against ``truth(query_id, class, is_adversarial, root_disjoint)``.

    ``correct`` is null where the truth has no binary answer.
    """
    t = F.col("root_disjoint")
    return predicted.join(truth, "query_id").select(
        "query_id",
        "class",
        "is_adversarial",
        "method",
        "predicted",
        t.alias("truth"),
        (F.coalesce("predicted", F.lit(False)) & F.coalesce(~t, F.lit(False))).alias("false_corroboration"),
        F.when(t.isNotNull(), F.col("predicted").eqNullSafe(t)).alias("correct"),
    )


def _groups() -> Column:
    applicable, adversarial = F.col("truth").isNotNull(), F.col("is_adversarial")
    partial = F.col("class").isin(*PARTIAL_CLASSES)
    tags = F.array(
        F.when(applicable & ~adversarial & ~partial, F.lit("binary")),
        F.when(~applicable & ~adversarial, F.lit("single_path")),
        F.when(partial, F.lit("partial_overlap")),
        F.when(adversarial, F.lit("adversarial")),
    )
    return F.filter(tags, lambda tag: tag.isNotNull())


def with_groups(evaluated: DataFrame) -> DataFrame:
    """One row per evaluation group of a case; groups are never pooled."""
    return evaluated.withColumn("group", F.explode(_groups()))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient, or null when there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts and ratios of ``predicted`` against ``truth`` per ``by``.

    Rows without a truth count nowhere; a missing prediction counts as false.
    """
    p, t = F.coalesce("predicted", F.lit(False)), F.col("truth")
    counts = scored.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(~p & ~t).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("false_positive_rate", ratio(fp, fp + tn))
    )


def group_metrics(evaluated: DataFrame) -> DataFrame:
    grouped = with_groups(evaluated)
    extra = grouped.groupBy("group", "method").agg(
        F.count_if("false_corroboration").alias("false_corroboration_count"),
        F.count(F.lit(1)).alias("cases"),
    )
    return confusion(grouped, ["group", "method"]).join(extra, ["group", "method"])


def overlapping_pairs(members: DataFrame, member: str) -> DataFrame:
    """``query_id, n``: how many chain pairs of a query share a member.

    Chains with the same members are one class with a count. All chains that hold a
    query's commonest member share it with each other, which is a number, not a list of
    pairs; pairs of classes are only formed where one of the two lacks that member.
    """
    sets = members.groupBy("query_id", "chain_index").agg(F.sort_array(F.collect_set(member)).alias("held"))
    classes = cut(
        sets.groupBy("query_id", "held").agg(F.count(F.lit(1)).alias("size")).withColumn("class", F.sha2(F.to_json("held"), 256)), "classes"
    )
    each = classes.select("query_id", "class", "size", F.explode("held").alias("m"))
    common = each.groupBy("query_id", "m").agg(F.sum("size").alias("c")).groupBy("query_id").agg(
        F.max(F.struct("c", "m")).alias("top")
    ).select("query_id", F.col("top.m").alias("top"), F.col("top.c").alias("c"))
    each = each.join(common.select("query_id", "top"), "query_id")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    in_top = common.select("query_id", (F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("n"))
    placed = cut(
        classes.join(common.select("query_id", "top"), "query_id").select("query_id", "class", "size", F.array_contains("held", F.col("top")).alias("topped")), "placed"
    )
    inside = placed.where("NOT topped").select("query_id", pairs.cast("bigint").alias("n"))
    each = each.select("query_id", "class", "size", "m").join(placed.select("query_id", "class", "topped"), ["query_id", "class"])
    left = each.where("NOT topped").select("query_id", "m", F.col("class").alias("a"), F.col("size").alias("size_a"))
    right = each.select("query_id", "m", F.col("class").alias("b"), F.col("size").alias("size_b"), "topped")
    between = left.join(right, ["query_id", "m"]).where("topped OR a < b").select("query_id", "a", "b", "size_a", "size_b").distinct()
    across = between.select("query_id", (F.col("size_a") * F.col("size_b")).alias("n"))
    total = in_top.unionByName(inside).unionByName(across).groupBy("query_id").agg(F.sum("n").alias("n"))
    return total.where("n > 0")


def pair_accounting(summary: DataFrame, roots: DataFrame, chains: DataFrame, overlap: DataFrame) -> DataFrame:
    """What one yes/no verdict hides: disjoint pairs among overlapping chains."""
    root = overlapping_pairs(roots, "root_id").withColumnRenamed("n", "root_shared")
    direct_sets = direct_references(chains)
    direct = overlapping_pairs(direct_sets, "ref_id").withColumnRenamed("n", "direct_shared")
    pairs = (F.col("n_chains") * (F.col("n_chains") - 1) / 2).cast("bigint")
    several = F.col("n_chains") >= 2
    out = (
        summary.select("query_id", "n_chains")
        .join(root, "query_id", "left")
        .join(direct, "query_id", "left")
        .join(overlap.select("query_id", "fully_evidence_independent"), "query_id", "left")
        .fillna(0, ["root_shared", "direct_shared"])
        .withColumn("total_chain_pairs", pairs)
        .withColumn("root_disjoint_pairs", F.col("total_chain_pairs") - F.col("root_shared"))
        .withColumn("direct_disjoint_pairs", F.col("total_chain_pairs") - F.col("direct_shared"))
        .withColumn("direct_verdict", several & (F.col("direct_shared") == 0))
    )
    masked = F.when(F.col("fully_evidence_independent") == False, F.col("root_disjoint_pairs")).otherwise(0)  # noqa: E712
    return out.select(
        "query_id",
        "total_chain_pairs",
        "root_disjoint_pairs",
        F.col("root_shared").alias("root_overlapping_pairs"),
        F.coalesce(masked, F.lit(0)).alias("root_pairs_masked"),
        "direct_disjoint_pairs",
        F.when(~F.col("direct_verdict"), F.col("direct_disjoint_pairs")).otherwise(0).alias("direct_pairs_masked"),
        ratio(F.coalesce(masked, F.lit(0)), F.col("total_chain_pairs")).alias("information_loss_rate"),
    )


def discriminator(evaluated: DataFrame) -> DataFrame:
    """Per case with a binary truth: who is right, direct references or root evidence."""
    wide = (
        evaluated.where("truth IS NOT NULL")
        .groupBy("query_id", "class", "truth")
        .agg(
            F.max(F.when(F.col("method") == "direct_refs", F.col("predicted"))).alias("direct_refs"),
            F.max(F.when(F.col("method") == "root_evidence", F.col("predicted"))).alias("root_evidence"),
        )
    )
    d, r = F.col("direct_refs").eqNullSafe(F.col("truth")), F.col("root_evidence").eqNullSafe(F.col("truth"))
    return wide.withColumn(
        "outcome",
        F.when(d & r, "tie").when(r, "root_evidence_wins").when(d, "direct_refs_wins").otherwise("both_wrong"),
    )


def discriminator_counts(outcomes: DataFrame) -> DataFrame:
    differ = ~F.col("direct_refs").eqNullSafe(F.col("root_evidence"))
    return outcomes.agg(
        F.count_if(differ).alias("discriminator_count"),
        F.count_if(differ & (F.col("outcome") == "root_evidence_wins")).alias("correct_discriminator_count"),
        F.count_if(F.col("outcome") == "tie").alias("baseline_equivalence_count"),
        F.count_if(F.col("outcome").isin("tie", "direct_refs_wins", "both_wrong")).alias("adversarial_defeat_count"),
        F.count_if(~F.col("root_evidence").eqNullSafe(F.col("truth"))).alias("root_evidence_error_count"),
    )


def _sets(chains: DataFrame, members: DataFrame, member: str, name: str) -> DataFrame:
    """Per query the multiset of chain member sets, as a sorted array of sorted arrays."""
    every = chains.select("query_id", "chain_index").distinct()
    per_chain = (
        every.join(members, ["query_id", "chain_index"], "left")
        .groupBy("query_id", "chain_index").agg(F.sort_array(F.collect_set(member)).alias("s"))
    )
    return per_chain.groupBy("query_id").agg(F.sort_array(F.collect_list("s")).alias(name))


def ground_truth_matches(
    summary: DataFrame, chains: DataFrame, roots: DataFrame, expected: DataFrame
) -> DataFrame:
    """Compare with ``expected(query_id, expected_paths, expected_root_sets, expected_direct_sets)``."""
    def in_order(sets: Column) -> Column:
        return F.sort_array(F.transform(sets, lambda s: F.sort_array(s)))

    def same(a: str, b: str) -> Column:
        return in_order(F.col(a)) == in_order(F.col(b))

    return (
        expected.join(summary.select("query_id", "n_chains"), "query_id", "left")
        .join(_sets(chains, roots, "root_id", "root_sets"), "query_id", "left")
        .join(_sets(chains, direct_references(chains), "ref_id", "direct_sets"), "query_id", "left")
        .select(
            "query_id",
            (F.col("n_chains") == F.col("expected_paths")).alias("path_count_matches"),
            same("root_sets", "expected_root_sets").alias("root_sets_match"),
            same("direct_sets", "expected_direct_sets").alias("direct_sets_match"),
        )
    )


def same_manifest(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two builds gave equal digests, per collection."""
    return first.select("collection", F.col("hash").alias("a")).join(
        second.select("collection", F.col("hash").alias("b")), "collection", "full"
    ).select("collection", F.col("a").eqNullSafe(F.col("b")).alias("same"))
