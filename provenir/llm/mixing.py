"""Mixing sources along a time-varying curriculum.

Each source has a weight over training time in [0, 1], given as points joined by
straight lines. The integral of a source's weight, scaled to its target, is its
cumulative demand: how many of its words training has taken by then. A document
stands at the time at which the demand reaches its place in its source's stream,
so positions are the inverse of the cumulative demand, and sorting by range of
position deals the documents out in training order. A source whose target is more
than its words starts its stream again: its documents have a pass each round. Training
takes the passes that have a position, and of the last one the words that the demand
still reaches.

Places in the streams are running sums in range partitions of (source, order
key): each part is summed by itself and shifted by what stands before it, so a
source that holds most rows is spread like the others. The order key is a digest
of the document's id, so reruns agree.

Results: a null text has no words and a null source is a source of its own, last
in order; documents without words are never taken; rows that repeat are documents
of their own; sources without words get no target; an empty table gives an empty
result. ``training_order`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights in turn for the sources in order, each constant over time.
CYCLE = (3, 1, 2)
SHARE = (3, 2)
MOST_TIMES = 2
#: Weight over training time for the sources in turn, as (time, weight) points. Each integrates to 1,
#: so over the whole training a source keeps the weight that ``CYCLE`` gives it.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))
#: Sources up to which their targets (a row of some 60 bytes each) are broadcast.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = CYCLE, share: tuple[int, int] = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """``sizes``: source, source_size, one row per source. Adds turn (its place among the sources), weight and target.

    All targets together are ``share`` of all sizes; none is above ``most`` times its
    source; what is cut off goes to the others by weight, until none is above. The
    sources that end at their limit are the first by limit per weight, so the level
    that the others share follows from running sums.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    summed = limited.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("held"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    left = F.col("all_size") * share[0] / share[1] - F.col("held")
    level = F.max(F.when(F.col("limit") * F.col("open") > left * F.col("weight"), F.struct(-F.col("place_by_ratio"), left, "open"))).over(every)
    leveled = summed.withColumn("place_by_ratio", F.row_number().over(by_ratio)).withColumn("level", level)
    shared = F.col("weight") * F.col("level.col2") / F.col("level.open")
    return leveled.select(
        "source", "source_size", "weight", F.col("place").alias("turn"),
        F.when(F.col("level").isNull() | (F.col("place_by_ratio") < -F.col("level.col1")), F.col("limit").cast("double"))
        .otherwise(shared.cast("double")).alias("target"))


def row_key(columns: Sequence[str]) -> Column:
    """A digest of all columns, nulls told from values: what repeated rows have in common, and no others."""
    quoted = [F.col(f"`{c.replace('`', '``')}`").cast("string") for c in sorted(columns)]
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in quoted)))


def streams(docs: DataFrame) -> DataFrame:
    """Narrow rows (doc_id, source, size, key) with ``place``: words of the same source before the document in its stream."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.withColumn("order_key", order).withColumn("row", F.monotonically_increasing_id())
    # Of rows with equal id and size those alike in all columns are left to the row number, which only splits them.
    dealt = keyed.repartitionByRange("source", "order_key", "size", "key", "row").select("*", F.spark_partition_id().alias("part"))
    rows = cut(dealt, "mix-streams")
    own = Window.partitionBy("part", "source").orderBy("order_key", "size", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    # A part has few sources, and a source's parts are the rows of a small table.
    parts = rows.groupBy("part", "source").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(parts.select("part", "source", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")), "mix-parts")
    inside = rows.withColumn("place", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = inside.alias("r").join(shifts.alias("s"), (F.col("r.part") == F.col("s.part")) & F.col("r.source").eqNullSafe(F.col("s.source")))
    return joined.select("r.doc_id", "r.source", "r.size", "r.key", (F.col("place") + F.col("ahead")).alias("place"))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"))


def position(demanded: Column, target: Column, schedule: Sequence[tuple[float, float]] = ((0.0, 1.0), (1.0, 1.0))) -> Column:
    """Training time at which the cumulative demand of a source reaches ``demanded`` of its ``target`` words.

    ``schedule``: (time, weight) points from time 0 to 1; between two points the
    weight is linear, so the demand is a parabola and is inverted in closed form.
    """
    areas, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        areas.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    goal = F.least(F.lit(1.0), demanded / F.greatest(target, F.lit(1.0))) * total
    out = F.lit(1.0)
    for t0, t1, w0, w1, base in reversed(areas):
        over, slope = goal - base, (w1 - w0) / (t1 - t0) if t1 > t0 else 0.0
        root = F.try_divide(2 * over, F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w0 * w0)) + 2 * slope * over)))
        end = base + (t1 - t0) * (w0 + w1) / 2
        out = F.when(goal < end, t0 + F.coalesce(root, F.lit(0.0))).otherwise(out)
    return out


def position_in_turn(demanded: Column, target: Column, turn: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """``position`` under the schedule whose turn it is."""
    at = position(demanded, target, schedules[0])
    for n, points in enumerate(schedules[1:], 1):
        at = F.when(turn % len(schedules) == n, position(demanded, target, points)).otherwise(at)
    return at


def source_passes(schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The passes of a document that training meets: start (words its source has given before), position, words taken.

    ``targets`` ends a source at ``most`` times its words, so a document has at most that many passes, rounded up.
    """
    demand = F.round("target").cast("long")
    rounds = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.ceil(demand / F.greatest("source_size", F.lit(1)))).otherwise(0)
    starts = F.when(rounds > 0, F.transform(F.sequence(F.lit(0), rounds.cast("int") - 1), lambda k: k * F.col("source_size") + F.col("place")))
    reached = F.filter(F.coalesce(starts, F.array().cast("array<long>")), lambda start: start < demand)
    return F.transform(reached, lambda start: F.struct(
        start.alias("start"),
        position_in_turn(start, F.col("target"), F.col("turn"), schedules).alias("position"),
        F.least(F.col("size"), demand - start).alias("words")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = CYCLE,
        share: tuple[int, int] = SHARE, most: int = MOST_TIMES, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, weight, place, key (``row_key``), passes,
    taken (the words of its passes) and position (of its first pass; null without any)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), row_key(docs.columns).alias("key"))
    rows = streams(sized)
    goal = cut(targets(source_sizes(rows), weights, share, most), "mix-targets")
    few = goal.count() <= MAX_BROADCAST_SOURCES
    joined = rows.alias("r").join((F.broadcast(goal) if few else goal).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    flat = joined.select("r.doc_id", "r.source", "r.size", "t.source_size", "t.target", "t.weight", "t.turn", "r.place", "r.key")
    return flat.withColumn("passes", source_passes(schedules)).select(
        "doc_id", "source", "size", "source_size", "target", "weight", "place", "key", "passes",
        F.aggregate("passes", F.lit(0).cast("long"), lambda sum_, p: sum_ + p["words"]).alias("taken"),
        F.try_element_at("passes", F.lit(1))["position"].alias("position"))


def by_position(mixed: DataFrame) -> DataFrame:
    """The documents of ``mix`` in the order in which training first meets them; those it never meets come first."""
    return mixed.repartitionByRange("position", "key").sortWithinPartitions("position", "key")


def training_order(docs: DataFrame, mixed: DataFrame, schedules: dict[str, Sequence[tuple[float, float]]] | None = None) -> DataFrame:
    """Documents as training meets them: a row per document and pass, range-sorted by position.

    ``mixed`` is ``mix(docs)`` of the same columns; ``schedules`` has the weight points of sources that take others
    than those in turn. Only whole documents are passed on: a pass that reaches less than
    half of one leaves it out. Rows alike in all columns share a key, and each has its own passes.
    """
    each = mixed.select("source", "target", "key", F.explode("passes").alias("pass"), "size").filter("2 * pass.words >= size")
    at = F.col("pass.position")
    for name, points in (schedules or {}).items():
        at = F.when(F.col("source").eqNullSafe(F.lit(name)), position(F.col("pass.start"), F.col("target"), points)).otherwise(at)
    placed = each.select(F.col("key").alias("mix_key"), at.alias("mix_position"))
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    texts = docs.select(row_key(docs.columns).alias("mix_key"), F.struct(*columns).alias("mix_row")).dropDuplicates(["mix_key"])
    joined = texts.join(placed, "mix_key")
    return joined.repartitionByRange("mix_position", "mix_key").sortWithinPartitions("mix_position", "mix_key").select("mix_row.*")
