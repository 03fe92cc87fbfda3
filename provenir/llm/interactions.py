"""How quality filters interact: which one removes what, in every order, and a fair share for each.

The removal game: a coalition of filters removes every document that fails at
least one of them. Documents are folded to counts per part and set of failed
filters; from those follow the values of all coalitions, and from the values the
Hart-Mas-Colell potential, recursively: the potential of no filter is 0, that of a
coalition is its value plus the potentials of the coalitions with one filter less,
over its number of filters. A filter's Shapley value is the grand potential minus
the potential without that filter. Potentials are kept times the number of orders,
so they stay whole numbers and the value is what the filter removes summed over all
orders. What a step of an order removes is the difference of two coalition values.

Results: ``audit`` has one row per part, order and step, zeros included; a null part
is the empty string; a flag or outcome that is null counts as false; an empty table
has no parts. ``failures``: a null text is empty; a row is a copy if any row with a
smaller id has the same text, so rows that share an id and a text are not copies of
each other, a row without id is no copy, and none is a copy of it. Labels that repeat
an id hold if one of them does. Other columns play no part. Every column is taken by
its name from the caller's frame, so clashing names cannot meet.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.session import cut

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = ("A", "B", "C", "D", "E")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at one text: too few words, too repetitive, too many capitals, odd characters."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    size = F.length(text)
    capitals = size - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * size.cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, one flag per filter of ``FILTERS`` (E: a copy of a smaller id's text), ``good`` and ``toxic``.

    Texts are read once and go on as a digest. The smallest id of each text is found
    with map-side folding and met again by text and id together, so a group of copies
    of any size is no heavy key. Rows without id need neither join and skip both.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = cut(
        docs.select(
            "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
            *[c.alias(name) for name, c in text_failures(text).items()],
        ),
        "flags",
    )
    keyed, rest = narrow.filter("doc_id IS NOT NULL"), narrow.filter("doc_id IS NULL")
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marked = keyed.join(firsts, ["digest", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    flags = ["part", *FILTERS, "good", "toxic"]
    no = F.lit(False)
    return marked.join(judged, "doc_id", "left").select(flags).unionByName(
        rest.withColumns({"E": no, "good": no, "toxic": no}).select(flags)
    )


def coalition_values(rows: DataFrame, filters: tuple[str, ...], outcomes: tuple[str, ...]) -> DataFrame:
    """Per ``part``: ``total`` and, with one place per coalition (bit i: filter i), ``removed`` and each outcome's count."""
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    folded = rows.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("removed"), *[F.count(F.when(F.col(o), 1)).alias(o) for o in outcomes]
    )
    # At most one row per part and set of failed filters from here on.
    each = folded.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    counts = ("removed", *outcomes)
    values = each.groupBy("part", "coalition").agg(
        F.sum("removed").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"{c}_") for c in counts]
    )
    whole = values.groupBy("part").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("coalition", *[f"{c}_" for c in counts]))).alias("v")
    )
    return whole.select("part", "total", *[F.col(f"v.{c}_").alias(c) for c in counts])


def potentials(removed: Column, n_filters: int) -> Column:
    """Potentials of all coalitions, times the number of orders; whole numbers, in the order of coalition numbers.

    A coalition's number is greater than those of its parts, so one pass upwards has every potential it needs.
    """
    bits = [1 << i for i in range(n_filters)]

    def with_next(known: Column, coalition: Column) -> Column:
        smaller = [F.when(coalition.bitwiseAND(F.lit(b)) != 0, F.get(known, coalition - b)).otherwise(0) for b in bits]
        worth = F.get(removed, coalition) * factorial(n_filters) + sum(smaller, F.lit(0))
        return F.concat(known, F.array(F.call_function("div", worth, F.bit_count(coalition)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), with_next)


def audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS, outcomes: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters and step in it.

    ``rows`` has ``part``, a flag per filter (true: the document fails it) and a flag
    per outcome. ``kept``: documents left after the step; ``removed``: by it;
    ``redundant``: fail its filter, but went earlier; ``unique_fails``: fail no other
    filter; ``<outcome>_lost``: removed by it, with that outcome; ``shapley``: its
    filter's removed, summed over all orders.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    values = coalition_values(rows, filters, outcomes).withColumn("potential", potentials(F.col("removed"), k))
    orders = F.from_json(F.lit(json.dumps(list(permutations(range(k))))), "array<array<int>>")
    steps = values.withColumn("order", F.explode(orders)).select("*", F.posexplode("order").alias("before_step", "filter"))
    bit_of = F.array(*[F.lit(1 << i) for i in range(k)])
    bit = F.get(bit_of, F.col("filter"))
    before = F.aggregate(F.slice("order", 1, F.col("before_step")), F.lit(0), lambda s, i: s + F.get(bit_of, i))
    placed = steps.withColumns({"bit": bit, "before": before}).withColumn("after", F.col("before") + F.col("bit"))

    def gained(count: str) -> Column:
        return F.get(count, F.col("after")) - F.get(count, F.col("before"))

    names = F.array(*[F.lit(f) for f in filters])
    return placed.select(
        "part",
        F.array_join(F.transform("order", lambda i: F.get(names, i)), "").alias("filter_order"),
        (F.col("before_step") + 1).cast("int").alias("step"),
        (F.col("total") - F.get("removed", F.col("after"))).alias("kept"),
        gained("removed").alias("removed"),
        (F.get("removed", F.col("bit")) - gained("removed")).alias("redundant"),
        (F.get("removed", F.lit(full)) - F.get("removed", full - F.col("bit"))).alias("unique_fails"),
        *[gained(o).alias(f"{o}_lost") for o in outcomes],
        (F.get("potential", F.lit(full)) - F.get("potential", full - F.col("bit"))).alias("shapley"),
    )
