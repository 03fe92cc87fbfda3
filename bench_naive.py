"""Times plain plans of three analyses, as a yardstick for the ones in the package."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from provenir.functions.times import micros, tolerance_micros
from provenir.operators import gaps
from provenir.plans import views
from provenir.plans.catalog import GAP_SECONDS
from provenir.session import build_session, cut


def contradictions(spark, d):
    """Every pair of claims about one event, compared."""
    claims = views.order_claims(spark, d).select(
        "subject_event_id", "id", micros(F.col("value")).alias("us"), tolerance_micros(F.col("precision")).alias("tol"))
    a, b = claims.alias("a"), claims.alias("b")
    apart = F.abs(F.col("a.us") - F.col("b.us")) > F.col("a.tol") + F.col("b.tol")
    return a.join(b, (F.col("a.subject_event_id") == F.col("b.subject_event_id")) & (F.col("a.id") < F.col("b.id")) & apart).select("a.id", "b.id")


def coverage_gaps(spark, d):
    """Every gap compared with every claim."""
    case = views.event_case(spark, d)
    located = cut(gaps.located_claims(case.assertions, case.events, case.evidence, case.custody))
    points = located.where("n_sources = 1").select("id", "precision", "start", "end", *gaps.GROUP)
    found = cut(gaps.gap_windows(points, GAP_SECONDS))
    g, p = found.alias("g"), points.alias("p")
    inside = (F.col("p.start") < F.col("g.gap_end")) & (F.col("p.end") > F.col("g.gap_start")) & (F.col("p.source") != F.col("g.source"))
    pairs = g.join(p, inside).select(*[F.col(f"g.{c}") for c in gaps.GAP], F.col("p.source").alias("present"))
    return pairs.groupBy(*gaps.GAP, "present").count().where("count >= 2")


def components(spark, d):
    """Smallest label handed to all neighbours, round by round."""
    edges = views.trade_graph(spark, d).select(F.col("source_entity_id").alias("u"), F.col("target_entity_id").alias("v"))
    both = cut(edges.union(edges.select("v", "u")).distinct())
    labels = cut(both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    while True:
        offered = both.join(labels, both.u == labels.node).select(F.col("v").alias("node"), "label")
        new = cut(labels.union(offered).groupBy("node").agg(F.min("label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label != old").count()
        labels = new
        if not moved:
            return labels


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").count().collect()
    spent = {}
    for fn in (contradictions, coverage_gaps, components):
        started = time.perf_counter()
        fn(spark, d).write.format("noop").mode("overwrite").save()
        spent[fn.__name__] = round(time.perf_counter() - started, 3)
    print(json.dumps({"naive_seconds": spent}))
    spark.stop()


if __name__ == "__main__":
    main()
