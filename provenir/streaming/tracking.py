"""Continuous tracking of time contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenir.operators.merge import fresh_rows
from provenir.operators.skew import MAX_BROADCAST_KEYS
from provenir.operators.tracking import contradiction_rows
from provenir.schemas import ASSERTIONS, TRACKED_CONTRADICTIONS
from provenir.session import cut, cut_counted, drop_finished, scratch_scope
from provenir.sources.tables import Deltas


STORE = {"assertions": ASSERTIONS, "tracked": TRACKED_CONTRADICTIONS}


def read_tracked(spark: SparkSession, root: str) -> DataFrame:
    """All tracked contradictions of the store under ``root``."""
    return Deltas(spark, root, STORE).read()["tracked"]


def start_tracking(
    spark: SparkSession, incoming: str, *, root: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None,
    compact_after: int = 16,
) -> StreamingQuery:
    """Stream assertion files; recompute only the events a batch touches.

    A batch appends its new assertions and its new findings as one version, numbered
    by the batch. Findings are inserted once by content id, so annotations made
    meanwhile are never overwritten and a repeated batch changes nothing. Every
    ``compact_after`` versions become one. A batch's shuffle files go before the next one's come.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store = Deltas(session, root, STORE)
        if store.holds(batch_id):
            return
        drop_finished(session)
        with scratch_scope(session):
            known = store.read(before=batch_id)
            fresh = fresh_rows(known["assertions"], batch.selectExpr("*", "0 AS seq")).withColumn("fresh", F.lit(True))
            fresh = cut(fresh, "fresh")
            touched, n = cut_counted(fresh.select("subject_event_id").distinct(), "touched")
            before = known["assertions"].withColumn("fresh", F.lit(False))
            # A batch that touches few events leaves the others out unread; with many, all claims are dealt once, not twice.
            if n <= MAX_BROADCAST_KEYS:
                before = before.join(F.broadcast(touched), "subject_event_id", "left_semi")
            # Pairs of claims that were there before are tracked; one with a fresh claim cannot be.
            found = contradiction_rows(before.unionByName(fresh), "fresh")
            store.append(batch_id, {"assertions": fresh.drop("fresh"), "tracked": found})
            store.compact(compact_after)

    reader = spark.readStream.schema(ASSERTIONS)
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(incoming)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
