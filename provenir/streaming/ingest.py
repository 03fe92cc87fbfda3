"""Continuous ingest of a log folder into an append-only case store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenir.operators.merge import delta_records
from provenir.schemas import SCHEMAS, Case
from provenir.session import cut, scratch_scope
from provenir.sources.lines import _plain_path, _with_text, number_lines
from provenir.sources.parsers import get_parser
from provenir.sources.records import derive_records, require_source_id
from provenir.sources.store import INGESTED
from provenir.sources.tables import Deltas


def start_ingest(
    spark: SparkSession,
    folder: str,
    *,
    kind: str,
    root: str,
    checkpoint: str,
    collected_at: datetime,
    source_id: str | None = None,
    available_now: bool = True,
    compact_after: int = 16,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Stream new files of one kind into the store under ``root``.

    Each micro-batch writes only the rows it adds, as a version numbered by the
    batch; ``read_deltas`` reads all versions as one case, and every ``compact_after``
    versions become one. A batch that runs again after a failure finds its version
    complete and does nothing, or writes it anew; content ids make a repeated line
    a no-op either way. What a batch needs in between is deleted after it.
    """
    require_source_id(spark, source_id)
    parser = get_parser(kind)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store = Deltas(session, root, SCHEMAS)
        if store.holds(batch_id):
            return
        with scratch_scope(session):
            parsed = cut(parser.parse(number_lines(_with_text(batch))), "parsed")
            records = derive_records(
                parsed, adapter=parser.name, version=parser.version, collected_at=F.lit(collected_at),
                source_id=F.lit(source_id), locator_column=parser.locator_column, batch=batch_id,
            )
            new = delta_records(Case(**store.read(before=batch_id)), records).tables()
            store.append(batch_id, {name: new[name] for name in INGESTED})
            store.compact(compact_after)

    reader = spark.readStream.format("text").option("lineSep", "\n")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = (
        reader.load(folder)
        .select(
            _plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("raw"),
        )
    )
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
