"""Rows packed into blocks of bounded size, to be met again by block number.

A block is one row: its number and its rows as compressed Arrow bytes. What later
steps find out about places in a block is joined to it by its number, so neither
long texts nor frequent words or passages make a heavy key. Blocks are written
before their numbers are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from provenir.llm.words import bounded_batches, slices
from provenir.session import cut


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(payload)))


def write_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame as written blocks of about ``words.SLICE_BYTES`` of ``text``: block, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, text)):
            # A copy holds the slice alone, not all of the batch that it is cut from.
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int64()), pa.array([packed(batch)], pa.binary())], names=["block", "payload"])

    bounded_batches(df.sparkSession)
    return cut(df.mapInArrow(run, "block long, payload binary"), "blocks")
