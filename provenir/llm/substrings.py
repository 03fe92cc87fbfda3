"""Removal of repeated passages by winnowed anchors, extended both ways.

A passage is a run of at least ``LEAST`` words that starts at two places or more, in
one document or several. Of every ``LEAST`` consecutive words the 8-word run with
the smallest hash is the anchor; equal windows have equal anchors, and neighbouring
windows mostly share one, so about one place in fifteen is an anchor (winnowing).
Places with the same anchor are the seeds. A seed is extended both ways over all
windows that have it as anchor:

1. where all places of an anchor agree over that whole stretch, or at least two do,
   every window of the stretch is repeated;
2. of anchors whose places differ somewhere, one place for each different stretch is
   looked at window by window, and a window is repeated if its words occur again.

The repeated windows of a document joined together are its maximal repeats, and
every word in one goes, at every place. Windows are judged on the input. Words and
windows are compared by 64-bit hashes, two of them for each decision.

Results: null text has no words; documents shorter than ``LEAST`` lose nothing; a
document that repeats as a whole loses all its words; rows that repeat count as
documents of their own; an empty table gives an empty result. Other columns are
kept; a column of the same name as an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.blocks import unpacked, write_blocks
from provenir.llm.bpe import schema_with, with_column
from provenir.llm.words import WordHashes, as_longs, hashed, mixed, prefix_sums, run_hash, split
from provenir.session import cut, release

LEAST = 35
GRAM = 8


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Words:
    """Word hashes of a block's texts, with running sums for hashes of any run."""

    def __init__(self, texts: list[str | None], table: WordHashes):
        self.words = [split(t, False) for t in texts]
        self.flat, self.starts = hashed(self.words, table)
        self.sums = prefix_sums(self.flat)

    def windows(self, least: int) -> np.ndarray:
        """Starts of all windows, each inside one text."""
        counts = np.maximum(0, np.diff(self.starts) - least + 1)
        ends = np.cumsum(counts)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[:-1] - (ends - counts), counts)

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return run_hash(self.sums, start, start + length)

    def seeds(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of windows with one anchor: the anchor's hash, the stretch's hash, first window, number of windows."""
        starts = self.windows(least)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        gram = min(GRAM, least)
        at = np.arange(len(self.flat) - gram + 1)
        grams = self.hash(at, gram)
        bits = np.uint64(max(24, int(len(grams)).bit_length()))
        # Upper bits of the hash, then the place: the leftmost of the smallest.
        keys = sliding_least(((grams >> bits) << bits) | at.astype(np.uint64), least - gram + 1)
        anchor = (keys[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        place, begin = anchor[first], starts[first]
        stretch = self.hash(begin, count + least - 1)
        return grams[place], mixed(stretch + (place - begin).astype(np.uint64)), begin, count


def _texts(payload: bytes, text: str) -> tuple[pa.RecordBatch, list[str | None]]:
    batch = unpacked(payload)
    return batch, batch.column(batch.schema.get_field_index(text)).to_pylist()


def _listed(column: pa.Array, row: int, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """One row of a list-of-structs column as arrays, empty for null."""
    if not column[row].is_valid:
        return tuple(np.zeros(0, np.int64) for _ in names)
    values = column[row].values
    return tuple(values.field(n).to_numpy(zero_copy_only=False) for n in names)


def repeated_stretches(blocks: DataFrame, text: str, least: int) -> DataFrame:
    """block, first, count: repeated windows, as runs of ``count`` starts from word ``first`` of the block (written)."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                anchor, stretch, first, count = Words(_texts(payload, text)[1], table).seeds(least)
                yield pa.RecordBatch.from_arrays(
                    [as_longs(anchor), as_longs(stretch), pa.array(np.full(len(first), block)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "stretch", "block", "first", "count"])

    places = cut(blocks.mapInArrow(seeds, "anchor long, stretch long, block long, first int, count int"), "repeat-seeds")
    # Seeds: anchors with two places or more; ``one`` tells that all their stretches agree.
    repeated = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    repeated = cut(repeated.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("one")), "repeat-anchors")
    found = cut(places.join(repeated, "anchor"), "repeat-places")
    release(places, repeated)
    mixed_ones = found.filter("NOT one")
    kinds = cut(mixed_ones.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("block", "first", "count")).alias("at")), "repeat-kinds")
    whole = mixed_ones.join(kinds.filter("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("block", "first", "count")
    # Window by window, one place of every kind; a kind with more places counts as two.
    asked = kinds.select(F.col("at.block").alias("block"), F.struct("anchor", "at.first", "at.count", (F.col("n") == 1).alias("alone")).alias("ask"))
    lists = cut(asked.groupBy("block").agg(F.collect_list("ask").alias("asks")), "repeat-asks")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                block, payload = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                anchor, first, count, alone = _listed(batch.column(2), row, ("anchor", "first", "count", "alone"))
                known = Words(_texts(payload, text)[1], table)
                ends = np.cumsum(count.astype(np.int64))
                start = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(anchor, count)), as_longs(known.hash(start, least)), pa.array(np.full(len(start), block)), pa.array(start.astype(np.int32)), pa.array(np.repeat(alone, count))],
                    names=["anchor", "window", "block", "first", "alone"])

    looked = cut(blocks.join(lists, "block").mapInArrow(windows, "anchor long, window long, block long, first int, alone boolean"), "repeat-windows")
    again = looked.groupBy("anchor", "window").agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n")).filter("n > 1")
    again = cut(again.select("anchor", "window"), "repeat-again")
    single = looked.filter("alone").join(again, ["anchor", "window"]).select("block", "first", F.lit(1).alias("count"))
    every = found.filter("one").select("block", "first", "count").unionByName(whole).unionByName(single)
    out = cut(every, "repeat-stretches")
    release(found, kinds, lists, looked, again)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and kept (the words that stay, joined by one space) set or added."""
    blocks = write_blocks(docs, text)
    stretches = repeated_stretches(blocks, text, least)
    lists = stretches.groupBy("block").agg(F.collect_list(F.struct("first", "count")).alias("gone"))
    schema = schema_with(docs, n_words="long", n_removed="long", kept="string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, texts = _texts(batch.column(1)[row].as_py(), text)
                first, count = _listed(batch.column(2), row, ("first", "count"))
                words = [split(t, False) for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                edges = np.zeros(starts[-1] + 1, dtype=np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, first.astype(np.int64) + count + least - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed, kept = [], []
                for w, a, z in zip(words, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    n = int(np.count_nonzero(gone[a:z]))
                    removed.append(n)
                    kept.append(b" ".join(w if not n else [x for x, g in zip(w, gone[a:z].tolist(), strict=True) if not g]).decode())
                own = with_column(own, "n_words", pa.array(np.diff(starts)))
                own = with_column(own, "n_removed", pa.array(removed, pa.int64()))
                yield with_column(own, "kept", pa.array(kept, pa.string()))

    return blocks.join(lists, "block", "left").mapInArrow(apply, schema)
