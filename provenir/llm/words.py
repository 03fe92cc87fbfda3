"""Word splitting and 64-bit hashes of word runs, on whole Arrow batches with numpy.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` takes; ``bytes.lower()`` lowers A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Texts of one batch are worked on in slices of about this many bytes.
SLICE_BYTES = 2 << 20
#: A worker's table of word hashes starts anew at this size; it only saves time.
KEPT_WORDS = 1 << 17


_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, unless it has a bound: texts may be long."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(4 << 20))


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows with about ``SLICE_BYTES`` of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(start, end - start)


def split(text: str | bytes | None, lower: bool) -> list[bytes]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return (raw.lower() if lower else raw).split()


def hashed(words: list[list[bytes]], table: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes in one array, and where each text starts in it (one more entry at the end)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    flat = np.fromiter((table[w] for ws in words for w in ws), dtype=np.uint64, count=int(starts[-1]))
    return flat, starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that near values get unrelated hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64; ``run_hash`` takes differences of them."""
    up, _ = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(flat * up[: len(flat)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end), equal for equal runs wherever they stand."""
    _, down = _powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(flat: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles, and where each text's begin.

    A text with fewer words, but some, has its whole sequence as one shingle; a
    text without words has none.
    """
    lengths = np.diff(starts)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts[:-1], counts)
    end = np.minimum(begin + size, np.repeat(starts[1:], counts))
    return run_hash(prefix_sums(flat), begin, end), bounds


def as_longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), type=pa.int64())
