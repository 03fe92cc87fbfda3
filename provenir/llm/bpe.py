"""Byte-level BPE by prefix dynamic programming.

The greedy merge order gives every byte string one encoding, and every prefix of
the string then has one last token: the token ``t`` that ends there, whose rest
``prefix - t`` has a last token ``s`` such that ``s + t`` re-encodes to exactly
``[s, t]``. The table of last tokens is filled left to right, so appending bytes
only extends it and an edit only recomputes it from the edit on, until it agrees
with the old table over one longest token.

Results: null text gives no ids, as the empty text does; repeated and very long
texts need no special case (time is linear in the bytes); an empty table gives an
empty table; other columns are kept, and an output column replaces one of its name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from provenir.llm.words import bounded_batches, slices

#: Bounds of a worker's caches: pieces in each of two generations, and places for pairs.
KEPT_PIECES = 1 << 18
KEPT_PAIRS = 1 << 21
#: A piece match looks at most this many characters past its end.
LOOKAHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Recent:
    """A bounded cache in two generations: what was not asked for during a whole one is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """One vocabulary: encoding of pieces, prefix tables, decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._pieces = Recent(KEPT_PIECES)
        # One place per hash of a pair: the pair and its answer; a later pair takes the place.
        self._pairs, self._answers = array("q", [-1]) * KEPT_PAIRS, bytearray(KEPT_PAIRS)
        self._ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self.merged(token) == [rank]:  # others can never stand in an encoding
                self._ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ends.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by the definition: join the pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is its own encoding."""
        pair = left << 32 | right
        place = (left * 0x9E3779B1 ^ right * 0x85EBCA6B) % KEPT_PAIRS
        if self._pairs[place] != pair:
            self._answers[place] = self.merged(self.token[left] + self.token[right]) == [left, right]
            self._pairs[place] = pair
        return bool(self._answers[place])

    def prefixes(self, data: bytes) -> PrefixTable:
        return PrefixTable(self, data)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers; a piece that is a token is that token."""
        known = self._pieces.young.get(piece) or self._pieces.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else PrefixTable(self, raw).ids()
            known = np.array(ids, dtype="<u4").tobytes()
            if len(raw) <= 64:
                self._pieces.put(piece, known)
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, each match of the pattern by itself, no special tokens."""
        pieces = self.pattern.findall(text)
        found = list(map(self._pieces.young.get, pieces))
        return b"".join([self.piece(p) if x is None else x for p, x in zip(pieces, found, strict=True)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class PrefixTable:
    """Last token of every prefix of a byte string, kept exact under appends and edits."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def _fill(self, old: list[int] | None = None, shift: int = 0, settled: int = 0) -> None:
        """Extend ``last`` to all of ``data``; stop early where it has met ``old`` again."""
        encoder, last, first = self.encoder, self.last, len(self.last)
        begin = max(0, first - encoder.longest)
        text, fits = self.data[begin:].decode("latin-1"), encoder.fits
        last.extend([-1] * (len(self.data) + 1 - first))
        same = met = 0
        for end, (rank, length) in encoder._ends.iter(text):
            at = begin + end + 1
            if at < first or last[at] >= 0:
                continue
            before = last[at - length]
            if at == length or (before >= 0 and fits(before, rank)):
                last[at] = rank
                if old is not None and at > settled:
                    same = same + 1 if old[at - shift] == rank and at == met + 1 else int(old[at - shift] == rank)
                    met = at
                    if same >= encoder.longest:
                        last[at + 1 :] = old[at + 1 - shift :]
                        return

    def append(self, data: bytes) -> None:
        self.data += data
        self._fill()

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of bytes [start, end)."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        self._fill(old, shift, start + len(data))

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.encoder.token[self.last[at]])
        return out[::-1]


class EditableText:
    """A text with its pieces and ids; an edit re-splits and re-encodes only near itself."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.ends = [m.end() for m in encoder.pattern.finditer(text)]
        self.parts = [encoder.piece(p) for p in encoder.pattern.findall(text)]

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters [start, end); ``start == end == len(text)`` appends."""
        shift = len(new) - (end - start)
        keep = 0
        while keep < len(self.ends) and self.ends[keep] <= start - LOOKAHEAD:
            keep += 1
        self.text = self.text[:start] + new + self.text[end:]
        old = {e + shift: i for i, e in enumerate(self.ends) if e >= end}
        ends, parts = self.ends[:keep], self.parts[:keep]
        for m in self.encoder.pattern.finditer(self.text, ends[-1] if ends else 0):
            ends.append(m.end())
            parts.append(self.encoder.piece(m.group()))
            if m.end() >= start + len(new) and (i := old.get(m.end())) is not None:
                ends += [e + shift for e in self.ends[i + 1 :]]
                parts += self.parts[i + 1 :]
                break
        self.ends, self.parts = ends, parts

    def ids(self) -> bytes:
        return b"".join(self.parts)


@lru_cache(maxsize=4)
def _encoder(lines: bytes, pattern: str) -> Encoder:
    ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.split(b"\n") if x.strip())}
    return Encoder(ranks, pattern)


class Vocabulary:
    """A rank file and pattern on their way to the tasks; its size is that of the file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self._lines, self.pattern = spark.sparkContext.broadcast(file.read()), pattern

    def encoder(self) -> Encoder:
        return _encoder(self._lines.value, self.pattern)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.append_column(name, values) if at < 0 else batch.set_column(at, name, values)


def schema_with(df: DataFrame, **kinds: str) -> str:
    """The frame's schema with the named columns set or added, as DDL."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema} | kinds
    return ", ".join(f"`{k.replace('`', '``')}` {v}" for k, v in fields.items())


def encode_texts(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of the whole text as little-endian 32-bit integers (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder().encode
        for batch in slices(batches, text):
            found = [encode(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield with_column(batch, out, pa.array(found, type=pa.binary()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{out: "binary"}))


def decode_ids(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for (binary; null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary.encoder().decode
        for batch in slices(batches, ids):
            found = [decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield with_column(batch, out, pa.array(found, type=pa.binary()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{out: "binary"}))
