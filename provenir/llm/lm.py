"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

A word's probability after another is that of its class after the other's class,
times that of the word in its class. Classes are found by exchange: words move to
the class that raises the likelihood of the training text most. The exchange starts
on the driver, over units: the ``CORE`` most frequent training words, each by
itself, and groups of all other words by a hash of their last letters. From there
every training word moves by its own contexts, in ``ROUNDS`` rounds. In a round, one
half of the words (by a hash) is free; blocks count each free word's neighbours by
class, a task sums them for its share of the words and finds every word's best class
against the class-by-class table, and the classes go back to the blocks. All words of
a round see the same table, so the result does not depend on how they are dealt out;
a round that does not raise the likelihood is undone. Only words unseen in training
keep the class of their unit.

Words are counted exactly and without a bound. The corpus is packed in blocks; a
block holds its texts as numbers into its own word list, so a word crosses the
shuffle once for each block that has it, and its total goes back to the block by
the block's number. Blocks with their totals are written as files that rounds read
by place, so rounds move neighbour counts and classes only. Neither texts nor
frequent words make heavy keys: a block sends at most ``SLOTS`` cells for a word.

Smoothing: a class transition is mixed with the class's overall share, ``PRIOR``
counts of it; a class gives half a count to each of its words and half a count to
all unknown words together. The end of a text is a token and a class of its own,
and the class that stands before a text's first word.

Results: a null text is empty and has the end token alone; a null id counts as
empty text for the fold; repeated rows are scored alike and each counts in
training; without training rows all words are unknown and scores stay finite; an
empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm import words as w
from provenir.llm.blobs import BlobWriter, RangeReader
from provenir.session import cut, release, scratch_path

CORE, GROUPS = 511, 512
UNITS = CORE + GROUPS
CLASSES = 64
LETTERS = 3
SWEEPS = 10
PRIOR = 16.0
#: Bytes of text in one block, about.
BLOCK_BYTES = 8 << 20
PAIRS = np.dtype([("right", "<u2"), ("count", "<u4")])
LOOKED = np.dtype([("code", "<u4"), ("id", "<i8"), ("total", "<i8"), ("class", "u1"), ("half", "u1")])
#: Rounds in which one half of the words may change class, in turn.
ROUNDS = 4
SIDE = CLASSES + 1
#: Cells of a word: by class of the word after it, by class of the word before it, and itself after itself.
SLOTS = 2 * SIDE + 1
#: Words whose best class is sought at once.
WORDS_AT_ONCE = 512
STATE = "block long, file string, offset long, length long, classes binary, pairs binary"


def unit_of(word: bytes, core: dict[bytes, int]) -> int:
    known = core.get(word)
    return known if known is not None else CORE + xxhash.xxh3_64_intdigest(word[-LETTERS:]) % GROUPS


class Block:
    """Texts as numbers into the block's own word list."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.trained = np.array(row["trained"], dtype=bool)
        self.starts = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
        self.codes = unpacked_codes(row["codes"])


def packed_codes(codes: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_blocks(docs: DataFrame, doc_id: str, text: str, trained: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, trained, lengths, codes, words, counts (of training tokens), as written."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), trained.alias("trained"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, marks, lengths, codes, table, size = [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, "<u4")
            used = np.repeat(np.array(marks, dtype=bool), lengths)
            counts = np.bincount(flat[used], minlength=len(table))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([number]), one(pa.array(ids, pa.int64())), one(pa.array(marks, pa.bool_())), one(pa.array(lengths, pa.int64())),
                       pa.array([packed_codes(flat)], pa.binary()), one(pa.array(table.keys(), pa.binary())), one(pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "trained", "lengths", "codes", "words", "counts"])

        for batch in w.slices(batches, "text"):
            for i, t, mark in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = w.split(t, True)
                ids.append(i)
                marks.append(mark)
                lengths.append(len(own))
                codes.append(np.array([table.setdefault(x, len(table)) for x in own], dtype="<u4"))
                size += len(t)
            if size >= block_bytes:
                yield block()
                number += 1
                ids, marks, lengths, codes, table, size = [], [], [], [], {}, 0
        if ids:
            yield block()

    ddl = "block long, doc_ids array<long>, trained array<boolean>, lengths array<long>, codes binary, words array<binary>, counts array<long>"
    w.bounded_batches(docs.sparkSession)
    return cut(rows.mapInArrow(run, ddl), "lm-blocks")


def count_words(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training counts of all words (word, total, id; written), and each block's words (block, code, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, counts = batch.column(1)[row].values, batch.column(2)[row].values
                block = pa.array(np.full(len(own), batch.column(0)[row].as_py()))
                yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(len(own), dtype=np.int32)), own, counts], names=["block", "code", "word", "count"])

    rows = blocks.select("block", "words", "counts").mapInArrow(run, "block long, code int, word binary, count long")
    summed = rows.groupBy("word").agg(F.sum("count").alias("total"))
    totals = cut(summed.withColumn("id", F.monotonically_increasing_id()), "lm-totals")
    return totals, rows.drop("count")


def labelled(totals: DataFrame, core: dict[bytes, int], member: np.ndarray) -> DataFrame:
    """Every word once, with the class of its unit and its half (word, total, id, class, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            classes = member[[unit_of(x, core) for x in words]] if words else np.zeros(0, np.int64)
            halves = np.array([xxhash.xxh3_64_intdigest(x) >> 63 for x in words], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes.astype(np.int32)), pa.array(halves)], names=["word", "total", "id", "class", "half"])

    return totals.select("word", "total", "id").mapInArrow(run, "word binary, total long, id long, class int, half int")


def known_words(words: DataFrame) -> np.ndarray:
    """Known words of each class; at most ``CLASSES`` rows reach the driver."""
    kinds = np.zeros(CLASSES, np.int64)
    for r in words.filter("total > 0").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():
        kinds[r["class"]] = r.n
    return kinds


def core_words(totals: DataFrame) -> dict[bytes, int]:
    """The ``CORE`` most frequent training words and their units; at most ``CORE`` rows reach the driver."""
    rows = totals.filter("total > 0").orderBy(F.col("total").desc(), "word").limit(CORE).collect()
    return {bytes(r.word): i for i, r in enumerate(rows)}


def unit_bigrams(blocks: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Counts of unit pairs in training texts; unit ``UNITS`` is the end of a text. At most UNITS + 1 rows reach the driver."""
    side = UNITS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(side * side, dtype=np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row)
                units = np.array([unit_of(x, core) for x in row["words"]], dtype=np.int64)
                stream, _ = with_ends(block, units, UNITS)
                left = np.concatenate([[UNITS], stream[:-1]])
                used = np.repeat(block.trained, np.diff(block.starts) + 1)
                table += np.bincount(left[used] * side + stream[used], minlength=side * side)
        table = table.reshape(side, side)
        out = []
        for left in np.flatnonzero(table.any(axis=1)):
            right = np.flatnonzero(table[left])
            cells = np.zeros(len(right), PAIRS)
            cells["right"], cells["count"] = right, table[left][right]
            out.append((int(left), cells.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["left", "cells"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(side, dtype=np.int64)
        for cells in frame["cells"]:
            found = np.frombuffer(cells, PAIRS)
            total[found["right"]] += found["count"]
        return pd.DataFrame({"left": [frame["left"].iloc[0]], "row": [total.tobytes()]})

    parts = blocks.select("doc_ids", "trained", "lengths", "codes", "words").mapInArrow(run, "left long, cells binary")
    out = np.zeros((side, side), dtype=np.int64)
    for r in parts.groupBy("left").applyInPandas(summed, "left long, row binary").collect():
        out[r.left] = np.frombuffer(r.row, dtype=np.int64)
    return out


def with_ends(block: Block, per_code: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens with ``end`` after each text, and where each text begins."""
    lengths = np.diff(block.starts)
    starts = block.starts[:-1] + np.arange(len(lengths))
    out = np.full(len(block.codes) + len(lengths), end, dtype=per_code.dtype)
    where = np.arange(len(block.codes)) + np.repeat(np.arange(len(lengths)), lengths)
    out[where] = per_code[block.codes] if len(per_code) else 0
    return out, starts


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. The last unit, the end of a text, is alone in the last class.

    The part of the log-likelihood that depends on classes is the sum over class
    pairs of f(n(a, b)) less twice the sum over classes of f(n(a)), f(x) = x log x.
    """
    n, end = len(bigrams), classes
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-weight[: n - 1], kind="stable")
    member = np.zeros(n, dtype=np.int64)
    member[order] = np.arange(n - 1) % classes
    member[n - 1] = end
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    counts = bigrams.astype(np.float64)
    onehot = np.eye(classes + 1)[member]
    pairs = onehot.T @ counts @ onehot
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            own = member[u]
            out, inn, self_ = counts[u] @ onehot, counts[:, u] @ onehot, counts[u, u]
            out[own] -= self_
            inn[own] -= self_
            # Without the unit.
            pairs[own] -= out
            pairs[:, own] -= inn
            pairs[own, own] -= self_
            rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
            total_out, total_in = out.sum() + self_, inn.sum() + self_
            # Gain of joining class c: changed cells of its row and column, its diagonal by itself.
            gain = (f(pairs + out[None, :]) - f(pairs)).sum(axis=1) + (f(pairs + inn[:, None]) - f(pairs)).sum(axis=0)
            diagonal = np.diag(pairs)
            gain -= f(diagonal + out) - f(diagonal) + f(diagonal + inn) - f(diagonal)
            gain += f(diagonal + out + inn + self_) - f(diagonal)
            gain -= f(rows + total_out) - f(rows) + f(cols + total_in) - f(cols)
            best = int(np.argmax(gain[:classes]))
            best = own if gain[own] >= gain[best] - 1e-9 else best
            pairs[best] += out
            pairs[:, best] += inn
            pairs[best, best] += self_
            if best != own:
                onehot[u, own], onehot[u, best], member[u] = 0, 1, best
                moved += 1
        if moved <= n // 200:
            break
    return member


class Model:
    """Transitions between classes, totals of each class, and what scoring needs besides the words' own counts."""

    def __init__(self, bigrams: np.ndarray, member: np.ndarray, core: dict[bytes, int], totals: DataFrame):
        self.member, self.core = member, core
        onehot = np.eye(CLASSES + 1)[member]
        self.kinds_by_class = known_words(labelled(totals, core, member))
        self.fit(onehot.T @ bigrams @ onehot, self.kinds_by_class)

    def fit(self, pairs: np.ndarray, kinds: np.ndarray) -> None:
        """From the counts of class pairs and the known words of each class."""
        share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
        self.transition = np.log10((pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR))
        size, self.texts = pairs[:, :CLASSES].sum(axis=0), int(pairs[:, CLASSES].sum())
        self.tokens = int(size.sum()) + self.texts
        self.kinds = int(kinds.sum()) + (self.texts > 0)
        self.bottom = np.log10(size + 0.5 * (kinds + 1))

    def score(self, block: Block, total: np.ndarray, member: np.ndarray) -> dict[str, np.ndarray]:
        """Of every text: tokens, known tokens, unigram base and class score. ``total`` and ``member``: of the block's words."""
        base = np.log10(total + 0.5) - np.log10(self.tokens + 0.5 * (self.kinds + 1))
        end = np.log10(self.texts + 0.5) - np.log10(self.tokens + 0.5 * (self.kinds + 1))
        emitted = np.log10(total + 0.5) - self.bottom[member] if len(member) else np.zeros(0)
        classes, starts = with_ends(block, member, CLASSES)
        before = np.concatenate([[CLASSES], classes[:-1]])
        steps = self.transition[before, classes] + with_ends(block, emitted, 0.0)[0]
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return {"n_tokens": np.diff(block.starts) + 1, "n_known": sums(with_ends(block, (total > 0).astype(np.int64), int(self.texts > 0))[0]),
                "base_score": sums(with_ends(block, base, end)[0]), "score": sums(steps)}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed, behind a list of their sizes."""
    parts = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes()) for x in arrays]
    return np.array([len(parts), *map(len, parts)], dtype="<u8").tobytes() + b"".join(parts)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u8", count=len(kinds) + 1)[1:].astype(np.int64)
    ends = 8 * (len(kinds) + 1) + np.cumsum(sizes)
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(data[end - size : end]), kind) for size, end, kind in zip(sizes, ends, kinds, strict=True)]


class StoredBlock(Block):
    """A block with its words' ids, totals and halves, as ``stored`` wrote it."""

    KINDS = ("u1", "<i8", "u1", "<i8", "<u4", "<i8", "<i8", "u1")

    def __init__(self, data: bytes):
        missing, ids, trained, lengths, self.codes, self.word, self.total, self.half = unpacked(data, *self.KINDS)
        self.ids = pd.array(ids, dtype="Int64")
        self.ids[missing.astype(bool)] = pd.NA
        self.trained = trained.astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the two tokens of every training bigram; the end of a text is the code behind the last."""
        stream, _ = with_ends(self, np.arange(len(self.word)), len(self.word))
        used = np.repeat(self.trained, np.diff(self.starts) + 1)
        return np.concatenate([[len(self.word)], stream[:-1]])[used], stream[used]

    def pairs(self, classes: np.ndarray) -> np.ndarray:
        left, right = self.bigrams()
        kind = np.append(classes, CLASSES).astype(np.int64)
        return np.bincount(kind[left] * SIDE + kind[right], minlength=SIDE * SIDE)

    def free(self, half: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the known words of a half, by part and id, and their parts."""
        codes = np.flatnonzero((self.total > 0) & (self.half == half))
        part = self.word[codes] % parts
        order = np.lexsort((self.word[codes], part))
        return codes[order], part[order]


def stored(left: pd.DataFrame, right: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Writes a block with what was looked up for its words; returns its ``STATE``."""
    row, found = left.iloc[0].to_dict(), [np.frombuffer(x, LOOKED) for x in right["found"]]
    looked = np.zeros(sum(map(len, found)), LOOKED)
    for part in found:
        looked[part["code"]] = part
    ids = pd.array(list(row["doc_ids"]), dtype="Int64")
    data = packed(np.asarray(ids.isna(), dtype="u1"), ids.fillna(0).to_numpy(dtype="<i8"), np.array(row["trained"], dtype="u1"), np.array(row["lengths"], dtype="<i8"),
                  unpacked_codes(row["codes"]), looked["id"], looked["total"], looked["half"])
    writer = BlobWriter(folder, ".block")
    file, offset, length = writer.put(data)
    writer.close()
    pairs = StoredBlock(data).pairs(looked["class"])
    return pd.DataFrame({"block": [row["block"]], "file": [file], "offset": [offset], "length": [length], "classes": [looked["class"].tobytes()], "pairs": [packed(pairs)]})


def class_pairs(state: DataFrame) -> np.ndarray:
    """Counts of class pairs in all training texts; at most SIDE squared rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIDE * SIDE, np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                table += unpacked(one, "<i8")[0]
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], names=["cell", "n"])

    out = np.zeros(SIDE * SIDE, np.int64)
    for r in state.select("pairs").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(SIDE, SIDE)


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training texts' log-likelihood that depends on classes."""
    return float(x_log_x(pairs).sum() - x_log_x(pairs.sum(axis=1)).sum() - x_log_x(pairs.sum(axis=0)).sum())


def best_classes(pairs: np.ndarray, at: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word by itself, the class that raises the likelihood most; ``own`` is its class now.

    ``at``, ``slot``, ``n``: cells of the words' neighbour counts, sorted by word.
    """
    f, side, every = x_log_x, len(pairs), np.arange(len(own))
    classes, pairs = side - 1, pairs.astype(np.float64)
    dense = np.zeros((len(own), 2 * side + 1))
    dense[at, slot] = n
    out, inn, self_ = dense[:, :side], dense[:, side : 2 * side], dense[:, 2 * side]
    gain = np.zeros((len(own), classes))
    for table, first, other in ((pairs, 0, inn), (pairs.T, side, out)):
        used = (slot >= first) & (slot < first + side)
        if not used.any():
            continue
        word, kind, count = at[used], slot[used].astype(np.int64) - first, n[used].astype(np.float64)
        # The table without the word.
        base = table[:classes].T[kind]
        meets = np.flatnonzero(kind == own[word])
        base[meets] -= other[word[meets], :classes]
        base[np.arange(len(word)), own[word]] -= count
        base[meets, own[word[meets]]] -= self_[word[meets]]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
        gain[word[begin]] += np.add.reduceat(f(base + count[:, None]) - f(base), begin, axis=0)
    without = lambda margin, less: margin[None, :] - np.where(np.arange(classes) == own[:, None], less[:, None], 0.0)
    diagonal = without(np.diag(pairs)[:classes], out[every, own] + inn[every, own] + self_)
    after, before = out[:, :classes], inn[:, :classes]
    gain -= f(diagonal + after) + f(diagonal + before) - 2 * f(diagonal)
    gain += f(diagonal + after + before + self_[:, None]) - f(diagonal)
    for margin, size in ((pairs.sum(axis=1)[:classes], out.sum(axis=1) + self_), (pairs.sum(axis=0)[:classes], inn.sum(axis=1) + self_)):
        rest = without(margin, size)
        gain -= f(rest + size[:, None]) - f(rest)
    best = gain.argmax(axis=1)
    return np.where(gain[every, own] >= gain[every, best] - 1e-9, own, best)


def neighbour_counts(state: DataFrame, half: int, parts: int) -> DataFrame:
    """Per block and part of the free words: their ids, classes and cells (part, block, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                block, classes = StoredBlock(reader.get(row["file"], row["offset"], row["length"])), np.frombuffer(row["classes"], "u1")
                codes, part = block.free(half, parts)
                place = np.full(len(block.word) + 1, -1, np.int64)
                place[codes] = np.arange(len(codes))
                kind = np.append(classes, CLASSES).astype(np.int64)
                left, right = block.bigrams()
                same, first, second = left == right, place[left], place[right]
                after, before = (first >= 0) & ~same, (second >= 0) & ~same
                keys = np.concatenate([first[after] * SLOTS + kind[right[after]], second[before] * SLOTS + SIDE + kind[left[before]],
                                       second[same & (second >= 0)] * SLOTS + 2 * SIDE])
                keys, counts = np.unique(keys, return_counts=True)
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(begin[1:], len(codes))
                edges = np.searchsorted(keys, np.append(begin, len(codes)) * SLOTS)
                cells = [packed(np.diff(block.word[codes[a:z]], prepend=0), classes[codes[a:z]], (keys[x:y] // SLOTS - a).astype("<u4"),
                                (keys[x:y] % SLOTS).astype("u1"), counts[x:y].astype("<u4"))
                         for a, z, x, y in zip(begin, ends, edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(np.full(len(begin), row["block"])), pa.array(cells, pa.binary())], names=["part", "block", "cells"])
        reader.close()

    return state.select("block", "file", "offset", "length", "classes").mapInArrow(run, "part long, block long, cells binary")


def chosen_classes(counts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Best classes of the free words, for each block in its order (block, part, classes); block -1 has the change of known words by class."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [unpacked(x, "<i8", "u1", "<u4", "u1", "<u4") for x in frame["cells"]]
        sizes = np.array([len(x[0]) for x in sent])
        shift = np.cumsum(sizes) - sizes
        _, first, word = np.unique(np.concatenate([np.cumsum(x[0]) for x in sent]), return_index=True, return_inverse=True)
        own = np.concatenate([x[1] for x in sent])[first].astype(np.int64)
        keys = word[np.concatenate([x[2] + s for x, s in zip(sent, shift, strict=True)]).astype(np.int64)] * SLOTS + np.concatenate([x[3] for x in sent])
        counts = np.concatenate([x[4] for x in sent]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts
        best = own.copy()
        for a in range(0, len(own), WORDS_AT_ONCE):
            x, y = np.searchsorted(keys, [a * SLOTS, (a + WORDS_AT_ONCE) * SLOTS])
            best[a : a + WORDS_AT_ONCE] = best_classes(pairs, keys[x:y] // SLOTS - a, keys[x:y] % SLOTS, counts[x:y], own[a : a + WORDS_AT_ONCE])
        change = np.bincount(best, minlength=CLASSES) - np.bincount(own, minlength=CLASSES)
        found = best.astype("u1")[word]
        return pd.DataFrame({"block": [*frame["block"], -1], "part": frame["part"].iloc[0],
                             "classes": [*(found[s : s + n].tobytes() for s, n in zip(shift, sizes, strict=True)), change.astype("<i8").tobytes()]})

    return counts.groupBy("part").applyInPandas(choose, "block long, part long, classes binary")


def moved(state: DataFrame, chosen: DataFrame, half: int, parts: int, tasks: int) -> DataFrame:
    """The state with the chosen classes, and its class pairs; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                block, classes = StoredBlock(reader.get(row["file"], row["offset"], row["length"])), np.frombuffer(row["classes"], "u1").copy()
                codes, _ = block.free(half, parts)
                classes[codes] = np.frombuffer(b"".join(x["classes"] for x in row.pop("found") or []), "u1")
                new = row | {"classes": classes.tobytes(), "pairs": packed(block.pairs(classes))}
                yield pa.RecordBatch.from_arrays([pa.array([new[c.split()[0]]], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in STATE.split(", ")],
                                                 names=[c.split()[0] for c in STATE.split(", ")])
        reader.close()

    by_block = chosen.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "classes"))).alias("found"))
    joined = state.select("block", "file", "offset", "length", "classes").join(by_block, "block", "left")
    return cut(joined.repartition(tasks, "block").mapInArrow(run, STATE), "lm-state")


def exchange_words(state: DataFrame, kinds: np.ndarray, tasks: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Moves all training words by their own contexts; returns the state, its class pairs and known words by class."""
    pairs = class_pairs(state)
    for half in (r % 2 for r in range(rounds if pairs.any() else 0)):
        chosen = cut(chosen_classes(neighbour_counts(state.repartition(tasks, "block"), half, tasks), pairs), "lm-chosen")
        after = moved(state, chosen, half, tasks, tasks)
        found = class_pairs(after)
        if likelihood(found) > likelihood(pairs):
            change = chosen.filter("block = -1").select("classes").mapInArrow(_summed, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
            kinds = kinds + np.array([n for _, n in sorted((r["class"], r.n) for r in change)], dtype=np.int64)
            release(state, chosen)
            state, pairs = after, found
        else:
            release(after, chosen)
    return state, pairs, kinds


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    change = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for one in batch.column(0).to_pylist():
            change += np.frombuffer(one, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(change)], names=["class", "n"])


def score_texts(docs: DataFrame, trained: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows where ``trained``."""
    blocks = write_blocks(docs, doc_id, text, trained)
    totals, per_block = count_words(blocks)
    core = core_words(totals)
    bigrams = unit_bigrams(blocks, core)
    member = exchange(bigrams)
    model = Model(bigrams, member, core, totals)
    words = labelled(totals, core, member)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.zeros(batch.num_rows, LOOKED)
            for at, name in enumerate(("code", "total", "id", "class", "half"), 1):
                found[name] = batch.column(at).to_numpy()
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
            parts = np.split(found[order], first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(block[order][first]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "found"])

    # What is known of a word is found out once, before its blocks meet it.
    looked = per_block.join(words, "word").select("block", "code", "total", "id", "class", "half").mapInArrow(classed, "block long, found binary")
    folder, tasks = scratch_path(docs.sparkSession, "lm-files"), blocks.count() // 2 + 1
    slim = blocks.select("block", "doc_ids", "trained", "lengths", "codes")
    state = cut(slim.groupBy("block").cogroup(looked.groupBy("block")).applyInPandas(lambda left, right: stored(left, right, folder), STATE), "lm-state")
    release(blocks)
    state, pairs, kinds = exchange_words(state, model.kinds_by_class, tasks)
    model.fit(pairs, kinds)
    ddl = "doc_id long, held_out boolean, train_tokens long, n_tokens long, n_known long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                block = StoredBlock(reader.get(row["file"], row["offset"], row["length"]))
                found = model.score(block, block.total, np.frombuffer(row["classes"], "u1").astype(np.int64))
                columns = {"doc_id": block.ids, "held_out": ~block.trained, "train_tokens": np.full(len(block.trained), model.tokens)} | found
                yield pa.RecordBatch.from_arrays([pa.array(columns[c.split()[0]]) for c in ddl.split(", ")], names=[c.split()[0] for c in ddl.split(", ")])
        reader.close()

    return state.select("block", "file", "offset", "length", "classes").repartition(tasks, "block").mapInArrow(score, ddl)
