"""Near-duplicate groups by MinHash, banding and confirmation on full shingle sets.

Each text's set of word shingles gets ``BANDS * ROWS`` universal-hash minima; the
minima of a band together name a bucket. With 50 bands of 5 rows two sets of
resemblance 0.75 share no bucket with probability (1 - 0.75**5)**50, about 1.4e-6,
and less if they are more alike. Equal sets are one node from the start. The
buckets connect nodes to candidate groups (alternating large-star and small-star);
inside a group, pairs whose signatures agree in at least ``SCREEN`` of the minima
are confirmed on their full sets, and a confirmed pair is a link. A pair is left
out only where links found before already connect it. The links connect nodes to
the final components in the same way.

A group of more than ``TILE`` nodes is first taken apart: texts on one template share
a bucket now and then, and such chance meetings join many of them. Two sets that link
share one of their first n / 4 + 1 shingles in any common order of shingles, and rare
ones come first here, so template passages bring nobody together. What still is above
``TILE`` is cut into slots of about that many, and every
two slots meet in a task of their own, so no task holds more than two slots; from a
task come only the links of a spanning forest.

Results: null text is empty text; a text without words has an empty set, is linked
with nothing and is its own component; a text of fewer words than a shingle has
its whole sequence as one; a row with a null id is counted but linked with
nothing, has no component, and is kept; rows that repeat an id have one component
each by their own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.stars import components
from provenir.llm.words import WordHashes, bounded_batches, hashed, mixed, shingle_hashes, slices, split
from provenir.session import cut, release

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 50, 5
#: Share of equal minima below which a pair is not confirmed: six standard deviations under 0.75.
SCREEN = 0.58
TILE = 256
#: Counters (a power of two) of shingles per group: they order the shingles, so that meeting in one only weakens the order.
COUNTERS = 1 << 20
#: 64-bit words of the bits that tell which ids may be members (4 MB, whatever the input): ids that share a bit only move a text in vain.
BIT_WORDS = 1 << 19

_RNG = np.random.default_rng(20240229)
#: The universal hashes x -> (a * x + b) mod 2**32, a odd.
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of minima per text with shingles [bounds[i], bounds[i + 1]); texts without any must be left out."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(_A), len(bounds) - 1), dtype=np.uint32)
    held = np.empty_like(x)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        np.multiply(x, a, out=held)
        np.add(held, b, out=held)
        np.minimum.reduceat(held, bounds[:-1], out=out[i])
    return out.T.copy()


def bands(signatures: np.ndarray) -> np.ndarray:
    """Bucket names: a 64-bit hash of each band's minima and number."""
    out = np.empty((len(signatures), BANDS), dtype=np.uint64)
    for i in range(BANDS):
        name = np.full(len(signatures), i + 1, dtype=np.uint64)
        for j in range(ROWS):
            name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + signatures[:, i * ROWS + j])
        out[:, i] = name
    return out


def _sets(batch: pa.RecordBatch, table: WordHashes) -> list[np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    flat, starts = hashed([split(t, True) for t in texts], table)
    hashes, bounds = shingle_hashes(flat, starts, SHINGLE)
    return [np.unique(hashes[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def sketched(rows: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, text_key): size and key of its set, and its buckets. Null key: empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(batch, table)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, buckets = [None] * len(sets), [None] * len(sets)
            if full:
                names = bands(minima(*_joined([sets[i] for i in full]))).view(np.int64)
                for k, i in enumerate(full):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    buckets[i] = names[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "buckets"])

    return rows.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, buckets array<bigint>")


def id_bits(ids: DataFrame) -> np.ndarray:
    """``BIT_WORDS`` words in which the bit of every doc_id of ``ids`` is set."""
    at = F.xxhash64("doc_id")
    words = ids.groupBy(F.shiftrightunsigned(at, 6).bitwiseAND(BIT_WORDS - 1).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(xxhash64(doc_id) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BIT_WORDS, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def with_id_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids``, and a few others: few texts go into the join that follows."""
    bits = rows.sparkSession.sparkContext.broadcast(id_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            word = bits.value[(at >> np.uint64(6)) & np.uint64(BIT_WORDS - 1)]
            yield batch.filter(pa.array(((word >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)))

    dealt = rows.withColumn("_at", F.xxhash64("doc_id"))
    return dealt.mapInArrow(run, dealt.schema).drop("_at")


def _with_sets(rows: DataFrame) -> DataFrame:
    """(group, node, text, tiles) to group, node, tiles, set and signature as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(batch, table)
            signatures = minima(*_joined(sets)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in signatures], pa.binary())],
                names=["group", "node", "slots", "shingles", "signature"])

    return rows.select("group", "node", "text", "slots").mapInArrow(run, "group long, node long, slots int, shingles binary, signature binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending, distinct) have 100 * intersection >= PERCENT * union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def forest(sets: list[np.ndarray], signatures: np.ndarray, split_at: int | None = None) -> list[tuple[int, int]]:
    """Confirmed links that connect all that confirmed pairs connect; with ``split_at``, of pairs across it only."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, least = [], SCREEN * signatures.shape[1]
    sizes = np.array([len(s) for s in sets])
    for i in range(len(sets) if split_at is None else split_at):
        first = i + 1 if split_at is None else split_at
        near = np.count_nonzero(signatures[first:] == signatures[i], axis=1)
        fit = (100 * np.minimum(sizes[first:], sizes[i]) >= PERCENT * np.maximum(sizes[first:], sizes[i])) & (near >= least)
        some = np.flatnonzero(fit)
        for j in some[np.argsort(-near[some], kind="stable")] + first:
            a, b = find(i), find(int(j))
            if a != b and alike(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def _confirm(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["slot", "node"], kind="stable").drop_duplicates("node")
    sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"]]
    signatures = np.array([np.frombuffer(s, dtype=np.uint16) for s in frame["signature"]])
    low = int((frame["slot"] == frame["slot"].min()).sum())
    pairs = forest(sets, signatures, None if frame["low"].iloc[0] == frame["high"].iloc[0] else low)
    nodes = frame["node"].to_numpy()
    return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")


def _counters(group: int, shingles: np.ndarray) -> np.ndarray:
    """The counter of each shingle in its group."""
    salt = mixed(np.array([group], dtype=np.int64).view(np.uint64) + np.uint64(1))
    return (mixed(shingles ^ salt) & np.uint64(COUNTERS - 1)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets of (group, shingles) hold a shingle of each counter: ``COUNTERS`` numbers, however many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for group, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(held, _counters(group, np.frombuffer(shingles, dtype=np.uint64)), 1)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["counter", "n"])

    found = sets.select("group", "shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def first_shingles(group: int, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set: as many as a set that links with it cannot all lack."""
    most = len(shingles) - -(-PERCENT * len(shingles) // 100) + 1
    return shingles[np.lexsort((shingles, counts[_counters(group, shingles)]))[:most]]


def taken_apart(sets: DataFrame) -> DataFrame:
    """``sets`` (group, node, slots, shingles, signature) by groups of nodes that first shingles connect; nodes that meet nobody are left out."""
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, nodes, sets_ = (batch.column(i).to_pylist() for i in range(3))
            if not nodes:
                continue
            first = [first_shingles(g, np.frombuffer(s, dtype=np.uint64), counts.value).view(np.int64) for g, s in zip(groups, sets_, strict=True)]
            sizes = [len(f) for f in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(groups, np.int64), sizes)), pa.array(np.repeat(np.array(nodes, np.int64), sizes)), pa.array(np.concatenate(first))],
                names=["group", "node", "shingle"])

    entries = cut(sets.select("group", "node", "shingles").mapInArrow(run, "group long, node long, shingle long"), "minhash-first")
    shared = entries.groupBy("group", "shingle").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("other > center").drop("other")
    stars = entries.join(shared, ["group", "shingle"]).filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    apart = cut(components(stars), "minhash-apart")
    sizes = apart.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("slots"))
    placed = apart.join(sizes, "component").select("node", F.col("component").alias("group"), "slots")
    out = cut(sets.select("node", "shingles", "signature").join(placed, "node").select("group", "node", "slots", "shingles", "signature"), "minhash-regrouped")
    release(entries, apart)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (digest of the text) of every row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.withColumn("text_key", F.md5("text"))
    bounded_batches(docs.sparkSession)
    sketches = cut(sketched(rows), "minhash-sketches")
    # One node per distinct set, stood for by its smallest document.
    known = sketches.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    nodes = cut(known.select("set_key", "first.doc_id", "first.text_key", F.monotonically_increasing_id().alias("node")), "minhash-nodes")
    named = nodes.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "node")
    stand = (F.col("doc_id") == F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    entries = cut(sketches.filter("set_key IS NOT NULL").join(named, stand).select("node", F.explode("buckets").alias("bucket")), "minhash-entries")
    keys = cut(sketches.select("doc_id", "text_key", "n_shingles", "set_key"), "minhash-keys")
    release(sketches)
    shared = cut(entries.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("other > center").select("bucket", "center"), "minhash-shared")
    stars = entries.join(shared, "bucket").filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    groups = cut(components(stars), "minhash-groups")
    release(entries, shared)
    sizes = cut(groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("slots")), "minhash-sizes")
    members = groups.join(sizes, "component").join(named, "node").select("node", F.col("component").alias("group"), "slots", "own_id", "own_key")
    members = cut(members, "minhash-members")
    wanted = with_id_among(texts, members.select(F.col("own_id").alias("doc_id"))).withColumn("text_key", F.md5("text"))
    sets = cut(_with_sets(wanted.join(members, (F.col("doc_id") == F.col("own_id")) & (F.col("text_key") == F.col("own_key")))), "minhash-sets")
    held = [sets]
    if not sizes.filter("slots > 1").isEmpty():
        held.append(taken_apart(sets.filter("slots > 1")))
        sets = sets.filter("slots = 1").unionByName(held[1])
    slot = F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")
    # Slot s meets every slot: the tile of (low, high) gets the nodes of both.
    tiles = sets.withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    tiles = tiles.select("group", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "node", "shingles", "signature")
    links = cut(tiles.groupBy("group", "low", "high").applyInPandas(_confirm, "a long, b long"), "minhash-links")
    linked = cut(components(links), "minhash-linked")
    ends = linked.join(nodes.select("node", F.col("doc_id").alias("own_id")), "node")
    least = ends.groupBy("component").agg(F.min("own_id").alias("component_id"))
    found = ends.join(least, "component").select("node", "component_id")
    by_set = cut(nodes.join(found, "node", "left").select("set_key", F.coalesce("component_id", "doc_id").alias("component_id")), "minhash-found")
    release(groups, sizes, members, *held, links, linked, nodes)
    out = keys.join(by_set, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_key")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), "text_key")
