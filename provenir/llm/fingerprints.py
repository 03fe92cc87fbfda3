"""Document fingerprints: the k smallest distinct hashes of a text's word shingles.

The k smallest hashes of two parts' fingerprints together are the fingerprint of
both parts, so fingerprints merge in any order. Of two fingerprints, the share of
the k smallest hashes of both that are in each estimates the resemblance; the
place of the kth hash in its range estimates the number of distinct shingles; the
two together estimate containment. A text with at most k shingles has them all,
and its figures are exact.

Results: null text is empty text; a text without words has the empty fingerprint,
which is like itself (1) and like nothing else (0); equal texts have equal
fingerprints; a text of fewer words than a shingle has its whole sequence as one;
rows that repeat or share an id follow each other by text; a null id comes first;
an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.words import WordHashes, bounded_batches, hashed, shingle_hashes, slices, split

SHINGLE = 5
SIZE = 128
_SPACE = float(1 << 64)


def bottom(texts: list[str | bytes | None], table: WordHashes, shingle: int = SHINGLE, size: int = SIZE) -> list[np.ndarray]:
    """Per text, the ``size`` smallest distinct hashes of its shingles, ascending."""
    flat, starts = hashed([split(t, True) for t in texts], table)
    hashes, bounds = shingle_hashes(flat, starts, shingle)
    return [np.unique(hashes[a:z])[:size] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def merged(parts: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:size] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if len(both) else 1.0


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    return float(len(a)) if len(a) < size else (size - 1) * _SPACE / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that are in b: resemblance times union over a's count."""
    own = distinct(a, size)
    return min(1.0, resemblance(a, b, size) * distinct(merged([a, b], size), size) / own) if own else 1.0


def printed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """``key`` and ``fingerprint`` (ascending array of hashes as longs) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, text):
            found = bottom(batch.column(batch.schema.get_field_index(text)).to_pylist(), table, shingle, size)
            hashes = pa.array([f.view(np.int64) for f in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), hashes], names=[key, "fingerprint"])

    bounded_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint array<bigint>")


def merge(prints: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """One fingerprint per ``key``: merged inside every partition first, then over partitions."""
    kind = prints.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, fingerprint array<bigint>"

    def joined(frame: pd.DataFrame) -> np.ndarray:
        return merged([np.asarray(f, dtype=np.int64).view(np.uint64) for f in frame["fingerprint"]], size).view(np.int64)

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for name, group in frame.groupby(key, dropna=False):
                now = pd.DataFrame({"fingerprint": [joined(group), *([held[name]] if name in held else [])]})
                held[name] = joined(now)
                if len(held) > 50_000:
                    yield pd.DataFrame({key: list(held), "fingerprint": list(held.values())})
                    held = {}
        yield pd.DataFrame({key: list(held), "fingerprint": list(held.values())})

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [frame[key].iloc[0]], "fingerprint": [joined(frame)]})

    return prints.select(key, "fingerprint").mapInPandas(inside, ddl).groupBy(key).applyInPandas(over, ddl)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _beside_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents dealt out by range of id, each part in order and ended by the first document of the next part.

    Bounds come from quantiles of the ids alone, and the first id of each part from a
    minimum per part; both are as many as there are parts. Only whole rows are
    shuffled, once. The last part ends with the first document of all.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    steps = [i / parts for i in range(1, parts)] or [0.5]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", steps, 100 * parts)).first()[0] or [], dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(ids.isna(), 0, found).astype("int32"))

    placed = rows.withColumn("part", part_of("doc_id"))
    least = F.coalesce(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")))
    firsts = sorted((r.part, r.least.doc_id) for r in placed.groupBy("part").agg(least.alias("least")).collect())
    before = [(p, i, firsts[k - 1][0]) for k, (p, i) in enumerate(firsts)] or [(0, None, 0)]
    heads = spark.createDataFrame(before, "part int, first_id long, before int")
    joined = placed.join(F.broadcast(heads), "part")
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("last"))
    also = F.struct(F.col("before").alias("to"), F.lit(True).alias("last"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, also)).otherwise(F.array(own))
    dealt = joined.select("doc_id", "text", F.explode(copies).alias("copy")).select("copy.to", "copy.last", "doc_id", "text")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("to")).sortWithinPartitions("to", "last", "doc_id", "text")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, ended = WordHashes(), None, False
        for batch in slices(batches, "text"):
            if ended:
                continue
            rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "last")), strict=True))
            rows = [held, *rows] if held else rows
            own = [r for r in rows if not r[2]]
            ended = len(own) < len(rows)
            if not ended:
                held = own.pop()
            if not own:
                continue
            texts = [t for _, t, _ in rows[: len(own) + 1]]
            changed = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
            known, new = bottom(texts, table, shingle, size), bottom(changed, table, shingle, size)
            out = [(i, len(t), hashlib.sha256(c.encode()).hexdigest(), printed(k), printed(e), resemblance(k, e, size), resemblance(k, n, size))
                   for (i, t, _), c, k, n, e in zip(own, changed, known, known[1:], new, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    bounded_batches(docs.sparkSession)
    return _beside_next(docs, doc_id, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated resemblance of two fingerprint arrays, as a column expression (unsigned order)."""
    flip = F.lit(-(1 << 63))
    up = lambda c: F.transform(c, lambda x: x.bitwiseXOR(flip))
    both = F.slice(F.array_sort(F.array_union(up(a), up(b))), 1, size)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(up(a), up(b)))) / F.size(both))

