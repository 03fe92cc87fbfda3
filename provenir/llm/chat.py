"""Chat formatting at token level, with a loss mask over the assistant's texts.

Each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role and text are encoded as
segments of their own and the two marks are spliced in as reserved ids above the
vocabulary, so no text can make one. The marks also occur in the printed form, so
inside texts every ``<``, backslashes, ``|`` gets one more backslash, which leaves
no ``<|`` and is undone exactly. The loss mask is the running sum of +1 at the
start and -1 at the end of every assistant text.

A conversation is stored as chunks of ids and mask in shared files, with an index
of pointers (conversation, chunk, file, place). Turns are dealt out by range of
(conversation, turn, role, start of the text, digest of the text), so a conversation
of any length is spread over tasks and range bounds, which hold no whole texts, keep
its order; only its running digest is taken in one place, which follows pointers and
streams.

Results: a null text or role is empty; turns of equal number go by role, then by the
first ``TIE_CHARS`` characters of the text, then by the text's SHA-256; null ids are one conversation; rows that repeat are turns of their own; an
empty table gives an empty index. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.blobs import BlobWriter, RangeReader, read_tasks
from provenir.llm.bpe import Vocabulary
from provenir.llm.words import bounded_batches
from provenir.session import cut, scratch_path

START, END = "<|im_start|>", "<|im_end|>"
#: Ids of a chunk before it is written and another begun.
CHUNK_IDS = 1 << 18
#: Characters of a text that order turns of equal number and role before its digest does.
TIE_CHARS = 200
INDEX = "conv_id long, chunk long, file string, offset long, n_ids long, n_turns long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Assembler:
    """Ids and mask of turns; the marks are the two ids above the vocabulary."""

    def __init__(self, encoder):
        self.encoder = encoder
        self.start = max(encoder.token) + 1
        self.end = self.start + 1
        self._line = encoder.encode("\n")

    def turn(self, role: str, text: str, learned: bool) -> tuple[bytes, np.ndarray]:
        mark = lambda i: np.array([i], dtype="<u4").tobytes()
        before = mark(self.start) + self.encoder.encode(escape_role(role) + "\n")
        body = self.encoder.encode(escape(text))
        ids = before + body + mark(self.end) + self._line
        steps = np.zeros(len(ids) // 4 + 1, dtype=np.int8)
        if learned:
            steps[len(before) // 4] += 1
            steps[(len(before) + len(body)) // 4] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8).astype(np.uint8)

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """Back from ids and mask: role, text, text under the mask, printed characters."""
        starts, ends = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        stops = [*starts[1:].tolist(), len(ids)]
        plain = lambda x: self.encoder.decode(x.astype("<u4").tobytes()).decode("utf-8")
        for a, z, stop in zip(starts.tolist(), ends.tolist(), stops, strict=True):
            role, _, body = plain(ids[a + 1 : z]).partition("\n")
            under = unescape(plain(ids[a:z][mask[a:z] > 0])) if mask[a:z].any() else ""
            tail = plain(ids[z + 1 : stop])
            yield unescape_role(role), unescape(body), under, len(START) + len(role) + 1 + len(body) + len(END) + len(tail)


def format_conversations(rows: DataFrame, vocabulary: Vocabulary, learned_role: str = "assistant", conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Writes ids and masks into the shared scratch folder; returns the written index of chunks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    # The bounds are sampled rows of keys alone: no key is as long as a text. The row number parts only turns that are alike.
    keys = ["conv_id", "turn", "role", "start", "digest", "row"]
    start, digest = F.substring("text", 1, TIE_CHARS), F.sha2("text", 256)
    dealt = (
        turns.withColumns({"start": start, "digest": digest, "row": F.monotonically_increasing_id()})
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "role", "text")
    )
    folder = scratch_path(rows.sparkSession, "chat")
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, writer = Assembler(vocabulary.encoder()), BlobWriter(folder, ".ids")
        now, seq, ids, masks, turns_held = object(), 0, [], [], 0

        def flushed(part: int) -> list[dict]:
            nonlocal seq, ids, masks, turns_held
            if not ids:
                return []
            body = b"".join(ids)
            file, offset, _ = writer.put(body + np.concatenate(masks).tobytes())
            row = {"conv_id": now, "chunk": (part << 32) + seq, "file": file, "offset": offset, "n_ids": len(body) // 4, "n_turns": turns_held}
            seq, ids, masks, turns_held = seq + 1, [], [], 0
            return [row]

        part, held = 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                part = r["part"]
                if r["conv_id"] != now or held >= CHUNK_IDS:
                    out += flushed(part)
                    now, held = r["conv_id"], 0
                a, m = make.turn(r["role"], r["text"], r["role"] == learned_role)
                ids.append(a)
                masks.append(m)
                turns_held += 1
                held += len(m)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if out := flushed(part):
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        writer.close()

    bounded_batches(rows.sparkSession)
    return cut(dealt.mapInArrow(run, INDEX), "chat-index")


def read_digests(index: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per conversation, from the stored ids and masks: turns, digests and counts."""
    places = index.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "file", "offset", "n_ids"))).alias("chunks"))
    first = F.col("chunks")[0]
    # Five bytes for each id and its mask.
    tasks = read_tasks(index.agg(F.sum(5 * F.col("n_ids"))).first()[0])
    dealt = places.repartitionByRange(tasks, first["file"], first["offset"]).sortWithinPartitions(first["file"], first["offset"])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, reader = Assembler(vocabulary.encoder()), RangeReader()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns, loss, n, under, printed = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for c in r["chunks"]:
                    data = reader.get(c["file"], c["offset"], 5 * c["n_ids"])
                    ids, mask = np.frombuffer(data[: 4 * c["n_ids"]], "<u4"), np.frombuffer(data[4 * c["n_ids"] :], np.uint8)
                    for role, text, learned, chars in make.turns(ids, mask):
                        turns.update(f"{role}\n{text}\n".encode())
                        loss.update(learned.encode())
                        n, under, printed = n + 1, under + len(learned), printed + chars
                out.append({"conv_id": r["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": under,
                            "loss_sha256": loss.hexdigest(), "formatted_chars": printed})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        reader.close()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
