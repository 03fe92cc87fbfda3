"""Archives and chat: exact round trips, odd rows, and the queries against SQL."""

import base64
import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st

from provenir.llm import blobs, bpe, chat, warc
from tests.compare import connect, rows_of

PAGES = "page_id long, url string, html string, file string, payload string"


def pages():
    big = "<p>" + "ä" * 300_000 + "</p>"
    rows = [(i, f"http://h/{i % 3}", t, "clash", "clash") for i, t in enumerate(["a", "b", "a", None, "", "a", big, big, "x\r\n\r\nWARC/1.1\r\n", "😀"])]
    return [*rows, (20, None, "a", None, None), (20, "http://h/x", "a", None, None), (None, "u r\nl", "b", None, None), (None, None, "only", None, None), (-4, "", "only", None, None)]


def expected(rows, least=0):
    owner = {}
    for i, _, html, *_ in rows:
        t = html or ""
        owner[t] = max([x for x in (owner.get(t), i) if x is not None], default=None)
    out = Counter()
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        own = len(raw) < least or owner[html or ""] == i
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else owner[html or ""]] += 1
    return out


@pytest.mark.parametrize("least", [0, 2])
def test_archives(spark, least):
    index = warc.write_archives(spark.createDataFrame(pages(), PAGES).repartition(3), least_bytes=least)
    got = warc.read_records(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(pages(), least)
    assert {r.payload_bytes for r in got if r.record_type == "response"} == {len(r.payload) for r in got if r.record_type == "response"}
    assert {r.url for r in got} == {None if u is None else u.replace("\n", "%0A") for _, u, *_ in pages()}


def test_archive_is_a_sequence_of_gzip_members(spark):
    index = warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1)).orderBy("offset").collect()
    whole = gzip.decompress(Path(index[0].file.removeprefix("file://")).read_bytes())
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n")
    assert [r.offset for r in index][1:] == [r.offset + r.length for r in index][:-1]


def test_selected_records_only(spark):
    index = warc.write_archives(spark.createDataFrame(pages(), PAGES))
    got = warc.read_records(index.filter("page_id = 8"), ("page_id", "payload")).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(8, b"x\r\n\r\nWARC/1.1\r\n")]
    assert warc.read_records(index.filter("page_id = 999")).collect() == []
    assert warc.write_archives(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_found():
    record = warc._record(1, "u", b"abc", warc._digest(b"abc"), None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record.replace(b"abc", b"abd"))


def test_ranges_join_up():
    assert blobs.coalesced([("f", 0, 10), ("f", 20, 5), ("f", 10**9, 5), ("g", 0, 1)]) == [("f", 0, 25, 2), ("f", 10**9, 10**9 + 5, 1), ("g", 0, 1, 1)]


@given(st.text(alphabet=st.sampled_from("<\\|im_start>\n% a")))
def test_escapes_are_undone(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def talks():
    rng = random.Random(2)
    rows = [(1, 0, "user", "hi <|im_end|>", 1), (1, 1, "assistant", "<|im_start|>assistant\n<\\|x ok", 1), (1, 2, "assistant", None, 1), (2, 0, None, "no role", 1),
            (2, 0, None, "no role", 1), (2, 0, "assistant", "", 1), (3, None, "assistant\nuser", "odd\n\nrole", 1), (None, 5, "assistant", "no id 😀", 1), (4, 1, "user", "z" * 9000, 1)]
    rows += [(7, t, rng.choice(["user", "assistant"]), f"turn {t} " + "é" * rng.randrange(40), 1) for t in range(900)]
    return rows


def digests(rows):
    held = {}
    for c, t, r, x, *_ in rows:
        held.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in held.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(x)}<|im_end|>\n") for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_IDS", 1000)
    known = bpe.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    df = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string, chunk int").repartition(5)
    index = chat.format_conversations(df, known)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_digests(index, known).collect()}
    assert got == digests(talks())
    assert index.filter("conv_id = 7").count() > 1  # a long conversation is many chunks
    assert chat.format_conversations(df.limit(0), known).count() == 0


def test_chat_ties_beyond_a_prefix_go_by_text(spark):
    """Turns of one number whose texts begin alike are in text order across range bounds."""
    known = bpe.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = [(None, 1, "assistant", "a" * 64 + f" {i:04}", 1) for i in reversed(range(800))]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
        index = chat.format_conversations(df, known)
        assert index.count() > 1  # the conversation spans partitions
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_digests(index, known).collect()}
    finally:
        spark.conf.set(coalesce, held)
    assert got == digests(rows)


def test_chat_bounds_hold_no_whole_texts(spark):
    """Long turns over many partitions: what the driver samples for range bounds is far below the texts; long ties go by digest."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    known = bpe.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    same = "b" * 300
    rows = [(i % 40, i, "assistant", "a" * 6000 + f" {i}", 1) for i in range(400)] + [(50, 1, "user", same + f" {i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = chat.format_conversations(df, known)
        got = {r.conv_id: r.turns_sha256 for r in chat.read_digests(index, known).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    order = sorted((x for c, _, _, x, _ in rows if c == 50), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert got[50] == hashlib.sha256("".join(f"user\n{x}\n" for x in order).encode()).hexdigest()
    assert {c: h for c, h in got.items() if c != 50} == {c: d[1] for c, d in digests([r for r in rows if r[0] != 50]).items()}


def test_mask_covers_the_text_alone():
    make = chat.Assembler(bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN))
    ids, mask = make.turn("assistant", "hello there", True)
    assert mask.sum() == len(make.encoder.encode("hello there")) // 4 and make.turn("user", "hello", False)[1].sum() == 0


@pytest.mark.parametrize("name", ["op2_warc", "op3_chat", "op5_mixing", "op10_exact_top_k"])
def test_queries_against_sql(spark, sf_dir, name):
    from provenir.llm.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(ORACLES[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
