"""Encoding against the tiktoken library, edits and appends against encoding anew."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OURS = bpe.Encoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst the\n  '.,!0123äßжи")), max_size=80)


def ids_of(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_ids_as_the_library(text):
    ids = OURS.encode(text)
    assert ids_of(ids) == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, " " * 999 + "x", "\u00e4" * 700, "0" * 500, "\U0001f600" * 50, "x\ud7ff\n\n\n y"])
def test_long_runs(text):
    assert ids_of(OURS.encode(text)) == THEIRS.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20), st.data())
def test_prefix_table_under_appends_and_edits(data, new, draw):
    table = OURS.prefixes(data)
    table.append(new)
    assert table.last == OURS.prefixes(data + new).last
    start = draw.draw(st.integers(0, len(table.data)))
    end = draw.draw(st.integers(start, len(table.data)))
    whole = table.data[:start] + new + table.data[end:]
    table.replace(start, end, new)
    assert (table.data, table.last) == (whole, OURS.prefixes(whole).last)


def test_prefix_table_meets_the_old_one_again():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdefghij ") for _ in range(4000))
    table = OURS.prefixes(data)
    table.replace(1000, 1010, b"xyz")
    assert table.last == OURS.prefixes(data[:1000] + b"xyz" + data[1010:]).last


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS, st.data())
def test_text_under_edits(text, new, draw):
    held = bpe.EditableText(OURS, text)
    start = draw.draw(st.integers(0, len(text)))
    end = draw.draw(st.integers(start, len(text)))
    held.replace(start, end, new)
    assert held.text == text[:start] + new + text[end:]
    assert ids_of(held.ids()) == THEIRS.encode_ordinary(held.text)


def test_frames(spark):
    known = bpe.Vocabulary(spark, PATH, P.PATTERN)
    rows = [(1, "Hello  wörld\n", "x"), (2, None, "y"), (3, "", None), (1, "Hello  wörld\n", "x"), (None, "a" * 50_000, "ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode_ids(bpe.encode_texts(df, known), known).collect()
    assert len(got) == 5 and all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert ids_of(bytes(got[0].ids)) == THEIRS.encode_ordinary("Hello  wörld\n")
    assert bpe.encode_texts(df.filter("doc_id > 9"), known).count() == 0


def test_query_against_the_library(spark, sf_dir):
    import hashlib

    from provenir.llm.queries import op1_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = THEIRS.encode_ordinary(texts[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ranks_are_read(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 0\n")
    assert bpe.read_ranks(str(tmp_path / "r")) == {b"a": 0}
