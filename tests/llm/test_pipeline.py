"""The pipeline's stages against plain versions of each, on whole small tables and on odd rows."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from provenir.llm import bpe, mixing, toxicity
from provenir.session import cut
from tests.llm.rows import documents, words
from tests.llm.test_duplicates import components, removed

THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def plain(df):
    return Counter(tuple(r) for r in df.select(*pipeline.COLUMNS).collect())


def small_tables(spark, tmp_path):
    rows = [(r[0], r[1], "en", r[2], len(r[1] or "")) for r in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("where", ["given", "odd"])
def test_stages(spark, sf_dir, tmp_path, where):
    folder = sf_dir if where == "given" else small_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "substrings", "mixing", "byte_bpe"]

    clean = cut(steps["toxicity"](spark, docs, folder))
    marks = toxicity.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert plain(clean) == plain(marks.filter("score < 0.3")) and clean.columns == list(pipeline.COLUMNS)

    single = cut(steps["near_duplicates"](spark, clean, folder))
    rows = [tuple(r) for r in clean.select(*pipeline.COLUMNS).collect()]
    kept = {k[0] for k in components([(r[0], r[1]) for r in rows]) if k[3]}
    want = Counter(r for r in rows if r[0] is None) + Counter({r for r in rows if r[0] is not None and r[0] in kept})
    assert sum(plain(single).values()) <= sum(want.values()) and set(plain(single)) <= set(want)
    assert {r[0] for r in plain(single)} == {r[0] for r in want}

    shorter = cut(steps["substrings"](spark, single, folder))
    rows = [tuple(r) for r in single.select(*pipeline.COLUMNS).collect()]
    want = Counter()
    for r, (_, gone, text) in zip(rows, removed([r[1] for r in rows]), strict=True):
        new = text if gone else r[1]
        want[r[0], new, r[2], r[3], None if new is None else len(new)] += 1
    assert plain(shorter) == want

    mixed = cut(steps["mixing"](spark, shorter, folder))
    want = Counter()
    for r in mixing.mix(shorter).collect():
        if r.size and (times := int(r.taken / r.size + 0.5)):
            want[r.doc_id, r.size] += times
    assert Counter((r[0], len(words(r[1]))) for r in plain(mixed).elements()) == want

    last = steps["byte_bpe"](spark, mixed, folder).collect()
    want = Counter()
    for (i, text, _, source, _), n in plain(mixed).items():
        ids = THEIRS.encode_ordinary(text or "")
        want[i, source, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()] += n
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in last) == want


def test_training_order_reaches_the_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*pipeline.COLUMNS)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        mixed = cut(pipeline.mixed(spark, docs, sf_dir))
    finally:
        spark.conf.set(coalesce, held)
    assert len(mixed.inputFiles()) > 1
    want = [r.doc_id for file in sorted(mixed.inputFiles()) for r in spark.read.parquet(file).collect()]
    got = sorted((r.position, r.doc_id) for r in pipeline.encoded(spark, mixed, sf_dir).select("position", "doc_id").collect())
    assert [p for p, _ in got] == list(range(len(want))) and [i for _, i in got] == want


def test_rows_alike_in_text_keep_their_columns(spark, sf_dir):
    """Rows without id and of equal text are taken under their own source and language."""
    rows = [(None, "one two three four", lang, source, n) for lang, source, n in [("en", "s", 1), ("de", "t", 2), (None, None, None), ("en", None, 3)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = plain(pipeline.mixed(spark, docs, sf_dir))
    words_of = Counter()
    for (_, _, _, source, _), n in found.items():
        words_of[source] += 4 * n
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += 4 * int(r.taken / 4 + 0.5)
    assert set(found) == set(rows) and words_of == taken


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.count() == 0


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
