"""A training corpus from raw documents: five stages, each written and read again.

Toxic documents go, then all but one of each group of near-duplicates, then
passages that repeat across the rest; what stays is mixed to the source weights in
training order and encoded. All but the last stage return the columns of
documents; the last numbers the rows by their place in the training order, which the
files it reads have kept. Every stage works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.llm import bpe, minhash, mixing, substrings, toxicity
from provenir.llm.queries import vocabulary
from provenir.session import cut, cut_counted

#: Files up to which their offsets (a row of some 100 bytes each) are broadcast.
MAX_BROADCAST_FILES = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic; a null text is scored as an empty one, repeated rows get equal scores."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.classify(docs.select(*COLUMNS), labels)
    return scored.filter("predicted = 0").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id; of rows alike in id and text, one. Rows without id stay."""
    found = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL")
    kept = cut(found.select("doc_id", "text_key").distinct(), "pipeline-kept")
    rows = docs.select(*COLUMNS).withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    chosen = rows.join(kept, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    return chosen.unionByName(rows.filter("doc_id IS NULL")).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that repeat; a text that loses none, null and empty ones too, stays as it is.

    Of a passage that repeats no copy stays, as windows are judged on the input; rows that repeat lose theirs alike.
    """
    found = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, as often as the positions of their source's weight schedule fall into the training.

    Documents without words are never taken, a null source is a source of its own, rows that repeat have passes of their own.
    """
    rows = docs.select(*COLUMNS)
    return mixing.training_order(rows, mixing.mix(rows)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's whole text: their number, digest and little-endian bytes; ``position``: its place in training order.

    ``docs`` is read from files: Spark reads them in any order, but names and rows in them keep the order of writing.
    A null text has no ids; columns that ``docs`` has besides are not read.
    """
    placed = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row per file; a part's number grows beyond the five digits that names are padded to.
    files = docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    part = F.coalesce(F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long"), F.lit(-1))
    ahead = F.sum("n").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1))
    offsets, n_files = cut_counted(files.select("file", F.coalesce(ahead, F.lit(0)).alias("offset")), "pipeline-offsets")
    few = n_files <= MAX_BROADCAST_FILES
    numbered = placed.join(F.broadcast(offsets) if few else offsets, "file").select("doc_id", "source", "text", (F.col("offset") + F.col("row")).alias("position"))
    found = bpe.encode_texts(numbered, vocabulary(spark))
    return found.select("position", "doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: The classifier and the encoder have no SQL form; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
