"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled texts: those that
occur in many more toxic texts than others, by a smoothed log-odds ratio. The
trees read densities of lexicon words, how often a second-person pronoun stands
near one, capitals, punctuation and disguised spellings, and never the labels,
language, source or id of a text. The labelled rows of each label are dealt in the
order of a digest of their id into three folds. A labelled row is measured with a lexicon learned on the other
two folds, the trees are fitted on two of the folds so measured and the calibration
on the third; other rows are measured with the lexicon of all three.

``FIT_ROWS`` bounds the labelled rows used for fitting: beyond it shares of them are
taken by digest, per label, so that the rarer label has up to half of the places, and
weights restore the labels' rate. Scoring covers every row and the whole text.

Results: a null text is an empty text and is scored; labels that are null or have
no id are left out, and of an id's labels the highest counts; a null id is not
held out; rows that repeat get equal scores; where a label has fewer rows than there
are folds, all rows fit lexicon and trees and the trees' probability is the score; where
no row has one of the labels, every score is the rate of label 1 (0 without labels); an
empty table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.toxic_features import FEATURES, bare, measures, terms
from provenir.llm.words import bounded_batches, slices, split
from provenir.session import cut, release

FIT_ROWS = 20_000
LEXICON_TERMS = 2_000
#: A lexicon term occurs in at least so many toxic texts of its fold, and so many times more often in them.
LEAST_TEXTS, LEAST_RATIO = 3, 6.0
FOLDS = 3
THRESHOLD = 0.3


def measured(lexicons: list[dict[bytes, float]]) -> Callable[..., Column]:
    """A column function of text and fold: ``FEATURES`` taken with the lexicon of that number.

    Only the text and the fold go to Python and only numbers come back; the other
    columns of a row stay where they are.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kept: list[dict] = [{} for _ in lexicons]
        for texts, folds in batches:
            rows = pa.RecordBatch.from_arrays([texts, folds], names=["text", "fold"])
            parts = [pa.array([measures(t, lexicons[k], kept[k]) for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)],
                              type=pa.list_(pa.float64())) for b in slices(iter([rows]), "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.float64()))

    return run


def learn_lexicons(labelled: DataFrame, most: int = LEXICON_TERMS) -> list[dict[bytes, float]]:
    """Log-odds of the terms that mark toxic texts, without each fold in turn, then with all.

    ``labelled``: text, toxic, fold. At most ``most`` rows of each lexicon reach the driver.
    """
    cells = [f"{'toxic' if y else 'clean'}_{k}" for k in range(FOLDS) for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [Counter() for _ in cells]
            for t, y, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts[2 * k + y].update({x for w in set(bare(split(t, True))) if w for x in terms(w)})
            every = list(set().union(*counts))
            columns = [pa.array([c.get(t, 0) for t in every], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *columns], names=["term", *cells])

    sizes = {(r.fold, r.toxic): r["count"] for r in labelled.groupBy("fold", "toxic").count().collect()}
    counted = labelled.select("text", "toxic", "fold").mapInArrow(run, ", ".join(["term binary", *(f"{c} long" for c in cells)])).groupBy("term").agg(
        *[F.sum(c).alias(c) for c in cells]).filter(" + ".join(f"toxic_{k}" for k in range(FOLDS)) + f" >= {LEAST_TEXTS}")
    counted, out = cut(counted, "toxicity-terms"), []
    for without in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != without]
        n = [sum(sizes.get((k, y), 0) for k in folds) for y in (0, 1)]
        clean, toxic = (sum((F.col(f"{name}_{k}") for k in folds), F.lit(0)) for name in ("clean", "toxic"))
        odds = F.log((toxic + 0.5) / (n[1] + 1.0)) - F.log((clean + 0.5) / (n[0] + 1.0))
        good = counted.select("term", toxic.alias("toxic"), odds.alias("odds")).filter((F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= math.log(LEAST_RATIO)))
        rows = good.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(most).select("term", "odds").collect()
        out.append({bytes(r.term): r.odds for r in rows})
    release(counted)
    return out


def fit_rows(labels: DataFrame, trained: Column, doc_id: str = "doc_id", label: str = "toxic", most: int = FIT_ROWS) -> DataFrame:
    """fit_id, toxic, fold (0 to 2) and weight of at most about ``most`` of the labelled rows that may be trained on.

    The rarer label keeps up to half of ``most``, the other what is left; a row's weight is the number of
    labelled rows that it stands for.
    """
    known = labels.select(F.col(doc_id).alias("fit_id"), F.col(label).cast("int").alias("toxic")).filter("fit_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.withColumn("trained", trained_on(trained, "fit_id")).filter("trained").groupBy("fit_id").agg(F.max("toxic").alias("toxic"))
    found = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    rare = min(found, key=lambda y: (found[y], y), default=None)
    places = {y: max(most // 2, most - sum(n for x, n in found.items() if x != y)) for y in found}
    places = {y: min(found[y], places[y] if y == rare else most - min(found[rare], places[rare])) for y in found}
    digest = F.md5(F.col("fit_id").cast("string"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.lit(0.0)
    for y, n in found.items():
        share = F.when(F.col("toxic") == y, places[y] / n).otherwise(share)
    # At most about ``most`` rows are left for the window.
    dealt = Window.partitionBy("toxic").orderBy(F.substring(digest, 9, 24), "fit_id")
    return known.withColumn("share", share).filter(place < F.col("share")).select(
        "fit_id", "toxic", ((F.row_number().over(dealt) - 1) % FOLDS).cast("int").alias("fold"), F.try_divide(F.lit(1.0), F.col("share")).alias("weight"))


def trained_on(rule: Column | None, name: str) -> Column:
    """The default rule: rows whose crc32 of the id as text, modulo 4, is not 2."""
    return rule if rule is not None else ~held_out(name)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


class Model:
    """Lexicon, trees and calibration; ``score`` adds a double column ``score`` to every row."""

    def __init__(self, rate: float, lexicon: dict[bytes, float] | None = None, trees=None, calibration=None):
        self.rate, self.lexicon, self.trees, self.calibration = rate, lexicon or {}, trees, calibration

    def raw(self, df: DataFrame, text: str) -> DataFrame:
        """``row`` (all columns of ``df`` as a struct, whatever their names) and ``raw_score``, the trees' probability."""
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
        taken = df.select(row, measured([self.lexicon])(F.col(f"`{text}`"), F.lit(0)).alias("measures"))
        parts = taken.select("row", *[F.col("measures")[i].alias(f"m_{i}") for i in range(len(FEATURES))])
        vectors = VectorAssembler(inputCols=[f"m_{i}" for i in range(len(FEATURES))], outputCol="m_all").transform(parts)
        return self.trees.transform(vectors.select("row", "m_all")).select("row", vector_to_array("probability")[1].alias("raw_score"))

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        if self.trees is None:
            return df.withColumn("score", F.lit(self.rate))
        edges, values = self.calibration
        step = F.lit(values[0])
        for (a, x), (b, y) in zip(zip(edges, values, strict=True), list(zip(edges, values, strict=True))[1:], strict=False):
            part = F.when(F.lit(b) > a, (F.col("raw_score") - a) / (b - a if b > a else 1.0)).otherwise(1.0)
            step = F.when(F.col("raw_score") >= a, x + (y - x) * F.least(F.lit(1.0), part)).otherwise(step)
        # A little of the raw score keeps the order inside the flat steps of the calibration.
        mixed = 0.99 * step + 0.01 * F.col("raw_score")
        return self.raw(df, text).select(*[F.col("row")[c].alias(c) for c in df.columns if c != "score"], mixed.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, trained: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        most: int = FIT_ROWS, rounds: int = 20, depth: int = 3) -> Model:
    """Learns from the labelled rows of ``docs`` whose id is trained on."""
    rows = fit_rows(labels, trained, most=most)
    # At most about ``most`` rows of (id, label, fold, weight): a few hundred kB.
    fitted = cut(docs.select(F.col(doc_id).alias("fit_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
                 .join(F.broadcast(rows), "fit_id").select("text", "toxic", "fold", "weight"), "toxicity-fit")
    found = {(r.fold, r.toxic): r.weight for r in fitted.groupBy("fold", "toxic").agg(F.sum("weight").alias("weight")).collect()}
    total = sum(found.values())
    rate = sum(n for (_, y), n in found.items() if y == 1) / total if total else 0.0
    if not 0 < rate < 1:
        release(fitted)
        return Model(rate)
    # With too few rows of a label for a part of its own in each fold, all rows fit everything.
    whole = any((fold, y) not in found for fold in range(FOLDS) for y in (0, 1))
    lexicons = learn_lexicons(fitted)
    lexicon_of = F.lit(FOLDS) if whole else F.col("fold")
    taken = cut(fitted.select("toxic", "fold", "weight", measured(lexicons)("text", lexicon_of).alias("measures")), "toxicity-measures")
    parts = taken.coalesce(4).select(F.col("toxic").cast("double").alias("label"), "fold", "weight", *[F.col("measures")[i].alias(f"m_{i}") for i in range(len(FEATURES))])
    vectors = VectorAssembler(inputCols=[f"m_{i}" for i in range(len(FEATURES))], outputCol="m_all").transform(parts).select("label", "fold", "weight", "m_all")
    learner = GBTClassifier(featuresCol="m_all", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7)
    trees = learner.fit(vectors if whole else vectors.filter("fold > 0"))
    if whole:
        release(fitted, taken)
        return Model(rate, lexicons[-1], trees, ([0.0, 1.0], [0.0, 1.0]))
    held = trees.transform(vectors.filter("fold = 0")).select("label", "weight", vector_to_array("probability")[1].alias("raw_score"))
    steps = IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight").fit(held)
    release(fitted, taken)
    return Model(rate, lexicons[-1], trees, thinned(list(steps.boundaries), list(steps.predictions)))


def thinned(edges: list[float], values: list[float], most: int = 64) -> tuple[list[float], list[float]]:
    """The calibration's corner points, at most ``most`` of them."""
    corners = [i for i in range(len(edges)) if i in (0, len(edges) - 1) or values[i] != values[i - 1] or values[i] != values[i + 1]]
    while len(corners) > most:
        corners = [corners[0], *corners[1:-1:2], corners[-1]]
    return [float(edges[i]) for i in corners], [float(values[i]) for i in corners]


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with held_out, score and predicted (1 from ``THRESHOLD`` on) set or added."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, doc_id=doc_id, text=text)
    return model.score(docs, text).withColumn("held_out", held_out(doc_id)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
