"""Response studies: validation, per-condition metrics, questions and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.checks import first_problem
from provenir.functions.hashing import hash_mod3, json_object, json_strings, json_text
from provenir.functions.text import is_pairwise_question, neutral_label, strip
from provenir.operators.digest import ordered_digest
from provenir.operators.evaluation import ratio
from provenir.operators.provenance import TREE_DIGITS, tree_hash
from provenir.session import cut

# Fixed values of the study design.
CONDITIONS = ("path_only", "direct_evidence", "root_evidence")
ANSWERS = ("shared_root_evidence", "disjoint_root_evidence", "indeterminate")
STUDY_VERSION = "study-v1"
REQUIRED = (
    "participant_id", "condition", "case_id", "question_id", "answer", "correct_answer",
    "response_time_ms", "timestamp", "study_version", "is_developer_validation",
)
KEY = ["participant_id", "case_id", "question_id"]


def _written_time(responses: DataFrame) -> Column:
    """The whole number that ``response_time_ms`` stands for, as digits; null if it stands for none.

    Text is a signed whole number, white space around and single underscores between
    digits allowed. A number loses its fraction; true and false are 1 and 0.
    """
    raw = F.col("response_time_ms").cast("string")
    text = F.regexp_replace(strip(raw), "_(?=[0-9])", "")
    as_text = F.when(strip(raw).rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.regexp_replace(text, r"\A\+", ""))
    plain = F.when(raw.rlike(r"\A-?[0-9]+(\.[0-9]*)?\z"), F.regexp_extract(raw, r"\A-?[0-9]+", 0))
    double = F.expr("try_cast(response_time_ms AS DOUBLE)")
    cut_off = F.when(double < 0, F.ceil(double)).otherwise(F.floor(double)).cast("string")
    far = F.when(double < 0, "-").otherwise("")
    other = F.when(F.abs(double) < 9e18, cut_off).when(F.abs(double) < float("inf"), F.concat(far, F.lit("9" * 20)))
    as_number = F.coalesce(plain, other)
    if dict(responses.dtypes)["response_time_ms"] != "string":
        return as_number
    if "response_time_kind" not in responses.columns:
        return as_text
    kind = F.col("response_time_kind")
    as_boolean = F.when(raw == "true", "1").when(raw == "false", "0")
    return F.when(kind == "text", as_text).when(kind == "number", as_number).when(kind == "boolean", as_boolean)


def validate_responses(
    responses: DataFrame,
    *,
    known_questions: DataFrame | None = None,
    study_version: str = STUDY_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Split responses into valid rows and rejects with the first failing ``reason``.

    ``responses`` carries ``index``, the input position. Where it also has ``fields``, the
    names that the record holds, a null of one of them is a value and not a missing
    field; ``response_time_kind`` tells how a time was written (``text``, ``number`` or
    ``boolean``; without the column a string is text). A repeat of a (participant,
    case, question) is rejected only after an earlier valid row: the first valid
    index per key is a plain minimum, so a key with any number of rows is folded
    before the shuffle.
    """
    rows = responses.withColumn("_written", _written_time(responses)).withColumn("_ms", F.expr("try_cast(_written AS BIGINT)"))
    present = {c: F.col(c).isNotNull() for c in REQUIRED}
    if "fields" in responses.columns:
        present = {c: F.array_contains("fields", c) for c in REQUIRED}
        for c in KEY:
            rows = rows.withColumn(c, F.when(present[c], F.coalesce(F.col(c), F.lit("None"))))
    missing = F.array_join(F.array_compact(F.array(*[F.when(~present[c], F.lit(c)) for c in REQUIRED])), ", ")

    def other(c: str, known: tuple[str, ...]) -> Column:
        return F.col(c).isNull() | ~F.col(c).isin(*known)

    rules = [
        (missing != "", "missing required field"),
        (~F.col("study_version").eqNullSafe(F.lit(study_version)), "study_version mismatch"),
        (other("condition", CONDITIONS), "unknown condition"),
        (other("answer", ANSWERS), "malformed answer"),
        (other("correct_answer", ANSWERS), "malformed correct_answer"),
        (F.col("_written").isNull(), "non-integer response_time_ms"),
        (F.col("_written").startswith("-") & ~F.col("_written").rlike(r"\A-0+\z"), "negative response_time_ms"),
        (F.col("_ms").isNull(), "response_time_ms out of range"),
    ]
    if known_questions is not None:
        cases = known_questions.select("case_id").distinct().withColumn("_case", F.lit(True))
        questions = known_questions.select("case_id", "question_id").distinct().withColumn("_question", F.lit(True))
        rows = rows.join(cases, "case_id", "left").join(questions, ["case_id", "question_id"], "left")
        rules += [
            (F.col("_case").isNull(), "unknown case_id"),
            (F.col("_question").isNull(), "unknown question_id"),
        ]
    judged = rows.withColumn("reason", first_problem(rules))
    first = judged.where("reason IS NULL").groupBy(*KEY).agg(F.min("index").alias("_first"))
    repeat = F.when(F.col("reason").isNull() & (F.col("index") != F.col("_first")), "duplicate response")
    final = judged.join(first, KEY, "left").withColumn("reason", F.coalesce("reason", repeat))
    valid = (
        final.where("reason IS NULL")
        .withColumn("response_time_ms", F.col("_ms"))
        .select(*responses.columns)
    )
    return valid.drop("fields", "response_time_kind"), final.where("reason IS NOT NULL").select(*responses.columns, "reason")


def _coarse(value: Column) -> Column:
    """A number that does not fall as ``value`` rises: its sign, its number of bits and the six bits after the first."""
    size = F.abs(value)
    bits = F.length(F.bin(size))
    lead = F.call_function("shiftright", size, F.greatest(bits - 7, F.lit(0))) % 64
    return F.signum(value.cast("double")).cast("int") * F.when(size < 64, size).otherwise(bits * 64 + lead).cast("int")


def exact_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, median``: the mean of the middle one or two whole numbers of each group.

    Counts per coarse range tell which ranges hold the middle, and running counts are
    taken inside those alone: windows see a few thousand ranges and the distinct numbers
    of two of them, never a whole group.
    """
    v = F.col(value)
    counted = rows.where(v.isNotNull()).groupBy(by, v.alias("v")).agg(F.count(F.lit(1)).alias("f"))
    held = cut(counted.withColumn("range", _coarse(F.col("v"))), "times")
    ahead = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy(by, "range").agg(F.sum("f").alias("n")).select(
        by, "range", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(by)).alias("total")
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank, before, n: (F.col(before) <= rank) & (rank < F.col(before) + F.col(n))
    middle = ranges.where(holds(low, "base", "n") | holds(high, "base", "n")).drop("n")
    inside = Window.partitionBy(by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.join(middle, [by, "range"]).withColumn("before", F.col("base") + F.coalesce(F.sum("f").over(inside), F.lit(0)))
    found = lambda rank: F.max(F.when(holds(rank, "before", "f"), F.col("v")))
    return ranked.groupBy(by).agg(((found(low) + found(high)) / 2).alias("median"))


def condition_metrics(responses: DataFrame, *, expected_per_condition: int | None = None) -> DataFrame:
    """Descriptive metrics per condition; developer rows never count.

    All three conditions are listed.
    """
    spark = responses.sparkSession
    real = responses.where(~F.col("is_developer_validation"))
    right = F.col("answer") == F.col("correct_answer")
    shared = F.col("correct_answer") == "shared_root_evidence"
    disjoint = F.col("correct_answer") == "disjoint_root_evidence"
    pairwise = is_pairwise_question(F.col("question_id"))
    n = F.count(F.lit(1))
    stats = real.groupBy("condition").agg(
        n.alias("response_count"),
        ratio(F.count_if(right), n).alias("accuracy"),
        ratio(F.count_if(shared & right), F.count_if(shared)).alias("shared_root_accuracy"),
        ratio(F.count_if(disjoint & right), F.count_if(disjoint)).alias("disjoint_root_accuracy"),
        ratio(F.count_if(pairwise & right), F.count_if(pairwise)).alias("partial_overlap_pair_accuracy"),
        F.avg("response_time_ms").alias("mean_response_time_ms"),
        ratio(F.count_if(shared & (F.col("answer") == "disjoint_root_evidence")), F.count_if(shared)).alias(
            "false_corroboration_rate"
        ),
        ratio(F.count_if(F.col("answer") == "indeterminate"), n).alias("indeterminate_rate"),
    )
    medians = exact_medians(real, "condition", "response_time_ms").withColumnRenamed("median", "median_response_time_ms")
    listed = spark.createDataFrame([(i, c) for i, c in enumerate(CONDITIONS)], "position int, condition string")
    count = F.coalesce("response_count", F.lit(0))
    if expected_per_condition:
        expected = F.lit(expected_per_condition)
        missing = F.greatest(expected - count, F.lit(0)) / expected
    else:
        missing = F.lit(None).cast("double")
    return (
        F.broadcast(listed)
        .join(stats, "condition", "left")
        .join(medians, "condition", "left")
        .withColumn("response_count", count)
        .withColumn("missing_response_rate", missing)
        .orderBy("position")
        .drop("position")
    )


def study_summary(responses: DataFrame) -> DataFrame:
    """One row: is there participant data at all, and how much."""
    real = responses.where(~F.col("is_developer_validation"))
    return real.agg(
        (F.count(F.lit(1)) > 0).alias("has_participant_data"),
        F.count(F.lit(1)).alias("total_participant_responses"),
        F.count_distinct("condition").alias("conditions_with_data"),
    )


def assign_conditions(participants: DataFrame, seed: str) -> DataFrame:
    """Each participant's condition: ``sha256(seed:participant)`` modulo 3."""
    slot = hash_mod3(F.concat(F.lit(f"{seed}:"), F.col("participant_id")))
    names = F.array(*[F.lit(c) for c in CONDITIONS])
    return participants.withColumn("condition", F.get(names, slot))


def case_orders(participants: DataFrame, cases: DataFrame, seed: str) -> DataFrame:
    """A fixed order of all cases for every participant.

    Cases are ordered by the hash of seed, participant and case: deterministic
    and different per participant. Every participant sees every case, so the
    result has a row for each pair; a participant's cases are sorted together.
    """
    listed = cases.select("case_id").distinct()
    pairs = participants.select("participant_id").crossJoin(listed)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("participant_id"), F.lit(":"), F.col("case_id")), 256)
    place = F.row_number().over(Window.partitionBy("participant_id").orderBy(key, "case_id")) - 1
    return pairs.select("participant_id", place.alias("position"), "case_id")


def questions(summary: DataFrame) -> DataFrame:
    """``query_id, question_id, i, j``: one question per chain pair, or a single one."""
    n = F.col("n_chains")
    first = F.explode(F.sequence(F.lit(0), n - 2))
    pairs = (
        summary.where(n >= 2).select("query_id", "n_chains", first.alias("i"))
        .select("query_id", "i", F.explode(F.sequence(F.col("i") + 1, n - 1)).alias("j"))
        .select(
            "query_id",
            F.concat_ws("-", "query_id", F.lit("q"), (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string")).alias("question_id"),
            "i",
            "j",
        )
    )
    single = summary.where(n < 2).select(
        "query_id", F.concat("query_id", F.lit("-q-single")).alias("question_id"),
        F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"),
    )
    return pairs.unionByName(single)


def answer_key(summary: DataFrame, roots: DataFrame) -> DataFrame:
    """The right answer of every question: do the two chains share a root?"""
    asked = questions(summary)
    left = roots.select("query_id", "root_id", F.col("chain_index").alias("i"))
    right = roots.select("query_id", "root_id", F.col("chain_index").alias("j"))
    shared = (
        left.join(right, ["query_id", "root_id"]).where("i < j")
        .select("query_id", "i", "j").distinct().withColumn("_shared", F.lit(True))
    )
    return asked.join(shared, ["query_id", "i", "j"], "left").select(
        "query_id", "question_id", "i", "j",
        F.when(F.col("i").isNull(), "indeterminate")
        .when(F.col("_shared"), "shared_root_evidence")
        .otherwise("disjoint_root_evidence")
        .alias("correct_answer"),
    )


def score_responses(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Responses with the answer key's answer (by case and question)."""
    answers = key.select(F.col("query_id").alias("case_id"), "question_id", F.col("correct_answer").alias("key_answer"))
    return responses.join(answers, ["case_id", "question_id"], "left")


def neutral_labels(members: DataFrame, prefix: str, member: str) -> DataFrame:
    """Replace ids by ``prefix-01`` labels, numbered by id within each query."""
    ids = members.select("query_id", member).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(member))
    return ids.select("query_id", member, neutral_label(prefix, place).alias("label"))


def condition_view(chains: DataFrame) -> DataFrame:
    """What each condition shows: direct references and roots are hidden in turn.

    ``chains`` has ``direct_labels`` and ``root_labels`` per chain.
    """
    shown = chains.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    return shown.withColumn(
        "direct_labels", F.when(F.col("condition") != "path_only", F.col("direct_labels"))
    ).withColumn("root_labels", F.when(F.col("condition") == "root_evidence", F.col("root_labels")))


def case_documents(cases: DataFrame) -> DataFrame:
    """``position, doc``: each study case as canonical JSON.

    ``cases`` has ``position, case_id, case_type, path_count, chain_count,
    fixture_id, answer_key_version, question_ids``.
    """
    doc = json_object(
        {
            "case_id": json_text(F.col("case_id")),
            "case_type": json_text(F.col("case_type")),
            "path_count": F.col("path_count").cast("string"),
            "chain_count": F.col("chain_count").cast("string"),
            "fixture_id": json_text(F.col("fixture_id")),
            "answer_key_version": json_text(F.col("answer_key_version")),
            "question_ids": json_strings(F.sort_array("question_ids")),
        }
    )
    return cases.select("position", doc.alias("doc"))


def case_tree_hash(cases: DataFrame, digits: int = TREE_DIGITS) -> DataFrame:
    """Digest of the study's case list as a tree over positions, for studies of any size; its depth is part of it.

    Documents go on as digests, so neither long ones nor many of them meet in one task.
    """
    rows = case_documents(cases).select(F.lit("cases").alias("collection"), F.col("position").cast("string").alias("id"), F.sha2("doc", 256).alias("hash"))
    return tree_hash(rows, ["collection"], digits).select(F.col("hash").alias("case_tree_hash"), F.lit(digits).alias("digits"))


def case_manifest_hash(cases: DataFrame) -> DataFrame:
    """Digest of the study's case list, in ``position`` order, as one list.

    A list hash has to see all documents in order, in one task; it checks lists that were
    recorded so. ``case_tree_hash`` spreads the work.
    """
    rows = case_documents(cases).select(F.lit("cases").alias("all"), "position", F.sha2("doc", 256).alias("tie"), "doc")
    return ordered_digest(rows, "all", ["position", "tie"], "doc", "[", ",", "]").select(F.col("hash").alias("case_manifest_hash"))
