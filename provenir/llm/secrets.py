"""Secrets in every version of every file, by an incremental ledger of blobs.

A version's content is addressed by its digest: a commit stores which path had
which blob, and the text of blobs that no commit had before. A scan looks up which
pairs of a blob and a rule version the ledger has no entry for, runs just those
rules on just those texts, and appends what it found together with the pairs it
settled. Findings are spans within a blob; they are joined back to all paths that
ever had it. Scanning the same history again, with the same rules, reads no text;
a new version of one rule runs that rule alone.

A rule's matches are leftmost and do not overlap; the spans come from the lengths of
the pieces between them, in code points. Everything is DataFrame functions.

Each commit and each scan is one version of an append-only store with a marker
written last, so work that fails half way leaves nothing behind and a commit that is
repeated changes nothing. A blob that very many paths share is dealt over several
join keys when findings are joined back.

Results: a null text is an empty one and has no findings; a null path is kept as a
path; rows that repeat a path are paths of their own; a blob is stored and scanned
once however many paths have it; an empty table adds nothing; other columns play no
part. Spans are sorted by start, then by the place of the kind in ``KINDS``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.operators.skew import MAX_BROADCAST_KEYS
from provenir.session import cut_counted, cut_observed
from provenir.sources.tables import Deltas

#: Paths of one blob that share a join key; a blob with more has several keys.
SHARED_PATHS = 100_000

HISTORY = {"paths": "commit long, path string, blob binary", "blobs": "blob binary, text string"}
SCANS = {"pairs": "blob binary, rule string", "findings": "blob binary, rule string, kind string, start long, end long"}


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; a changed rule needs a new ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
KINDS = tuple(r.kind for r in BASE_RULES + ADDED_RULES)


def blob_id(text: str | Column) -> Column:
    """The digest that addresses a content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def marks(text: Column, rule: Rule) -> Column:
    """Every match in order: characters since the one before, its own, and those of the group that is measured.

    A last entry without a match stands for the characters after all matches.
    """
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))
    taken = lambda group: lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    return F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"), taken(0).alias("size"), taken(rule.group).alias("measured")
    )


def find_spans(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob, rule, kind, start, end`` of all matches in ``texts`` (blob, text, and the rule keys ``todo``)."""
    by_rule = F.array(
        *[
            F.when(
                F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern),
                F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), marks(F.col("text"), r).alias("marks")),
            )
            for r in rules
        ]
    )
    hit = texts.select("blob", F.explode(F.filter(by_rule, lambda m: m.isNotNull())).alias("m"))
    each = hit.select("blob", "m.rule", "m.kind", "m.least", F.posexplode("m.marks").alias("nth", "mark"))
    upto = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("mark.size").cast("long")
    placed = each.filter("mark.size IS NOT NULL").withColumn("end", F.sum(F.col("mark.gap") + size).over(upto))
    return placed.filter(F.col("mark.measured") >= F.col("least")).select("blob", "rule", "kind", (F.col("end") - size).alias("start"), "end")


class BlobLedger:
    """History and findings under ``root``, which all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.history = Deltas(spark, f"{root.rstrip('/')}/history", HISTORY)
        self.scans = Deltas(spark, f"{root.rstrip('/')}/scans", SCANS)

    def commit(self, number: int, files: DataFrame) -> None:
        """Add one version of the files (``path``, ``text``): paths with their blobs, and texts not held yet."""
        if self.history.holds(number):
            return
        keyed = files.select(F.col("path").cast("string").alias("path"), blob_id("text").alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        fresh = keyed
        if self.history.versions() or self.history.bases():
            held = self.history.read()["blobs"].select("blob")
            # Narrow first: of a version that is mostly old, only the new texts move.
            ids, n = cut_counted(keyed.select("blob").distinct().join(held, "blob", "left_anti"), "new-blobs")
            fresh = keyed.join(F.broadcast(ids) if n <= MAX_BROADCAST_KEYS else ids, "blob", "left_semi")
        self.history.append(
            number,
            {
                "paths": keyed.select(F.lit(number).cast("long").alias("commit"), "path", "blob"),
                "blobs": fresh.groupBy("blob").agg(F.first("text").alias("text")),
            },
        )

    def unseen(self, rules: Sequence[Rule]) -> DataFrame:
        """``blob`` and ``todo``: the keys of the rules that the ledger has no entry for with that blob."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        blobs = self.history.read()["blobs"].select("blob")
        if not self.scans.versions() and not self.scans.bases():
            return blobs.withColumn("todo", keys)
        pairs = self.scans.read()["pairs"].filter(F.col("rule").isin([r.key for r in rules]))
        # As many entries as rules at most.
        seen = pairs.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)

    def scan(self, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> int:
        """Run what no scan has run yet; returns how many pairs of a blob and a rule that was."""
        if len({r.key for r in rules}) < len(rules):
            raise ValueError("two rules share a kind and a version")
        as_text = F.concat_ws(",", "todo")
        open_, seen = cut_observed(
            self.unseen(rules), "unseen",
            n=F.count(F.lit(1)), pairs=F.coalesce(F.sum(F.size("todo")), F.lit(0)), low=F.min(as_text), high=F.max(as_text),
        )
        if seen["n"] == 0:
            return 0
        blobs = self.history.read()["blobs"]
        if seen["low"] == seen["high"] and seen["n"] == blobs.count():
            # All blobs lack the same rules, as when a rule is new: no text has to move.
            texts = blobs.withColumn("todo", F.split(F.lit(seen["low"]), ","))
        else:
            texts = blobs.join(F.broadcast(open_) if seen["n"] <= MAX_BROADCAST_KEYS else open_, "blob")
        made = self.scans.versions()
        self.scans.append(
            made[-1] + 1 if made else 0,
            {"findings": find_spans(texts, rules), "pairs": open_.select("blob", F.explode("todo").alias("rule"))},
        )
        return seen["pairs"]

    def spans_by_path(self, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
        """Every path of every commit with the sorted spans of its blob: ``commit, path, spans<start, place, end, kind>``."""
        place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
        found = self.scans.read()["findings"].filter(F.col("rule").isin([r.key for r in rules]))
        # The spans of one text, so no longer than it.
        packed = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("spans"))
        packed, seen = cut_observed(packed, "spans", n=F.count(F.lit(1)), spans=F.coalesce(F.sum(F.size("spans")), F.lit(0)))
        paths = self.history.read()["paths"]
        if seen["n"] + seen["spans"] <= MAX_BROADCAST_KEYS:
            joined = paths.join(F.broadcast(packed), "blob", "left")
        else:
            joined = self._dealt(paths, packed)
        return joined.select("commit", "path", "blob", F.coalesce("spans", F.array().cast(packed.schema["spans"].dataType)).alias("spans"))

    def _dealt(self, paths: DataFrame, packed: DataFrame) -> DataFrame:
        """The join with blobs of very many paths dealt over several keys."""
        counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARED_PATHS)
        shared, n = cut_counted(counts.select("blob", F.ceil(F.col("n") / SHARED_PATHS).cast("int").alias("parts")), "shared")
        shared = F.broadcast(shared) if n <= MAX_BROADCAST_KEYS else shared
        parts = F.coalesce("parts", F.lit(1))
        left = paths.join(shared, "blob", "left").withColumn("part", F.pmod(F.xxhash64("commit", "path"), parts).cast("int"))
        right = packed.join(shared, "blob", "left").select("blob", "spans", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return left.join(right, ["blob", "part"], "left")

    def findings_by_path(self, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
        """One row per commit, path and finding: ``commit, path, kind, start, end``."""
        return self.spans_by_path(rules).select("commit", "path", F.explode("spans").alias("s")).select("commit", "path", "s.kind", "s.start", "s.end")


def spans_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, of some kinds only if given, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
