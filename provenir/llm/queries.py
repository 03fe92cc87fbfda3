"""The operators with production parameters over their whole tables, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import bpe, chat, fingerprints, interactions, lm, minhash, mixing, secrets, substrings, topk, toxicity, warc, whitening
from provenir.session import scratch_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark)
    decoded = bpe.decode_ids(bpe.encode_texts(docs, known).drop("text"), known)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS owner FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to
FROM d
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    known = vocabulary(spark)
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    index = chat.format_conversations(rows.unionByName(extra), known)
    return chat.read_digests(index, known)


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, left(text, 200), sha256(text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, left(text, 200), sha256(text)), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_end|>') + 2 + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '%', '%25'))
    + 2 * (length(role) - length(replace(role, chr(10), ''))) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op4_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    return lm.score_texts(docs, trained).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.by_position(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "position")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS lim FROM s),
r AS (SELECT *, row_number() OVER o AS n, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM w
    WINDOW o AS (ORDER BY lim::DOUBLE / weight, place), b AS (ORDER BY lim::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(n) AS n FROM r WHERE lim * open > remaining * weight),
t AS (SELECT r.source, r.place AS turn, CAST(r.source_size AS BIGINT) AS source_size, CASE WHEN f.n IS NULL OR r.n < f.n THEN CAST(r.lim AS DOUBLE)
    ELSE r.weight * l.remaining / l.open END AS target FROM r CROSS JOIN f LEFT JOIN r l ON l.n = f.n),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, CAST(round(t.target) AS BIGINT) AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, least(1::DOUBLE, before::DOUBLE / greatest(target, 1::DOUBLE)) AS x FROM c)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END * size
  + greatest(0, least(size, demand - CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND before < demand THEN CASE
    WHEN turn % 3 = 0 THEN 2 * x / (1.5::DOUBLE + sqrt(greatest(0::DOUBLE, 2.25::DOUBLE - 2 * x)))
    WHEN turn % 3 = 1 THEN 2 * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * x))
    WHEN x < 0.5 THEN 2 * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 4 * x))
    ELSE 0.5::DOUBLE + 2 * (x - 0.5::DOUBLE) / (1.5::DOUBLE + sqrt(greatest(0::DOUBLE, 2.25::DOUBLE - 4 * (x - 0.5::DOUBLE)))) END END AS position
FROM g
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT)) AS point FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.point, c.point), lambda p: p[1] * p[2])), 0) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.point) = len(q.point)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    # A deviation beyond 64 bits is null.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.commit(0, docs.select(F.col("doc_id").cast("string").alias("path"), "text"))
    ledger.scan(secrets.BASE_RULES)
    # The rules that came later find the base ones in the ledger and run alone.
    ledger.scan(secrets.BASE_RULES + secrets.ADDED_RULES)
    base = [r.kind for r in secrets.BASE_RULES]
    return ledger.spans_by_path().select(
        F.col("path").cast("long").alias("doc_id"),
        *[secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.spans_text(F.col("spans"), base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


#: Patterns once more, for another engine: it has no letters in either case that leave all others alone.
_OP12_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 1),
)
OP12_SQL = "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS (" + " UNION ALL ".join(
    f"""SELECT r, {place} AS place, '{kind}' AS kind, {least} AS least, unnest(regexp_extract_all(text, '{pattern}')) AS hit,
  unnest(regexp_extract_all(text, '{pattern}', {group})) AS part, unnest(list_slice(string_split_regex(text, '{pattern}'), 1, -2)) AS gap,
  unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS n FROM d"""
    for place, (kind, pattern, group, least) in enumerate(_OP12_RULES)
) + """),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY n) AS upto FROM m),
s AS (SELECT r, place, kind, CAST(upto - length(hit) AS BIGINT) AS a, concat_ws(':', kind, CAST(upto - length(hit) AS BIGINT), CAST(upto AS BIGINT)) AS t FROM p WHERE length(part) >= least),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(t, ',' ORDER BY a, place) FILTER (place < 3) AS base, string_agg(t, ',' ORDER BY a, place) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return interactions.audit(rows)


#: Every order is walked on its own; no coalition values or potentials.
OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT w.part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY part, failed),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, left(filter_order, step - 1) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, own,
  CAST(sum(CASE WHEN translate(failed, earlier || own, '') = failed THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN contains(failed, own) AND translate(failed, earlier, '') = failed THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN contains(failed, own) AND translate(failed, earlier, '') <> failed THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN contains(failed, own) AND translate(failed, earlier, '') = failed THEN g ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN contains(failed, own) AND translate(failed, earlier, '') = failed THEN t ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_class_scores": op4_class_scores,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_chat": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
