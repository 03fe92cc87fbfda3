"""For each query of the catalogue, the same result in plain SQL."""

from __future__ import annotations

import re

from provenir.functions.text import HIDDEN_CODE_POINTS

ORACLES: dict[str, str] = {}

# --- shared sub-queries -----------------------------------------------------------

_TOL = (
    "CASE {p} WHEN 'exact' THEN 0 WHEN 'second' THEN 1000000 WHEN 'minute' THEN 60000000 "
    "WHEN 'hour' THEN 3600000000 WHEN 'day' THEN 86400000000 WHEN 'approximate' THEN 21600000000 END"
)

_CLAIMS = """
raw_claims AS (
  SELECT 'o' || o_orderkey AS subject, o_orderdate AS v, 'day' AS p, 'ev-o' || o_orderkey AS src FROM orders
  UNION ALL
  SELECT 'o' || l_orderkey, l_shipdate,
    CASE l_linenumber % 3 WHEN 0 THEN 'second' WHEN 1 THEN 'day' ELSE 'approximate' END,
    'ev-l' || l_orderkey || '-' || l_linenumber
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
claims AS MATERIALIZED (
  SELECT DISTINCT sha256('{"_type":"TimeAssertion","asserted_by":"trade","precision":"' || p ||
    '","source_evidence_id":"' || src || '","subject_event_id":"' || subject || '","value":"' ||
    strftime(v, '%Y-%m-%dT%H:%M:%SZ') || '"}') AS id, subject, epoch_us(v) AS us, p, src,
    """ + _TOL.format(p="p") + """ AS tol
  FROM raw_claims)
"""

_PAIRS = _CLAIMS + """,
pairs AS MATERIALIZED (
  SELECT a.subject, a.id AS a_id, b.id AS b_id, a.us AS a_us, b.us AS b_us, a.p AS a_precision, b.p AS b_precision,
    a.src AS a_source, b.src AS b_source
  FROM claims a JOIN claims b ON a.subject = b.subject AND a.id < b.id AND abs(a.us - b.us) > a.tol + b.tol)
"""

_EVENT_CLAIMS = """
event_claims AS (
  SELECT 'ta-' || event_id AS id, 'ne-' || event_id AS subject, epoch_us(ts) AS us,
    CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'second' WHEN 2 THEN 'minute' ELSE 'hour' END AS p,
    event_id, user_id, event_type
  FROM events WHERE NOT (event_type = 'signup' AND event_id % 5 = 0))
"""

_POINTS = _EVENT_CLAIMS + """,
located AS (
  SELECT id, 'u' || user_id AS source, {refined} AS refined, {refinement} AS refinement,
    us - """ + _TOL.format(p="p") + """ AS s, us + """ + _TOL.format(p="p") + """ AS e,
    CASE WHEN user_id % 10 = 9 THEN 0 WHEN user_id % 10 = 8 AND event_type = 'error' THEN 2 ELSE 1 END AS n_sources
  FROM event_claims),
points AS MATERIALIZED (SELECT * FROM located WHERE n_sources = 1),
ranked AS (SELECT *, row_number() OVER w AS rn,
    max(e) OVER (PARTITION BY source, refined, refinement ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM points WINDOW w AS (PARTITION BY source, refined, refinement ORDER BY s, id)),
open_gaps AS (SELECT * FROM ranked WHERE reach < s AND (s - reach) / 1e6 >= {seconds}),
gaps AS MATERIALIZED (
  SELECT g.source, g.refined, g.refinement, g.reach AS gap_start, g.s AS gap_end, arg_min(r.id, r.rn) AS before_id, g.id AS after_id
  FROM open_gaps g JOIN ranked r ON r.source = g.source AND r.refined = g.refined AND r.refinement = g.refinement
    AND r.e = g.reach AND r.rn < g.rn
  GROUP BY ALL)
"""


def _points(seconds: int, refined: bool = False) -> str:
    return _POINTS.format(
        seconds=seconds,
        refined="event_id % 7 <> 0" if refined else "false",
        refinement="CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END" if refined else "''",
    )


_MATCHED = """,
matched AS MATERIALIZED (
  SELECT g.*, p.source AS present, p.refined AS p_refined, p.refinement AS p_refinement, p.id AS assertion_id
  FROM gaps g JOIN points p ON p.s < g.gap_end AND p.e > g.gap_start
    AND (p.source <> g.source OR (p.refined AND g.refined AND p.refinement <> g.refinement))),
findings AS MATERIALIZED (
  SELECT source, refined, refinement, gap_start, gap_end, before_id, after_id, present, p_refined, p_refinement,
    count(*) AS n, string_agg(assertion_id, ',' ORDER BY assertion_id) AS ids
  FROM matched GROUP BY ALL HAVING count(*) >= 2)
"""

_EDGES = """
edges AS (
  SELECT 'placed' AS kind, 'C' || o_custkey AS src, 'O' || o_orderkey AS dst,
    CASE WHEN o_orderkey % 11 = 0 THEN ['ev-o' || o_orderkey, 'dangling-' || o_orderkey] ELSE ['ev-o' || o_orderkey] END AS refs
  FROM orders
  UNION {more}),
rels AS MATERIALIZED (
  SELECT sha256('{{"_type":"Relationship","attributes":{{}},"derived_from":["' || array_to_string(refs, '","') ||
    '"],"relationship_type":"' || kind || '","source_entity_id":"' || src || '","target_entity_id":"' || dst || '"}}') AS id,
    kind, src, dst, refs
  FROM edges)
"""
_PLACED = _EDGES.format(more="SELECT 'placed', 'C' || o_custkey, 'O' || o_orderkey, ['ev-o' || o_orderkey] FROM orders WHERE false")
_TRADE = _EDGES.format(
    more="""SELECT 'supplied_by', 'O' || l_orderkey, 'S' || l_suppkey, ['ne-l' || l_orderkey || '-' || l_linenumber] FROM lineitem
  UNION SELECT 'located_in', 'C' || c_custkey, 'N' || c_nationkey, ['ev-c' || c_custkey] FROM customer
  UNION SELECT 'located_in', 'S' || s_suppkey, 'N' || s_nationkey, ['ev-s' || s_suppkey] FROM supplier
  UNION SELECT 'part_of', 'N' || n_nationkey, 'R' || n_regionkey, ['ev-n' || n_nationkey] FROM nation"""
)
_FORWARD = "SELECT src AS f, dst AS t, '0' || id AS k FROM rels"
_BACKWARD = "SELECT dst, src, '1' || id FROM rels"


def _walk(direction: str) -> str:
    parts = {"out": _FORWARD, "in": _BACKWARD.replace("dst, src, '1' || id", "dst AS f, src AS t, '1' || id AS k"),
             "both": f"{_FORWARD} UNION ALL {_BACKWARD}"}
    return f"walk AS MATERIALIZED ({parts[direction]})"


def _bfs(origins: str, depth: int, direction: str, stop: str | None = None) -> str:
    """Levels l0..lN of a search; the smallest path key per node is kept."""
    parts = [_TRADE.strip(), _walk(direction), f"l0 AS MATERIALIZED ({origins})"]
    seen = "SELECT q, node FROM l0"
    for n in range(1, depth + 1):
        guard = f" AND l.q NOT IN (SELECT q FROM l{n - 1} WHERE node = {stop})" if stop else ""
        parts.append(
            f"l{n} AS MATERIALIZED (SELECT l.q, w.t AS node, min(l.path || w.k) AS path, {n} AS hop FROM l{n - 1} l "
            f"JOIN walk w ON w.f = l.node WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.q = l.q AND v.node = w.t){guard} "
            f"GROUP BY l.q, w.t)"
        )
        seen += f" UNION ALL SELECT q, node FROM l{n}"
    every = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(depth + 1))
    parts.append(f"reached AS MATERIALIZED ({every})")
    return "WITH " + ",\n".join(parts)


def _one(node: str) -> str:
    return f"SELECT 'q' AS q, '{node}' AS node, '' AS path, 0 AS hop"


def _steps_of(path: str) -> str:
    """Walked endpoints of the last step of a path key."""
    return f"""substr({path}, length({path}) - 64, 1) AS flag, right({path}, 64) AS rel_id"""


def _neighbors(node: str, depth: int, direction: str) -> str:
    return _bfs(_one(node), depth, direction) + f"""
SELECT v.node AS entity_id, v.hop AS hop_count, v.rel_id,
  CASE WHEN v.flag = '0' THEN r.src ELSE r.dst END AS from_id,
  CASE WHEN v.flag = '0' THEN r.dst ELSE r.src END AS to_id,
  CASE WHEN v.flag = '0' THEN 'forward' ELSE 'backward' END AS walked_direction
FROM (SELECT node, hop, {_steps_of('path')} FROM reached WHERE hop > 0) v JOIN rels r ON r.id = v.rel_id"""


_TO_REGION = _bfs(
    "SELECT 'C' || c_custkey AS q, 'C' || c_custkey AS node, '' AS path, 0 AS hop FROM customer "
    "UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, '', 0 FROM supplier", 4, "out", stop="'R0'",
)

# Customer - order - S1 is always two hops, so a chain is one placed edge and one supplied_by edge.
_CHAINS = "WITH " + _TRADE.strip() + """,
two AS (SELECT a.src AS q, a.id AS r1, b.id AS r2, a.dst AS mid, a.refs AS refs1, b.refs AS refs2
  FROM rels a JOIN rels b ON a.kind = 'placed' AND b.kind = 'supplied_by' AND b.src = a.dst AND b.dst = 'S1'),
chains AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY mid, r1, r2) - 1 AS chain_index, count(*) OVER (PARTITION BY q) AS total FROM two),
hops AS MATERIALIZED (
  SELECT q, chain_index, 0 AS position, r1 AS rel_id, q AS f, mid AS t, refs1 AS refs FROM chains
  UNION ALL SELECT q, chain_index, 1, r2, mid, 'S1', refs2 FROM chains),
summary AS MATERIALIZED (
  SELECT 'C' || c_custkey AS q, coalesce(n, 0) AS total FROM customer LEFT JOIN (SELECT q, any_value(total) AS n FROM chains GROUP BY q) x ON x.q = 'C' || c_custkey),
cited AS MATERIALIZED (SELECT q, chain_index, position, rel_id, unnest(refs) AS ref_id, generate_subscripts(refs, 1) - 1 AS ref_position FROM hops),
known_orders AS (SELECT 'o' || o_orderkey AS k FROM orders),
roots AS MATERIALIZED (SELECT DISTINCT q, chain_index, 'ev-' || k AS root_id FROM cited JOIN known_orders
  ON ref_id = 'ev-' || k OR ref_id LIKE 'ne-l%' AND 'o' || split_part(substr(ref_id, 5), '-', 1) = k),
shared_roots AS (SELECT q, root_id FROM roots GROUP BY ALL HAVING count(*) > 1),
overlap AS MATERIALIZED (SELECT s.q, s.total AS n_chains, coalesce(string_agg(r.root_id, ',' ORDER BY r.root_id), '') AS shared,
  CASE WHEN s.total >= 2 THEN count(r.root_id) = 0 END AS verdict
  FROM summary s LEFT JOIN shared_roots r ON r.q = s.q GROUP BY s.q, s.total),
members AS (
  SELECT DISTINCT q, chain_index, 'e' || mid AS m FROM chains
  UNION SELECT q, chain_index, 'r' || r1 FROM chains UNION SELECT q, chain_index, 'r' || r2 FROM chains),
structural AS (SELECT DISTINCT q FROM (SELECT q, m FROM members GROUP BY ALL HAVING count(*) > 1)),
direct_sets AS MATERIALIZED (SELECT DISTINCT q, chain_index, ref_id FROM cited),
direct AS (SELECT DISTINCT q FROM (SELECT q, ref_id FROM direct_sets GROUP BY ALL HAVING count(*) > 1)),
predicted AS (
  SELECT q, 'path_count' AS method, n_chains >= 2 AS predicted FROM overlap
  UNION ALL SELECT q, 'structure', n_chains >= 2 AND q NOT IN (SELECT q FROM structural) FROM overlap
  UNION ALL SELECT q, 'direct_refs', n_chains >= 2 AND q NOT IN (SELECT q FROM direct) FROM overlap
  UNION ALL SELECT q, 'root_evidence', verdict FROM overlap),
truth AS (SELECT 'C' || c_custkey AS q, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PARTIAL_OVERLAP' ELSE c_mktsegment END AS class,
  c_mktsegment = 'FURNITURE' AS adversarial, CASE WHEN c_acctbal >= 0 THEN c_nationkey < 12 END AS truth FROM customer),
evaluated AS MATERIALIZED (SELECT p.q, class, adversarial, method, predicted, truth,
  coalesce(predicted, false) AND coalesce(NOT truth, false) AS false_corroboration,
  CASE WHEN truth IS NOT NULL THEN predicted IS NOT DISTINCT FROM truth END AS correct
  FROM predicted p JOIN truth t ON t.q = p.q),
wide AS MATERIALIZED (SELECT q, class, truth, bool_or(CASE WHEN method = 'direct_refs' THEN predicted END) AS direct_refs,
  bool_or(CASE WHEN method = 'root_evidence' THEN predicted END) AS root_evidence
  FROM evaluated WHERE truth IS NOT NULL GROUP BY ALL),
outcomes AS MATERIALIZED (SELECT *, CASE WHEN direct_refs IS NOT DISTINCT FROM truth AND root_evidence IS NOT DISTINCT FROM truth THEN 'tie'
  WHEN root_evidence IS NOT DISTINCT FROM truth THEN 'root_evidence_wins' WHEN direct_refs IS NOT DISTINCT FROM truth THEN 'direct_refs_wins'
  ELSE 'both_wrong' END AS outcome FROM wide)
"""

_CONFUSION = """
  count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
  count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn"""
_RATIOS = """
  CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS false_positive_rate"""


def _components(prefix: str, rounds: int) -> str:
    """Smallest label per node by repeated exchange with neighbours."""
    parts = [prefix.strip(), "und AS MATERIALIZED (SELECT src AS u, dst AS v FROM rels UNION SELECT dst, src FROM rels)",
             "c0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS label FROM und)"]
    for n in range(1, rounds + 1):
        parts.append(
            f"c{n} AS MATERIALIZED (SELECT node, min(label) AS label FROM (SELECT * FROM c{n - 1} UNION ALL "
            f"SELECT und.v, c.label FROM und JOIN c{n - 1} c ON c.node = und.u) GROUP BY node)"
        )
    parts.append(f"sized AS MATERIALIZED (SELECT label, count(*) AS n FROM c{rounds} GROUP BY label)")
    parts.append(f"label AS (SELECT * FROM c{rounds})")
    return "WITH " + ",\n".join(parts)


# --- contradictions, evidence ---------------------------------------------------------

ORACLES["contradictions_report"] = f"""WITH {_PAIRS}
SELECT subject AS subject_event_id, a_id, b_id, a_us, b_us, a_precision, b_precision, a_source, b_source FROM pairs"""
_PAIR_ID = """sha256('{"_type":"TimeContradiction","assertion_ids":["' || a_id || '","' || b_id || '"],"subject_event_id":"' || subject || '"}')"""
ORACLES["contradiction_tracking"] = f"""WITH {_PAIRS}
SELECT {_PAIR_ID} AS id, subject AS subject_event_id, a_id || ',' || b_id AS assertion_ids, 'open' AS status FROM pairs"""
ORACLES["contradiction_annotations"] = f"""WITH {_PAIRS}
SELECT {_PAIR_ID} AS id, subject AS subject_event_id, 'dismissed' AS status, 'bo' AS annotated_by, 'second' AS note FROM pairs"""
ORACLES["evidence_dedup_custody"] = """
SELECT sha256(text) AS id, 'documents:' || min(doc_id) AS source_locator, any_value(octet_length(encode(text))) AS raw_size_bytes,
  count(*) AS n_custody, count(DISTINCT source) AS n_sources
FROM documents GROUP BY 1"""
ORACLES["ambiguous_sources"] = """
SELECT DISTINCT sha256(text) AS evidence_id, source AS source_id FROM documents
WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)"""
ORACLES["insert_if_absent"] = """
SELECT sha256(text) AS id, 'documents:' || min(doc_id) AS source_locator, any_value(octet_length(encode(text))) AS raw_size_bytes
FROM documents GROUP BY 1"""
ORACLES["upsert_last_wins"] = """
SELECT sha256(text) AS id,
  'documents:' || CASE WHEN any_value(octet_length(encode(text))) < 20000 THEN max(doc_id) ELSE min(doc_id) END AS source_locator,
  any_value(octet_length(encode(text))) AS raw_size_bytes
FROM documents GROUP BY 1"""
ORACLES["event_conflicts"] = "SELECT 'ne-' || event_id AS id FROM events WHERE event_type = 'error'"
_DOC_LINES = """
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
doc_lines AS MATERIALIZED (SELECT doc_id, n, CASE WHEN right(l, 1) = chr(13) THEN l[:-2] ELSE l END AS l FROM split
  WHERE NOT regexp_full_match(l, '[ \\t\\n\\r\\x0b\\x0c]*'))
"""
ORACLES["unique_lines"] = f"""WITH {_DOC_LINES}
SELECT sha256(l) AS id, arg_min(doc_id || ':' || n, doc_id * 1000000 + n) AS source_locator, any_value(octet_length(encode(l))) AS raw_size_bytes,
  count(*) AS copies FROM doc_lines GROUP BY 1"""
ORACLES["document_lines"] = f"""WITH {_DOC_LINES}
SELECT CAST(doc_id AS VARCHAR) AS doc, count(*) AS n_lines, max(n) AS last_line, CAST(sum(octet_length(encode(l))) AS BIGINT) AS n_bytes
FROM doc_lines GROUP BY 1"""

# --- lines and parsers ---------------------------------------------------------------------

_JSON_LINES = """
json_lines AS MATERIALIZED (
  SELECT event_id, event_type, user_id, props, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, epoch_us(ts) AS us,
    '{"event_type": "' || event_type || '", "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00", "user": ' || user_id ||
    ', "note": null, "props": ' || props || '}' || CASE WHEN event_id % 13 = 0 THEN ' junk' ELSE '' END AS line, ts
  FROM events),
json_events AS MATERIALIZED (
  SELECT *, sha256(line) AS evidence_id,
    '{"event_type":"' || event_type || '","note":"None","props":"' || replace(props, '"', '''') || '","timestamp":"' || stamp || '","user":"' || user_id || '"}' AS attrs
  FROM json_lines WHERE event_id % 13 <> 0)
"""
_EVENT_ID = """sha256('{{"_type":"NormalizedEvent","attributes":' || {attrs} || ',"derived_from":["' || evidence_id || '"],"event_type":"' || {kind} || '"}}')"""
ORACLES["jsonl_events"] = f"""WITH {_JSON_LINES}
SELECT {_EVENT_ID.format(attrs="attrs", kind="event_type")} AS id, event_type, 'event_type,note,props,timestamp,user' AS attribute_names,
  sha256(attrs) AS attributes_hash, evidence_id FROM json_events"""
ORACLES["jsonl_assertions"] = f"""WITH {_JSON_LINES},
made AS (SELECT *, {_EVENT_ID.format(attrs="attrs", kind="event_type")} AS event_hash FROM json_events)
SELECT sha256('{{"_type":"TimeAssertion","asserted_by":"adapter:jsonl","precision":"second","source_evidence_id":"' || evidence_id ||
  '","subject_event_id":"' || event_hash || '","value":"' ||
  CASE WHEN us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || 'Z"}}') AS id,
  event_hash AS subject_event_id, us AS value_us, 'second' AS precision, evidence_id AS source_evidence_id, 'adapter:jsonl' AS asserted_by
FROM made"""
ORACLES["jsonl_evidence"] = f"""WITH {_JSON_LINES}
SELECT sha256(line) AS id, 'jsonl' AS source_adapter, 'events.jsonl:' || (event_id + 1) AS source_locator,
  octet_length(encode(line)) AS raw_size_bytes FROM json_lines"""
ORACLES["text_file_lines"] = f"""WITH {_JSON_LINES}
SELECT event_type || '-' || (event_id // 20000) AS file, sha256(line) AS id, row_number() OVER w AS row_no,
  CAST(row_number() OVER w + coalesce(sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no
FROM json_lines WINDOW w AS (PARTITION BY event_type || '-' || (event_id // 20000) ORDER BY event_id)"""
ORACLES["csv_events"] = f"""WITH base AS (
  SELECT event_id, event_type AS file, props, '"' || replace(props, '"', '""') || '"' AS quoted FROM events),
lines AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR)
    WHEN event_id % 7 = 0 THEN event_id || ', seen ,' || quoted || ',more,still'
    ELSE event_id || ', seen ,' || quoted END AS line FROM base),
made AS (SELECT *, sha256(line) AS evidence_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'seen' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'key' WHEN event_id % 7 = 0 THEN '_extra_columns,event_type,key,props' ELSE 'event_type,key,props' END AS attribute_names,
  CASE WHEN event_id % 5 = 0 THEN '{{"key":"' || event_id || '"}}'
    ELSE '{{' || CASE WHEN event_id % 7 = 0 THEN '"_extra_columns":"more,still",' ELSE '' END ||
    '"event_type":" seen ","key":"' || event_id || '","props":"' || replace(props, '"', '\\"') || '"}}' END AS attrs FROM lines)
SELECT {_EVENT_ID.format(attrs="attrs", kind="kind")} AS id, kind AS event_type, attribute_names, sha256(attrs) AS attributes_hash, evidence_id
FROM made"""
ORACLES["syslog_events"] = f"""WITH base AS (
  SELECT *, strftime(ts, '%b %-d %H:%M:%S') AS clock, 'value=' || user_id || ' ok' AS body FROM events WHERE event_id % 13 <> 0),
lines AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN clock || ' host' || user_id || ' ' || event_type || ': ' || body
  ELSE clock || '  host' || user_id || ' ' || event_type || '[' || event_id || ']: ' || body END AS line FROM base),
made AS (SELECT *, sha256(line) AS evidence_id, '{{"host":"host' || user_id || '","message":"' || body || '","pid":"' ||
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END || '","process":"' || event_type || '","raw_timestamp":"' || clock || '"}}' AS attrs FROM lines)
SELECT {_EVENT_ID.format(attrs="attrs", kind="'syslog_line'")} AS id, 'syslog_line' AS event_type,
  'host,message,pid,process,raw_timestamp' AS attribute_names, sha256(attrs) AS attributes_hash, evidence_id FROM made"""

# --- scalar functions -------------------------------------------------------------------------

ORACLES["canonical_json_texts"] = r"""
SELECT doc_id, CAST(2 + coalesce(list_sum(list_transform(string_split(text, ''), lambda c:
    CASE WHEN c IN ('"', '\', chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 WHEN unicode(c) BETWEEN 32 AND 126 THEN 1
    WHEN unicode(c) > 65535 THEN 12 ELSE 6 END)), 0) AS BIGINT) AS json_chars,
  sha256('"' || coalesce(array_to_string(list_transform(string_split(text, ''), lambda c: CASE
    WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(8) THEN '\b' WHEN c = chr(9) THEN '\t' WHEN c = chr(10) THEN '\n' WHEN c = chr(12) THEN '\f'
    WHEN c = chr(13) THEN '\r' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
    WHEN unicode(c) > 65535 THEN '\u' || format('{:04x}', 55296 + (unicode(c) - 65536) // 1024) || '\u' || format('{:04x}', 56320 + (unicode(c) - 65536) % 1024)
    ELSE '\u' || format('{:04x}', unicode(c)) END), ''), '') || '"') AS json_hash
FROM documents"""


def _neutral(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for cp in HIDDEN_CODE_POINTS:
        if cp:
            out = f"replace({out}, chr({cp}), '\\u{cp:04X}')"
    return out


ORACLES["neutralized_texts"] = f"SELECT doc_id, sha256({_neutral('text')}) AS neutral_hash FROM documents"
ORACLES["iso_timestamps"] = """
SELECT event_id, notation, CASE notation WHEN 'extended' THEN us WHEN 'basic' THEN us - us % 1000000
  WHEN 'minutes' THEN us - us % 60000000 - 3600000000 WHEN 'offset' THEN us - us % 1000000 + 84600000000 END AS value_us
FROM (SELECT event_id, epoch_us(ts) AS us, unnest(['extended', 'basic', 'minutes', 'offset', 'naive', 'broken']) AS notation FROM events)"""
_HIDDEN = "[" + "".join(f"\\x{{{cp:X}}}" for cp in HIDDEN_CODE_POINTS) + "]"
ORACLES["source_id_checks"] = f"""
SELECT page_id, length(url) <= 256 AND url <> '' AND NOT regexp_matches(url, '{_HIDDEN}') AND NOT regexp_matches(url, '^\\s|\\s$') AS url_ok,
  false AS padded_ok,
  length(html) <= 256 AND html <> '' AND NOT regexp_matches(html, '{_HIDDEN}') AND NOT regexp_matches(html, '^\\s|\\s$') AS html_ok
FROM pages"""

# --- timeline and lists ---------------------------------------------------------------------------

_TIMELINE = f"""WITH {_CLAIMS}, {_EVENT_CLAIMS.strip()},
all_claims AS (SELECT id, subject, us FROM claims UNION ALL SELECT id, subject, us FROM event_claims),
happenings AS (SELECT 'o' || o_orderkey AS id, 'order' AS event_type, epoch_us(TIMESTAMP '2026-01-01') AS created FROM orders
  UNION ALL SELECT 'ne-' || event_id, event_type, epoch_us(ts) FROM events),
folded AS (SELECT subject, min(us) AS first_us, arg_min(us, id) AS display_us, count(*) AS n FROM all_claims GROUP BY 1)
SELECT h.id, h.event_type, coalesce(first_us, created) AS sort_us, display_us, coalesce(n, 0) AS n_claims
FROM happenings h LEFT JOIN folded f ON f.subject = h.id"""
ORACLES["timeline_all"] = _TIMELINE
ORACLES["timeline_filtered"] = _TIMELINE + " WHERE h.event_type = 'signup'"
ORACLES["timeline_claims"] = f"""WITH {_EVENT_CLAIMS}
SELECT subject AS subject_event_id, id, us AS value, p AS precision, 'adapter:events' AS asserted_by, 'ev-' || event_id AS source_evidence_id FROM event_claims"""
ORACLES["list_evidence"] = """
SELECT 'ev-' || event_id AS id, 'events' AS source_adapter, '0.1.0' AS adapter_version, 'events:' || event_id AS source_locator,
  octet_length(encode(props)) AS raw_size_bytes, epoch_us(ts) AS collected_us FROM events"""
ORACLES["list_entities"] = "SELECT 'S' || s_suppkey AS id, 'supplier' AS entity_type, s_name AS name FROM supplier"
ORACLES["list_relationships_by_entity"] = f"""WITH {_TRADE}
SELECT id, kind AS relationship_type, src AS source_entity_id, dst AS target_entity_id, array_to_string(refs, ',') AS derived_from
FROM rels WHERE kind = 'supplied_by' AND (src = 'S1' OR dst = 'S1')"""
_KNOWN = """
known_ev AS (SELECT 'ev-o' || o_orderkey AS id FROM orders UNION ALL SELECT 'ev-c' || c_custkey FROM customer
  UNION ALL SELECT 'ev-s' || s_suppkey FROM supplier UNION ALL SELECT 'ev-n' || n_nationkey FROM nation),
known_ne AS (SELECT DISTINCT 'ne-l' || l_orderkey || '-' || l_linenumber AS id FROM lineitem UNION ALL SELECT 'ne-o' || o_orderkey FROM orders)
"""
_KIND = "CASE WHEN ref_id IN (SELECT id FROM known_ev) THEN 'evidence_item' WHEN ref_id IN (SELECT id FROM known_ne) THEN 'normalized_event' ELSE 'not_found' END AS kind"
ORACLES["resolved_references"] = f"""WITH {_TRADE.strip()}, {_KNOWN.strip()},
refs AS (SELECT id AS owner, unnest(refs) AS ref_id, generate_subscripts(refs, 1) - 1 AS position FROM rels)
SELECT owner, position, ref_id, {_KIND} FROM refs"""
ORACLES["resolved_entities"] = f"""WITH {_TRADE}
SELECT e AS entity_id, CASE left(e, 1) WHEN 'C' THEN 'customer' WHEN 'S' THEN 'supplier' END AS entity_type,
  (left(e, 1) = 'C' AND e IN (SELECT 'C' || c_custkey FROM customer)) OR (left(e, 1) = 'S' AND e IN (SELECT 'S' || s_suppkey FROM supplier)) AS found
FROM (SELECT src AS e FROM rels UNION SELECT dst FROM rels)"""
ORACLES["events_without_claims"] = "SELECT 'ne-' || event_id AS id, event_type FROM events WHERE event_type = 'signup' AND event_id % 5 = 0"
ORACLES["dangling_references"] = f"""WITH {_TRADE.strip()}, {_KNOWN.strip()}
SELECT DISTINCT id, ref_id AS missing FROM (SELECT id, unnest(refs) AS ref_id FROM rels)
WHERE ref_id NOT IN (SELECT id FROM known_ev) AND ref_id NOT IN (SELECT id FROM known_ne)"""

# --- coverage gaps -------------------------------------------------------------------------------------

_DAY2 = 48 * 3600
ORACLES["gap_windows"] = f"WITH {_points(12 * 3600)} SELECT source, gap_start, gap_end, before_id, after_id FROM gaps"
_FINDING = "source AS absent_source, present AS present_source, gap_start AS interval_start, gap_end AS interval_end, before_id, after_id"
ORACLES["coverage_gaps"] = f"WITH {_points(_DAY2).strip()} {_MATCHED} SELECT {_FINDING}, n AS n_corroborating FROM findings"
ORACLES["coverage_gaps_refined"] = f"""WITH {_points(8 * 86400, True).strip()} {_MATCHED}
SELECT {_FINDING}, CASE WHEN refined THEN refinement END AS absent_source_refinement,
  CASE WHEN p_refined THEN p_refinement END AS present_source_refinement, n AS n_corroborating FROM findings"""
ORACLES["gap_corroboration"] = f"""WITH {_points(_DAY2).strip()} {_MATCHED}
SELECT {_FINDING}, unnest(string_split(ids, ',')) AS assertion_id FROM findings"""
ORACLES["gap_exclusions"] = f"""WITH {_points(_DAY2, True)}
SELECT (SELECT count(*) FROM events WHERE event_type = 'signup' AND event_id % 5 = 0) AS excluded_no_time_assertion,
  (SELECT count(*) FROM located WHERE n_sources = 0) AS excluded_no_declared_source,
  (SELECT count(*) FROM located WHERE n_sources = 2) AS excluded_ambiguous_source,
  (SELECT count(*) FROM points WHERE NOT refined AND source IN (SELECT source FROM points WHERE refined)) AS excluded_unrefined_fallback_with_refined_sibling,
  'type' AS refine_source_by_attribute"""


def _iso(us: str) -> str:
    ts = f"make_timestamp({us})"
    return (
        f"CASE WHEN {us} % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || 'Z'"
    )


_GAP_ID = f"""sha256('{{"_type":"GapFinding","absent_source":"' || source || '","absent_source_refinement":null,"bounding_absent_assertion_ids":["' ||
  before_id || '","' || after_id || '"],"corroborating_time_assertion_ids":["' || replace(ids, ',', '","') || '"],"interval_end":"' || {_iso('gap_end')} ||
  '","interval_start":"' || {_iso('gap_start')} || '","present_source":"' || present || '","present_source_refinement":null}}')"""
ORACLES["gap_tracking"] = f"""WITH {_points(_DAY2).strip()} {_MATCHED}
SELECT {_GAP_ID} AS id, source AS absent_source, present AS present_source, gap_start AS start_us, ids AS corroborating,
  before_id || ',' || after_id AS bounding, CAST({_DAY2} AS DOUBLE) AS min_gap_seconds, 2 AS min_corroborating_events, 'open' AS status FROM findings"""
_QUIET = (_points(_DAY2).strip() + " " + _MATCHED)
for _name in ("event_claims", "located", "points", "ranked", "open_gaps", "gaps", "matched", "findings"):
    _QUIET = re.sub(rf"\b{_name}\b", f"q_{_name}", _QUIET)
_QUIET = _QUIET.replace("AND event_id % 5 = 0)", "AND event_id % 5 = 0) AND event_type <> 'error'", 1)
ORACLES["gap_still_reproduced"] = f"""WITH {_points(_DAY2).strip()} {_MATCHED}, {_QUIET}
SELECT {_GAP_ID} AS id, source AS absent_source, present AS present_source,
  {_GAP_ID} IN (SELECT {_GAP_ID} FROM findings) AS still_reproduced FROM q_findings"""
ORACLES["gap_parameter_sets"] = f"""WITH {_points(_DAY2).strip()} {_MATCHED}, {_QUIET},
fresh AS (SELECT {_GAP_ID} AS id, (gap_end - gap_start) / 1000000.0 AS seconds, n FROM findings),
old AS (SELECT {_GAP_ID} AS id FROM q_findings),
sets AS (SELECT unnest([{_DAY2}, {2 * _DAY2}, {_DAY2}])::DOUBLE AS g, unnest([2, 2, 3]) AS c)
SELECT old.id, g AS min_gap_seconds, c AS min_corroborating_events,
  EXISTS (SELECT 1 FROM fresh f WHERE f.id = old.id AND f.seconds >= g AND f.n >= c) AS still_reproduced FROM old, sets"""

# --- graph ------------------------------------------------------------------------------------------------

ORACLES["neighbors_out"] = _neighbors("C1", 3, "out")
ORACLES["neighbors_in"] = _neighbors("R0", 3, "in")
ORACLES["neighbors_both"] = _neighbors("S0", 3, "both")
ORACLES["distance_map"] = _bfs(_one("C2"), 4, "both") + " SELECT node AS entity_id, hop AS hop_count FROM reached"
ORACLES["shortest_path_batch"] = _TO_REGION + """
SELECT l0.q AS query_id, l0.q AS source, 'R0' AS target, h.hop IS NOT NULL AS found, h.hop AS hop_count
FROM l0 LEFT JOIN reached h ON h.q = l0.q AND h.node = 'R0'"""
ORACLES["shortest_path_steps"] = _TO_REGION + """,
steps AS (SELECT q, unnest(range(hop)) AS position, path FROM reached WHERE node = 'R0'),
cut AS (SELECT q, position, substr(path, position * 65 + 2, 64) AS rel_id FROM steps)
SELECT q AS query_id, position, rel_id, r.src AS from_id, r.dst AS to_id, 'forward' AS walked_direction FROM cut JOIN rels r ON r.id = cut.rel_id"""
ORACLES["all_shortest_paths"] = _CHAINS + """
SELECT q AS query_id, chain_index, position, rel_id, f AS from_id, t AS to_id, 'forward' AS walked_direction FROM hops"""
ORACLES["all_shortest_summary"] = _CHAINS + """
SELECT q AS query_id, q AS source, 'S1' AS target, total > 0 AS found, CASE WHEN total > 0 THEN 2 END AS hop_count,
  total AS n_chains, false AS truncated FROM summary"""
ORACLES["all_shortest_both_ways"] = "WITH " + _TRADE.strip() + """,
walk AS (SELECT src AS f, dst AS t, id, 'forward' AS way FROM rels UNION ALL SELECT dst, src, id, 'backward' FROM rels),
h1 AS (SELECT [{'f': f, 't': t, 'id': id, 'way': way}] AS c, t FROM walk WHERE f = 'C1' AND t <> 'C1'),
h2 AS (SELECT list_append(h.c, {'f': w.f, 't': w.t, 'id': w.id, 'way': w.way}) AS c, w.t FROM h1 h JOIN walk w ON w.f = h.t WHERE w.t <> 'C1'),
half AS MATERIALIZED (SELECT * FROM h2 WHERE len(list_filter(c, lambda x: x.t = 'C2')) = 0 OR c[2].t = 'C2'),
b1 AS (SELECT [{'f': f, 't': t, 'id': id, 'way': way}] AS c, f FROM walk WHERE t = 'C2' AND f <> 'C2'),
b2 AS MATERIALIZED (SELECT list_prepend({'f': w.f, 't': w.t, 'id': w.id, 'way': w.way}, b.c) AS c, w.f FROM b1 b JOIN walk w ON w.t = b.f WHERE w.f <> 'C2'),
found AS (SELECT c FROM h2 WHERE t = 'C2'
  UNION ALL SELECT list_concat(h.c, b.c) FROM h1 h JOIN b2 b ON b.f = h.t WHERE b.c[1].t <> 'C1'
  UNION ALL SELECT list_concat(h.c, b.c) FROM half h JOIN b2 b ON b.f = h.t WHERE h.c[2].t <> 'C2'),
shortest AS (SELECT c FROM found WHERE len(c) = (SELECT min(len(c)) FROM found)),
numbered AS (SELECT c, row_number() OVER (ORDER BY list_transform(c, lambda x: [x.t, x.id])) - 1 AS chain_index FROM shortest),
hops AS (SELECT chain_index, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS s FROM numbered)
SELECT chain_index, position, s.id AS rel_id, s.f AS from_id, s.t AS to_id, s.way AS walked_direction FROM hops"""
ORACLES["limited_chains"] = _CHAINS + """
SELECT s.q AS query_id, least(s.total, 3) AS n_chains, s.total > 3 AS truncated, nullif(least(s.total, 3), 0) AS shown, x.least_rel
FROM summary s LEFT JOIN (SELECT q, min(r1) AS least_rel FROM chains WHERE chain_index < 3 GROUP BY q) x ON x.q = s.q"""
ORACLES["distance_to_target"] = _bfs(_one("S1"), 4, "in") + " SELECT node AS entity_id, hop AS hop_count FROM reached"
ORACLES["explained_chains"] = _CHAINS + f""", {_KNOWN.strip()}
SELECT q AS query_id, chain_index, position, rel_id, ref_position, ref_id, {_KIND} FROM cited"""
ORACLES["chain_entities"] = _CHAINS + """
SELECT q AS query_id, e AS entity_id, CASE left(e, 1) WHEN 'C' THEN 'customer' WHEN 'S' THEN 'supplier' END AS entity_type, left(e, 1) IN ('C', 'S') AS found
FROM (SELECT q, f AS e FROM hops UNION SELECT q, t FROM hops UNION SELECT q, q FROM summary UNION SELECT q, 'S1' FROM summary)"""
ORACLES["root_evidence"] = f"""WITH {_KNOWN}
SELECT id AS ref_id, id AS root_id FROM known_ev
UNION ALL SELECT 'ne-o' || o_orderkey, 'ev-o' || o_orderkey FROM orders
UNION ALL SELECT DISTINCT 'ne-l' || l_orderkey || '-' || l_linenumber, 'ev-o' || l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
ORACLES["evidence_overlap"] = _CHAINS + "SELECT q AS query_id, n_chains, shared, verdict AS fully_evidence_independent FROM overlap"
ORACLES["components_of_orders"] = _components(_PLACED, 2) + """
SELECT i.component_index, l.label AS component, l.node AS entity_id
FROM label l JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS component_index FROM sized WHERE n >= 8) i ON i.label = l.label"""
ORACLES["components_of_trade"] = _components(_TRADE, 10) + """
SELECT i.component_index, l.label AS component, l.node AS entity_id
FROM label l JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS component_index FROM sized) i ON i.label = l.label"""
ORACLES["component_totals"] = _components(_PLACED, 2) + """
SELECT CAST(sum(n) AS BIGINT) AS total_entities_in_graph, (SELECT count(*) FROM rels) AS total_relationships, count(*) AS total_components_found FROM sized"""
ORACLES["component_relationships"] = _components(_PLACED, 2) + """
SELECT i.component_index, r.id AS rel_id
FROM rels r JOIN label l ON l.node = r.src JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS component_index FROM sized WHERE n >= 8) i ON i.label = l.label"""

# --- provenance -----------------------------------------------------------------------------------------------


def _tree() -> str:
    """The id tree, folded from four digits."""
    parts = ["""objects AS (
  SELECT 'evidence_items' AS c, 'ev-' || event_id AS id FROM events
  UNION ALL SELECT 'normalized_events', 'ne-' || event_id FROM events
  UNION ALL SELECT 'time_assertions', 'ta-' || event_id FROM events WHERE NOT (event_type = 'signup' AND event_id % 5 = 0))""",
        """t4 AS (SELECT c, substr(sha256(id), 1, 4) AS prefix,
  sha256('[' || string_agg('["' || id || '","' || id || '"]', ',' ORDER BY id) || ']') AS h FROM objects GROUP BY ALL)"""]
    for n in range(4, 0, -1):
        parts.append(
            f"t{n - 1} AS (SELECT c, left(prefix, {n - 1}) AS prefix, sha256(string_agg(prefix || ':' || h, ',' ORDER BY prefix)) AS h "
            f"FROM t{n} GROUP BY ALL)"
        )
    parts.append(
        "full_set AS MATERIALIZED (SELECT c, h FROM t0 UNION ALL SELECT unnest(['entities', 'hypotheses', 'relationships']), sha256('[]'))"
    )
    return "WITH " + ",\n".join(parts)


ORACLES["manifest_tree"] = _tree() + """
SELECT c AS collection, h AS hash FROM full_set
UNION ALL SELECT 'manifest', sha256('[' || string_agg('["' || c || '","' || h || '"]', ',' ORDER BY c) || ']') FROM full_set"""
ORACLES["manifest_diff"] = """
SELECT 'normalized_events' AS collection, 'ne-' || event_id AS id, 'removed' AS change FROM events WHERE event_type = 'error'
UNION ALL SELECT 'entities', 'C' || c_custkey, 'added' FROM customer UNION ALL SELECT 'entities', 'S' || s_suppkey, 'added' FROM supplier"""
_ENTITY = """sha256('{{"derived_from":["{r}' || {k} || '"],"entity_type":"{t}","first_seen":null,"id":"{p}' || {k} || '","identifiers":{{"name":"' || {n} || '"}},"last_seen":null}}')"""
ORACLES["entity_hashes"] = f"""
SELECT 'C' || c_custkey AS id, {_ENTITY.format(r="ev-c", k="c_custkey", t="customer", p="C", n="c_name")} AS hash FROM customer
UNION ALL SELECT 'S' || s_suppkey, {_ENTITY.format(r="ev-s", k="s_suppkey", t="supplier", p="S", n="s_name")} FROM supplier"""
ORACLES["overview"] = f"""WITH {_TRADE.strip()}, {_PAIRS.strip()}
SELECT (SELECT count(*) FROM events) AS evidence_count, (SELECT count(*) FROM events) AS normalized_event_count,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS entity_count, (SELECT count(*) FROM rels) AS relationship_count,
  0 AS hypothesis_count, 0 AS tracked_finding_count, (SELECT count(*) FROM pairs) AS tracked_contradiction_count, 'MATCH' AS manifest_verdict"""

# --- evaluation and study ------------------------------------------------------------------------------------------

ORACLES["baseline_predictions"] = _CHAINS + "SELECT q AS query_id, method, predicted, false_corroboration, correct FROM evaluated"
ORACLES["evaluation_groups"] = _CHAINS + f""",
tagged AS (SELECT *, unnest(list_filter([
    CASE WHEN truth IS NOT NULL AND NOT adversarial AND class <> 'PARTIAL_OVERLAP' THEN 'binary' END,
    CASE WHEN truth IS NULL AND NOT adversarial THEN 'single_path' END,
    CASE WHEN class = 'PARTIAL_OVERLAP' THEN 'partial_overlap' END,
    CASE WHEN adversarial THEN 'adversarial' END], lambda x: x IS NOT NULL)) AS grp FROM evaluated),
counted AS (SELECT grp, method, {_CONFUSION}, count(*) FILTER (WHERE false_corroboration) AS false_corroboration_count, count(*) AS cases
  FROM (SELECT *, coalesce(predicted, false) AS p, truth AS t FROM tagged) GROUP BY ALL)
SELECT grp AS "group", method, tp, fp, fn, tn, {_RATIOS}, false_corroboration_count, cases FROM counted"""
ORACLES["confusion_matrix"] = f"""WITH base AS (
  SELECT lang AS grp, quality = 1 AS t, unnest(['m1', 'm2']) AS method, n_chars FROM documents JOIN labels USING (doc_id)),
counted AS (SELECT grp, method, {_CONFUSION} FROM (SELECT *, CASE method WHEN 'm1' THEN n_chars >= 1000 ELSE n_chars >= 300 END AS p FROM base) GROUP BY ALL)
SELECT grp AS "group", method, tp, fp, fn, tn, {_RATIOS} FROM counted"""
ORACLES["pairwise_overlap"] = _CHAINS + """,
root_pairs AS (SELECT q, count(*) AS n FROM (SELECT DISTINCT a.q, a.chain_index AS i, b.chain_index AS j FROM roots a JOIN roots b
  ON a.q = b.q AND a.root_id = b.root_id AND a.chain_index < b.chain_index) GROUP BY q),
direct_pairs AS (SELECT q, count(*) AS n FROM (SELECT DISTINCT a.q, a.chain_index AS i, b.chain_index AS j FROM direct_sets a JOIN direct_sets b
  ON a.q = b.q AND a.ref_id = b.ref_id AND a.chain_index < b.chain_index) GROUP BY q),
base AS (SELECT o.q, o.verdict, n_chains * (n_chains - 1) // 2 AS total, coalesce(r.n, 0) AS rs, coalesce(d.n, 0) AS ds, n_chains
  FROM overlap o LEFT JOIN root_pairs r ON r.q = o.q LEFT JOIN direct_pairs d ON d.q = o.q)
SELECT q AS query_id, total AS total_chain_pairs, total - rs AS root_disjoint_pairs, rs AS root_overlapping_pairs,
  CASE WHEN verdict = false THEN total - rs ELSE 0 END AS root_pairs_masked, total - ds AS direct_disjoint_pairs,
  CASE WHEN NOT (n_chains >= 2 AND ds = 0) THEN total - ds ELSE 0 END AS direct_pairs_masked,
  CASE WHEN total > 0 THEN CASE WHEN verdict = false THEN total - rs ELSE 0 END / total END AS information_loss_rate FROM base"""
ORACLES["discriminator_outcomes"] = _CHAINS + "SELECT q AS query_id, direct_refs, root_evidence, truth, outcome FROM outcomes"
ORACLES["discriminator_counts"] = _CHAINS + """
SELECT count(*) FILTER (WHERE direct_refs IS DISTINCT FROM root_evidence) AS discriminator_count,
  count(*) FILTER (WHERE direct_refs IS DISTINCT FROM root_evidence AND outcome = 'root_evidence_wins') AS correct_discriminator_count,
  count(*) FILTER (WHERE outcome = 'tie') AS baseline_equivalence_count,
  count(*) FILTER (WHERE outcome <> 'root_evidence_wins') AS adversarial_defeat_count,
  count(*) FILTER (WHERE root_evidence IS DISTINCT FROM truth) AS root_evidence_error_count FROM outcomes"""
_RESPONSES = """
responses AS MATERIALIZED (
  SELECT event_id AS i, event_type, 'p' || user_id AS participant, ['path_only', 'direct_evidence', 'root_evidence'][CAST(user_id % 3 AS INTEGER) + 1] AS condition,
    'case-' || (event_id % 9) AS case_id,
    CASE WHEN event_id % 8 = 7 THEN 'case-' || (event_id % 9) || '-q-single' ELSE 'q-' || (event_id % 4) END AS question_id,
    CASE WHEN event_id % 43 = 0 THEN 'maybe' ELSE ['shared_root_evidence', 'disjoint_root_evidence', 'indeterminate'][CAST(event_id % 3 AS INTEGER) + 1] END AS answer,
    ['shared_root_evidence', 'disjoint_root_evidence'][CAST(event_id % 2 AS INTEGER) + 1] AS correct_answer,
    CASE WHEN event_id % 41 = 0 THEN -5 ELSE CAST(floor(value * 1000) AS BIGINT) END AS ms,
    event_id % 47 <> 0 AS current_version, event_id % 53 = 0 AS developer
  FROM events)
"""
_JUDGED = """,
judged AS (SELECT *, CASE WHEN NOT current_version THEN 'study_version mismatch' WHEN answer = 'maybe' THEN 'malformed answer'
  WHEN ms < 0 THEN 'negative response_time_ms' {extra} END AS reason FROM responses),
firsts AS (SELECT participant, case_id, question_id, min(i) AS first_i FROM judged WHERE reason IS NULL GROUP BY ALL),
final AS MATERIALIZED (SELECT j.*, coalesce(reason, CASE WHEN i <> first_i THEN 'duplicate response' END, 'valid') AS verdict
  FROM judged j LEFT JOIN firsts f ON f.participant = j.participant AND f.case_id = j.case_id AND f.question_id = j.question_id)
"""
ORACLES["response_validation"] = f"""WITH {_RESPONSES.strip()},
asked AS (SELECT DISTINCT case_id, question_id FROM responses WHERE event_type IN ('click', 'view') AND case_id <> 'case-8')
{_JUDGED.format(extra="WHEN case_id NOT IN (SELECT case_id FROM asked) THEN 'unknown case_id' WHEN (case_id, question_id) NOT IN (SELECT (case_id, question_id) FROM asked) THEN 'unknown question_id'")}
SELECT i AS index, verdict AS reason FROM final"""


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {whole}) > 0 THEN count(*) FILTER (WHERE ({whole}) AND {part}) / count(*) FILTER (WHERE {whole}) END"


ORACLES["condition_metrics"] = f"""WITH {_RESPONSES.strip()} {_JUDGED.format(extra="")},
good AS (SELECT * FROM final WHERE verdict = 'valid' AND NOT developer)
SELECT c.condition, count(g.i) AS response_count, {_rate("answer = correct_answer", "g.i IS NOT NULL")} AS accuracy,
  {_rate("answer = correct_answer", "correct_answer = 'shared_root_evidence'")} AS shared_root_accuracy,
  {_rate("answer = correct_answer", "correct_answer = 'disjoint_root_evidence'")} AS disjoint_root_accuracy,
  {_rate("answer = correct_answer", "NOT ends_with(question_id, '-q-single')")} AS partial_overlap_pair_accuracy,
  avg(ms) AS mean_response_time_ms, median(ms) AS median_response_time_ms,
  {_rate("answer = 'disjoint_root_evidence'", "correct_answer = 'shared_root_evidence'")} AS false_corroboration_rate,
  {_rate("answer = 'indeterminate'", "g.i IS NOT NULL")} AS indeterminate_rate,
  greatest(4000 - count(g.i), 0) / 4000 AS missing_response_rate
FROM (SELECT unnest(['path_only', 'direct_evidence', 'root_evidence']) AS condition) c LEFT JOIN good g ON g.condition = c.condition GROUP BY c.condition"""
ORACLES["study_summary"] = f"""WITH {_RESPONSES}
SELECT count(*) > 0 AS has_participant_data, count(*) AS total_participant_responses, count(DISTINCT condition) AS conditions_with_data
FROM responses WHERE NOT developer"""
_PEOPLE = "people AS (SELECT DISTINCT 'p' || user_id AS participant_id FROM events)"
ORACLES["condition_assignment"] = f"""WITH {_PEOPLE}
SELECT participant_id, ['path_only', 'direct_evidence', 'root_evidence'][CAST(list_sum(list_transform(
  string_split(sha256('study-v1-seed:' || participant_id), ''), lambda d: strpos('0123456789abcdef', d) - 1)) % 3 AS INTEGER) + 1] AS condition FROM people"""
ORACLES["case_order"] = f"""WITH {_PEOPLE}, cases AS (SELECT DISTINCT 'case-' || (event_id % 9) AS case_id FROM events)
SELECT participant_id, case_id, row_number() OVER (PARTITION BY participant_id ORDER BY sha256('study-v1-seed:' || participant_id || ':' || case_id)) - 1 AS position
FROM people, cases"""
ORACLES["answer_key"] = _CHAINS + """,
firsts AS (SELECT q, n_chains, unnest(range(n_chains)) AS i FROM overlap),
asked AS (SELECT q, i, unnest(range(i + 1, n_chains)) AS j FROM firsts),
shared_pairs AS (SELECT DISTINCT a.q, a.chain_index AS i, b.chain_index AS j FROM roots a JOIN roots b ON a.q = b.q AND a.root_id = b.root_id AND a.chain_index < b.chain_index)
SELECT k.q AS query_id, k.q || '-q-' || (k.i + 1) || '-' || (k.j + 1) AS question_id,
  CASE WHEN s.q IS NULL THEN 'disjoint_root_evidence' ELSE 'shared_root_evidence' END AS correct_answer
FROM asked k LEFT JOIN shared_pairs s ON s.q = k.q AND s.i = k.i AND s.j = k.j
UNION ALL SELECT q, q || '-q-single', 'indeterminate' FROM overlap WHERE n_chains < 2"""
ORACLES["neutral_chain_labels"] = _CHAINS + """
SELECT q AS query_id, root_id, 'E-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS label
FROM (SELECT q, root_id, row_number() OVER (PARTITION BY q ORDER BY root_id) AS rank FROM (SELECT DISTINCT q, root_id FROM roots))"""

# --- packages, claims and checks ---------------------------------------------------------------------

_PACKAGES = """
pk_lines AS MATERIALIZED (
  SELECT l_orderkey AS o, l_linenumber AS ln, 'p' || any_value(o_custkey) AS pkg, any_value(o_orderstatus) AS st, l_orderkey * 10 + l_linenumber AS pos,
    sha256('order ' || l_orderkey || ' ' || any_value(o_orderstatus)) AS ev
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber),
bad AS MATERIALIZED (SELECT * FROM pk_lines x WHERE st = 'P' AND ln = 2 AND NOT EXISTS (SELECT 1 FROM pk_lines y WHERE y.o = x.o AND y.ln = 1))
"""
ORACLES["package_errors"] = f"""WITH {_PACKAGES}
SELECT pkg AS package_id, 'normalized_events[' || pos || '] (l' || o || '-2)' AS path, 'derived_from references unknown local_id l' || o || '-1' AS message FROM bad
UNION ALL SELECT pkg, 'time_assertions[' || pos || ']', 'subject_event references unknown local_id l' || o || '-2' FROM bad"""
_PLAIN_LINE = """sha256('{"_type":"NormalizedEvent","attributes":{},"derived_from":["' || ev || '"],"event_type":"line"}')"""
ORACLES["package_events"] = f"""WITH {_PACKAGES.strip()},
refs AS (SELECT DISTINCT ev || CASE WHEN st = 'P' AND ln = 2 THEN ',' || {_PLAIN_LINE} ELSE '' END AS r FROM pk_lines WHERE pkg NOT IN (SELECT pkg FROM bad))
SELECT sha256('{{"_type":"NormalizedEvent","attributes":{{}},"derived_from":["' || replace(r, ',', '","') || '"],"event_type":"line"}}') AS id,
  'line' AS event_type, r AS derived_from FROM refs"""
ORACLES["exported_evidence"] = """
SELECT sha256(text) AS local_id, sha256(text) AS content_hash, 'documents:' || min(doc_id) AS source_locator, min(source) AS source_id
FROM documents GROUP BY 1"""
ORACLES["claimed_relationships"] = f"""WITH {_TRADE.strip()}, {_KNOWN.strip()},
broken AS (SELECT DISTINCT id FROM (SELECT id, unnest(refs) AS ref_id FROM rels)
  WHERE ref_id NOT IN (SELECT id FROM known_ev) AND ref_id NOT IN (SELECT id FROM known_ne))
SELECT id, CASE WHEN id IN (SELECT id FROM broken) THEN 'rejected' WHEN kind = 'located_in' THEN 'already existing' ELSE 'created' END AS status FROM rels"""
ORACLES["hypothesis_updates"] = """
SELECT 'h' || c_custkey AS id, coalesce(CASE WHEN arg_max(o_orderstatus, o_orderkey) <> 'F' THEN 'supported' WHEN count(o_orderkey) > 0 THEN 'contradicted' END, 'proposed') AS status,
  'ev-c' || c_custkey || coalesce(',' || string_agg('ev-o' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), '') AS supporting,
  coalesce(string_agg('ev-o' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS contradicting
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
ORACLES["hypothesis_references"] = """
SELECT 'h' || c_custkey AS id, 'supporting' AS side, NULL AS seq, 'ev-c' || c_custkey AS ref_id FROM customer
UNION ALL SELECT 'h' || o_custkey, CASE WHEN o_orderstatus <> 'F' THEN 'supporting' ELSE 'contradicting' END, o_orderkey, 'ev-o' || o_orderkey
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"""
ORACLES["relationship_checks"] = """
SELECT CASE WHEN l_returnflag = 'R' THEN 'relationship_type is blank' WHEN c_nationkey = s_nationkey THEN 'endpoints are equal'
  WHEN l_linestatus <> 'O' THEN 'derived_from is empty' ELSE 'valid' END AS reason, count(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"""
ORACLES["condition_views"] = _CHAINS + """,
labels AS (SELECT d.q, d.chain_index, d.direct_labels, r.root_labels
  FROM (SELECT q, chain_index, string_agg(ref_id, ',' ORDER BY ref_id) AS direct_labels FROM direct_sets GROUP BY ALL) d
  LEFT JOIN (SELECT q, chain_index, string_agg(root_id, ',' ORDER BY root_id) AS root_labels FROM roots GROUP BY ALL) r
  ON r.q = d.q AND r.chain_index = d.chain_index)
SELECT q AS query_id, chain_index, condition, CASE WHEN condition <> 'path_only' THEN direct_labels END AS direct_labels,
  CASE WHEN condition = 'root_evidence' THEN root_labels END AS root_labels
FROM labels, (SELECT unnest(['path_only', 'direct_evidence', 'root_evidence']) AS condition)"""
ORACLES["ground_truth_match"] = _CHAINS + """
SELECT DISTINCT q AS query_id, true AS path_count_matches, true AS root_sets_match, true AS direct_sets_match FROM two"""
