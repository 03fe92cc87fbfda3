"""SQL twins of the queries in ``stored``."""

from __future__ import annotations

from provenir.plans.oracles import (
    _CHAINS, _DAY2, _ENTITY, _EVENT_CLAIMS, _GAP_ID, _JSON_LINES, _JUDGED, _KIND, _KNOWN, _MATCHED, _PAIR_ID, _PAIRS, _QUIET, _RESPONSES, _TRADE,
    ORACLES, _points,
)

_CSV = """CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR)
    WHEN event_id % 7 = 0 THEN event_id || ', seen ,"' || replace(props, '"', '""') || '",more,still'
    ELSE event_id || ', seen ,"' || replace(props, '"', '""') || '"' END"""
_SYSLOG = """CASE WHEN event_id % 13 = 0 THEN 'no syslog line '
    WHEN event_id % 3 = 0 THEN strftime(ts, '%b %-d %H:%M:%S') || ' host' || user_id || ' ' || event_type || ': value=' || user_id || ' ok'
    ELSE strftime(ts, '%b %-d %H:%M:%S') || '  host' || user_id || ' ' || event_type || '[' || event_id || ']: value=' || user_id || ' ok' END"""
ORACLES["ingested_files"] = f"""WITH {_JSON_LINES.strip()},
every AS (SELECT 'jsonl' AS a, line FROM json_lines UNION ALL SELECT 'csv_timeline', {_CSV} FROM events UNION ALL SELECT 'syslog', {_SYSLOG} FROM events)
SELECT sha256(line) AS id, a AS source_adapter, 'host1' AS source_id, 'adapter:' || a || '@0.1.0' AS actor, count(*) AS copies FROM every GROUP BY ALL"""
ORACLES["ingest_counts"] = """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 13 <> 0) AS good FROM events)
SELECT 'jsonl' AS source_adapter, n AS evidence_count, good AS normalized_event_count, good AS time_assertion_count FROM n
UNION ALL SELECT 'csv_timeline', n, n, 0 FROM n UNION ALL SELECT 'syslog', n, good, 0 FROM n"""

_HYPOTHESIS = """sha256('{"contradicting_evidence":[],"created_at":"2026-01-01T00:00:00Z","id":"h' || c_custkey || '","inferred_by":"ana","statement":"pays","status":"proposed","supporting_evidence":[{"id":"ev-c' || c_custkey || '","kind":"evidence_item"}]}')"""
ORACLES["manifest_list"] = f"""WITH {_TRADE.strip()},
objects AS (
  SELECT 'evidence_items' AS c, 'ev-' || event_id AS id, 'ev-' || event_id AS h FROM events
  UNION ALL SELECT 'normalized_events', 'ne-' || event_id, 'ne-' || event_id FROM events
  UNION ALL SELECT 'time_assertions', 'ta-' || event_id, 'ta-' || event_id FROM events WHERE NOT (event_type = 'signup' AND event_id % 5 = 0)
  UNION ALL SELECT 'relationships', id, id FROM rels
  UNION ALL SELECT 'entities', 'C' || c_custkey, {_ENTITY.format(r="ev-c", k="c_custkey", t="customer", p="C", n="c_name")} FROM customer
  UNION ALL SELECT 'entities', 'S' || s_suppkey, {_ENTITY.format(r="ev-s", k="s_suppkey", t="supplier", p="S", n="s_name")} FROM supplier
  UNION ALL SELECT 'hypotheses', 'h' || c_custkey, {_HYPOTHESIS} FROM customer),
lists AS MATERIALIZED (SELECT c, sha256('[' || string_agg('["' || id || '","' || h || '"]', ',' ORDER BY id) || ']') AS h FROM objects GROUP BY c)
SELECT c AS collection, h AS hash, 3 AS manifest_version FROM lists
UNION ALL SELECT 'manifest', sha256('[' || string_agg('["' || c || '","' || h || '"]', ',' ORDER BY c) || ']'), 3 FROM lists"""
_COUNTS = """SELECT (SELECT count(*) FROM events) AS evidence_count, (SELECT count(*) FROM events) AS normalized_event_count,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS entity_count, (SELECT count(*) FROM rels) AS relationship_count,
  (SELECT count(*) FROM customer) AS hypothesis_count"""
ORACLES["snapshot_round_trip"] = f"""WITH {_TRADE.strip()}
{_COUNTS}, 0 AS tracked_finding_count, 0 AS tracked_contradiction_count, 'MATCH' AS manifest_verdict"""
ORACLES["manifest_verdicts"] = """
SELECT 'unrecorded' AS compared, 'NO_RECORDED_MANIFEST' AS verdict, true AS matches UNION ALL SELECT 'other_depth', 'NOT_COMPARABLE', false
UNION ALL SELECT 'same', 'MATCH', true
UNION ALL SELECT 'without_errors', CASE WHEN count(*) > 0 THEN 'MISMATCH' ELSE 'MATCH' END, count(*) = 0 FROM events WHERE event_type = 'error'"""
ORACLES["custody_growth"] = """
SELECT unnest(['entities', 'evidence_items', 'hypotheses', 'manifest', 'normalized_events', 'relationships', 'time_assertions']) AS collection, true AS same,
  CAST(2 * sum(CASE WHEN user_id % 10 = 8 AND event_type = 'error' THEN 2 ELSE 1 END) AS BIGINT) AS n_custody, count(*) AS n_items FROM events"""

_EVEN = "CAST(substr(subject, 2) AS BIGINT) % 2 = 0"
ORACLES["contradiction_track_counts"] = f"""WITH {_PAIRS}
SELECT count(*) FILTER (WHERE NOT {_EVEN}) AS "new", count(*) FILTER (WHERE {_EVEN}) AS already_tracked, count(*) AS "rows",
  count(*) FILTER (WHERE {_EVEN}) AS notes FROM pairs"""
ORACLES["gap_track_counts"] = f"""WITH {_points(_DAY2).strip()} {_MATCHED}, {_QUIET},
before AS MATERIALIZED (SELECT {_GAP_ID} AS id FROM q_findings),
after AS MATERIALIZED (SELECT {_GAP_ID} AS id FROM findings)
SELECT (SELECT count(*) FROM after WHERE id NOT IN (SELECT id FROM before)) AS "new",
  (SELECT count(*) FROM after WHERE id IN (SELECT id FROM before)) AS already_tracked,
  (SELECT count(*) FROM (SELECT id FROM before UNION SELECT id FROM after)) AS "rows\""""
ORACLES["tracked_contradiction_list"] = f"""WITH {_PAIRS}
SELECT {_PAIR_ID} AS id, subject AS subject_event_id, 'open' AS status, 2 AS n_claims FROM pairs"""
ORACLES["stream_ingest"] = f"""WITH {_JSON_LINES}
SELECT DISTINCT sha256(line) AS id, octet_length(encode(line)) AS raw_size_bytes, CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 13 <> 0 THEN us END AS value_us FROM json_lines"""
ORACLES["stream_tracking"] = ORACLES["contradiction_tracking"]

ORACLES["package_file_errors"] = """
WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS package, 's' || s_suppkey AS own, 'n' || s_nationkey AS home FROM supplier),
unknown AS (SELECT ' references unknown local_id ' AS u)
SELECT package, '<root>' AS path, 'unsupported schema_version' AS message FROM s WHERE k % 11 = 0
UNION ALL SELECT package, 'normalized_events[0]', 'unknown field' FROM s WHERE k % 7 = 0
UNION ALL SELECT package, 'evidence_items[1] (e2)', 'invalid content_base64' FROM s WHERE k % 5 = 0
UNION ALL SELECT package, 'normalized_events[0] (v1)', 'derived_from' || u || 'e2' FROM s, unknown WHERE k % 5 = 0
UNION ALL SELECT package, 'entities[0] (' || own || ')', 'derived_from' || u || 'v1' FROM s, unknown WHERE k % 5 = 0
UNION ALL SELECT package, 'relationships[0]', 'derived_from' || u || 'v1' FROM s, unknown WHERE k % 5 = 0
UNION ALL SELECT package, 'relationships[0]', 'source_entity' || u || own FROM s, unknown WHERE k % 5 = 0
UNION ALL SELECT package, 'time_assertions[0]', 'subject_event' || u || 'v1' FROM s, unknown WHERE k % 5 = 0
UNION ALL SELECT package, 'entities[1] (' || home || ')', 'derived_from' || u || 'e9' FROM s, unknown WHERE k % 13 = 0
UNION ALL SELECT package, 'relationships[0]', 'target_entity' || u || home FROM s, unknown WHERE k % 13 = 0"""
ORACLES["package_file_records"] = """
WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS own, 'n' || s_nationkey AS home, sha256('supplier ' || s_suppkey) AS e1, sha256(s_name) AS e2
  FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 11 > 0 AND s_suppkey % 13 > 0),
v AS (SELECT *, sha256('{"_type":"NormalizedEvent","attributes":{},"derived_from":["' || e1 || '","' || e2 || '"],"event_type":"joined"}') AS ev FROM s),
every AS (
  SELECT 'evidence_items' AS collection, e1 AS id, 'collected_at,content,ingest_parameters,local_id,source_id,source_locator' AS fields, e1 AS one FROM v
  UNION ALL SELECT 'evidence_items', e2, 'collected_at,content,ingest_parameters,local_id,source_locator', e2 FROM v
  UNION ALL SELECT 'normalized_events', ev, 'attributes,created_at,derived_from,event_type,local_id', ev FROM v
  UNION ALL SELECT 'entities', unnest([own, home]), 'derived_from,entity_type,identifiers,local_id', unnest([own, home]) FROM v
  UNION ALL SELECT 'relationships', unnest([r]), 'attributes,created_at,derived_from,local_id,relationship_type,source_entity,target_entity', unnest([r]) FROM (
    SELECT sha256('{"_type":"Relationship","attributes":{},"derived_from":["' || ev || '"],"relationship_type":"located_in","source_entity_id":"' || own || '","target_entity_id":"' || home || '"}') AS r FROM v)
  UNION ALL SELECT 'time_assertions', t, 'asserted_by,created_at,local_id,precision,source_evidence,subject_event,value', t FROM (
    SELECT sha256('{"_type":"TimeAssertion","asserted_by":"erp","precision":"day","source_evidence_id":"' || e1 || '","subject_event_id":"' || ev || '","value":"2026-01-01T00:00:00Z"}') AS t FROM v)
  UNION ALL SELECT 'hypotheses', CASE WHEN k % 2 = 0 THEN 'h' || k ELSE 'new' END,
    'contradicting_evidence,created_at,inferred_by,local_id,statement,status,supporting_evidence', CAST(k AS VARCHAR) FROM v)
SELECT collection, id, fields, count(DISTINCT one) AS n FROM every GROUP BY ALL"""

ORACLES["one_record"] = f"""WITH {_TRADE.strip()}
SELECT 'C1' AS id, 'customer' AS kind, 'ev-c1' AS derived_from UNION ALL
SELECT id, kind, array_to_string(refs, ',') FROM rels WHERE src = 'C1' AND kind = 'located_in'"""
ORACLES["one_reference"] = f"WITH {_KNOWN.strip()} SELECT ref_id, {_KIND} FROM (SELECT unnest(['ev-o1', 'ne-o1', 'nothing']) AS ref_id)"
ORACLES["existing_references"] = f"""WITH {_TRADE.strip()}, {_KNOWN.strip()}
SELECT DISTINCT ref_id FROM (SELECT unnest(refs) AS ref_id FROM rels) WHERE ref_id IN (SELECT id FROM known_ev)"""
ORACLES["hypothesis_list"] = "SELECT 'h' || c_custkey AS id, 'pays' AS statement, 'proposed' AS status, 'ana' AS inferred_by, 1 AS n_supporting FROM customer"
ORACLES["nested_results"] = _CHAINS + """,
n1 AS MATERIALIZED (SELECT dst AS node, min(id) AS rel_id FROM rels WHERE src = 'C1' GROUP BY dst),
n2 AS (SELECT r.dst AS node, arg_min(r.id, n1.rel_id || r.id) AS rel_id FROM n1 JOIN rels r ON r.src = n1.node
  WHERE r.dst <> 'C1' AND r.dst NOT IN (SELECT node FROM n1) GROUP BY r.dst)
SELECT 'chain' AS shape, q || '/' || chain_index AS id, 2 AS n, r1 AS first FROM chains
UNION ALL SELECT 'neighbor', node, 1, rel_id FROM n1 UNION ALL SELECT 'neighbor', node, 2, rel_id FROM n2
UNION ALL SELECT 'component', 'C' || o_custkey, 1 + count(DISTINCT o_orderkey), 'C' || o_custkey FROM orders GROUP BY o_custkey HAVING 1 + count(DISTINCT o_orderkey) >= 8"""
ORACLES["report_sections"] = f"""WITH {_TRADE.strip()}, {_PAIRS.strip()}, {_EVENT_CLAIMS.strip()}
SELECT 'manifest' AS section, 7 AS n UNION ALL SELECT 'verdict', 1 UNION ALL SELECT 'evidence', count(*) FROM events
UNION ALL SELECT 'custody', CAST(sum(CASE WHEN user_id % 10 = 8 AND event_type = 'error' THEN 2 ELSE 1 END) AS BIGINT) FROM events
UNION ALL SELECT 'timeline', count(*) FROM events UNION ALL SELECT 'timeline_claims', count(*) FROM event_claims
UNION ALL SELECT 'entities', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'relationships', count(*) FROM rels
UNION ALL SELECT 'hypotheses', count(*) FROM customer UNION ALL SELECT 'contradictions', 0 UNION ALL SELECT 'tracked_findings', 0
UNION ALL SELECT 'tracked_contradictions', count(*) FROM pairs"""

ORACLES["response_files"] = f"""WITH {_RESPONSES.strip()} {_JUDGED.format(extra="")}
SELECT verdict AS reason, count(*) AS n FROM final GROUP BY 1"""
ORACLES["scored_responses"] = f"""WITH {_RESPONSES.strip()},
answers AS (SELECT case_id, question_id, max(correct_answer) AS key_answer FROM responses WHERE question_id <> 'q-3' GROUP BY ALL)
SELECT i AS index, key_answer, answer = key_answer AS "right" FROM responses LEFT JOIN answers USING (case_id, question_id)"""
ORACLES["case_manifest"] = """
SELECT sha256('[' || string_agg('{"answer_key_version":"v1","case_id":"case-' || c_custkey || '","case_type":"' || c_mktsegment || '","chain_count":2,"fixture_id":"f' ||
  c_nationkey || '","path_count":' || c_nationkey || ',"question_ids":["a","q-' || c_custkey || '"]}', ',' ORDER BY c_custkey) || ']') AS case_manifest_hash FROM customer"""
ORACLES["record_checks"] = """
WITH judged AS (
  SELECT 'evidence' AS record, CASE WHEN event_id % 3 = 0 THEN 'id differs from raw_content_hash' WHEN event_id % 5 = 0 THEN 'raw_size_bytes is negative' ELSE 'valid' END AS reason FROM events
  UNION ALL SELECT 'custody', CASE WHEN event_id % 3 = 0 THEN 'source_id has outer white space' WHEN event_id % 5 = 0 THEN 'source_id is empty' ELSE 'valid' END FROM events
  UNION ALL SELECT 'event', CASE WHEN event_id % 3 = 0 THEN 'event_type is blank' WHEN event_id % 5 = 0 THEN 'derived_from is empty' ELSE 'valid' END FROM events
  UNION ALL SELECT 'claim', CASE WHEN event_id % 3 = 0 THEN 'value is missing' WHEN event_id % 5 = 0 THEN 'precision is unknown' ELSE 'valid' END FROM events
  UNION ALL SELECT 'entity', CASE WHEN event_id % 3 = 0 THEN 'entity_type is blank' WHEN event_id % 5 = 0 THEN 'derived_from is empty' ELSE 'valid' END FROM events
  UNION ALL SELECT 'hypothesis', CASE WHEN event_id % 3 = 0 THEN 'statement is blank' WHEN event_id % 5 = 0 THEN 'inferred_by is blank' WHEN event_id % 11 = 0 THEN 'status is unknown'
    WHEN event_id % 14 = 0 THEN 'a reference kind is unknown' WHEN event_id % 2 = 1 THEN 'no evidence is referenced' ELSE 'valid' END FROM events)
SELECT record, reason, count(*) AS n FROM judged GROUP BY ALL"""
ORACLES["batch_ingest"] = f"""WITH {_JSON_LINES.strip()},
every AS (SELECT 'jsonl' AS a, line, event_id % 13 <> 0 AS good FROM json_lines UNION ALL SELECT 'csv_timeline', {_CSV}, true FROM events
  UNION ALL SELECT 'syslog', {_SYSLOG}, event_id % 13 <> 0 FROM events)
SELECT sha256(line) AS id, a AS source_adapter, count(*) AS n_custody, CASE WHEN bool_or(good) THEN 1 END AS n_events FROM every GROUP BY ALL"""
ORACLES["nested_custody"] = """
SELECT 'ev-' || event_id AS id, CASE WHEN user_id % 10 = 8 AND event_type = 'error' THEN 2 ELSE 1 END AS n,
  CASE WHEN user_id % 10 <> 9 THEN 'u' || user_id END AS "first",
  CASE WHEN user_id % 10 = 8 AND event_type = 'error' THEN 'x' || user_id WHEN user_id % 10 <> 9 THEN 'u' || user_id END AS "last" FROM events"""
ORACLES["nested_timeline"] = "SELECT 'ne-' || event_id AS id, 1 AS n, 'ta-' || event_id AS \"first\" FROM events WHERE event_type = 'error'"
ORACLES["chains_to_many_targets"] = f"""WITH {_TRADE.strip()},
q AS (SELECT 'C' || c_custkey AS query_id, 'S' || (c_custkey % (SELECT count(*) FROM supplier)) AS target FROM customer),
n AS (SELECT q.query_id, count(*) AS n FROM q JOIN rels a ON a.src = q.query_id AND a.kind = 'placed' JOIN rels b ON b.src = a.dst AND b.dst = q.target GROUP BY 1)
SELECT q.query_id, target, n IS NOT NULL AS found, CASE WHEN n IS NOT NULL THEN 2 END AS hop_count, coalesce(n, 0) AS n_chains FROM q LEFT JOIN n USING (query_id)"""

_CASE_DOC = """'{"answer_key_version":"v1","case_id":"case-' || c_custkey || '","case_type":"' || c_mktsegment || '","chain_count":2,"fixture_id":"f' ||
  c_nationkey || '","path_count":' || c_nationkey || ',"question_ids":["a","q-' || c_custkey || '"]}'"""
ORACLES["case_tree"] = f"""
WITH t4 AS (SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 4) AS p,
  sha256('[' || string_agg('["' || c_custkey || '","' || sha256({_CASE_DOC}) || '"]', ',' ORDER BY CAST(c_custkey AS VARCHAR)) || ']') AS h FROM customer GROUP BY 1),
t3 AS (SELECT left(p, 3) AS p, sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM t4 GROUP BY left(t4.p, 3)),
t2 AS (SELECT left(p, 2) AS p, sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM t3 GROUP BY left(t3.p, 2)),
t1 AS (SELECT left(p, 1) AS p, sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS h FROM t2 GROUP BY left(t2.p, 1))
SELECT sha256(string_agg(p || ':' || h, ',' ORDER BY p)) AS case_tree_hash, 4 AS digits FROM t1"""
ORACLES["stored_tree_diff"] = ORACLES["manifest_diff"]
ORACLES["stored_tree_manifest"] = ORACLES["manifest_tree"].replace("'ne-' || event_id FROM events", "'ne-' || event_id FROM events WHERE event_type != 'error'")
