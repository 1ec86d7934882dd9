"""Canonical JSON rows of the order log in SQL, for digest and payload checks."""

ROWS = """
ev_attr AS (
  SELECT v.event_id, v.event_type, v.ts, v.session_id, v.k, CASE v.event_type
    WHEN 'session_start' THEN '{"run_id":"orders","seed":' || v.k || '}'
    WHEN 'call_llm' THEN '{"max_tokens":1024,"purpose":"summary","temperature":' ||
      (CASE v.k % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END) || '}'
    WHEN 'handoff' THEN '{"handoff_kind":"line"}'
    WHEN 'retrieve_data' THEN '{"record_count":' ||
      ((CAST(split_part(v.event_id, '-', 3) AS INTEGER) - 1) // 2) || '}'
    WHEN 'grant_approval' THEN '{"authority_level":' || (a.s % 4) || '}'
    WHEN 'make_decision' THEN '{"adverse":' || (CASE WHEN o.status = 'F' THEN 'false' ELSE 'true' END) ||
      ',"outcome":"' || o.outcome || '","reason_codes":["RC01","RC1' || (v.k % 7) || '"],"score":' ||
      CAST(floor(o.price) AS BIGINT) || '}'
    WHEN 'emit_reasoning' THEN '{"reasoning_kind":"rationale"}'
    ELSE '{"duration_seconds":14520,"outcome":"' || o.outcome || '"}' END AS attrs
  FROM ev v JOIN sess o ON o.k = v.k LEFT JOIN approvals a ON a.k = v.k
),
obj AS (
  SELECT session_id AS object_id, 'Session' AS object_type,
    '{"session_id":"' || session_id || '","workflow_name":"credit_scoring"}' AS attrs FROM sess
  UNION ALL SELECT 'APP-' || k, 'Application', '{"amount":' || CAST(floor(price) AS BIGINT) ||
    ',"application_id":"APP-' || k || '","submitted_at":"' || strftime(t0, '%Y-%m-%dT%H:%M:%SZ') || '"}' FROM sess
  UNION ALL SELECT 'DEC-' || k, 'CreditDecision', '{"decision_id":"DEC-' || k || '","outcome":"' || outcome ||
    '","reason_codes":' || (CASE WHEN k % 13 = 0 THEN '[]' ELSE '["RC01","RC1' || (k % 7) || '"]' END) || '}' FROM sess
  UNION ALL SELECT 'CUS-' || c_custkey, 'Applicant', '{"applicant_id":"CUS-' || c_custkey ||
    '","jurisdiction":"N' || c_nationkey || '"}' FROM customer
  UNION ALL SELECT object_id, 'DataResource', '{"classification":"' || classification || '","lawful_basis":"' ||
    lawful_basis || '","resource_type":"' || resource_type || '"}' FROM resource
  UNION ALL SELECT DISTINCT 'POL-' || policy, 'PolicyVersion', '{"effective_to":"' ||
    (CASE WHEN policy = '5' THEN '2026-01-31T23:59:59Z' ELSE '' END) || '","version":"2026.' || policy || '"}' FROM sess
  UNION ALL SELECT object_id, 'HumanApprover', '{"approver_id":"' || object_id || '","role":"' || role || '"}' FROM approver_role
  UNION ALL SELECT 'AGT-' || i, 'Agent', '{"agent_id":"AGT-' || i || '","role":"' ||
    (CASE i WHEN 0 THEN 'intake' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'scoring' ELSE 'adjudication' END) ||
    '","version":"1.' || i || '"}' FROM generate_series(0, 3) g(i)
  UNION ALL SELECT 'MDL-' || i, 'Model', '{"model_id":"MDL-' || i || '","version":"2.' || i || '"}' FROM generate_series(0, 2) g(i)
),
log_row AS (
  SELECT sha256('event:' || sha256('{"attributes":' || attrs || ',"id":"' || event_id || '","time":"' ||
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","type":"' || event_type || '"}')) AS h FROM ev_attr
  UNION ALL SELECT sha256('e2o:' || sha256('{"event":"' || event_id || '","object":"' || object_id ||
    '","qualifier":"' || qualifier || '"}')) FROM edge
  UNION ALL SELECT sha256('object:' || sha256('{"attributes":' || attrs || ',"id":"' || object_id ||
    '","type":"' || object_type || '"}')) FROM obj
  UNION ALL SELECT sha256('o2o:' || sha256('{"qualifier":"' || qualifier || '","source":"' || source_id ||
    '","target":"' || target_id || '"}')) FROM o2o
),
log_digest AS (
  SELECT sha256(string_agg(d, '' ORDER BY d)) AS digest FROM (
    SELECT sha256(string_agg(d, '' ORDER BY d)) AS d FROM (
      SELECT substr(h, 1, 6) AS p, sha256(string_agg(d, '' ORDER BY d)) AS d FROM (
        SELECT h, sha256(h || ':' || count(*)) AS d FROM log_row GROUP BY h) GROUP BY 1)
    GROUP BY substr(p, 1, 3))
)"""
