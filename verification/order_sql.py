"""The order-table event log written in plain SQL, shared by the oracle queries."""

PRELUDE = """
lines0 AS (
  SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s
  FROM lineitem GROUP BY l_orderkey, l_linenumber
),
sess AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, o_totalprice AS price,
         o_orderdate AS t0, substr(o_orderpriority, 1, 1) AS policy,
         'SES-' || o_orderkey AS session_id,
         CASE o_orderstatus WHEN 'F' THEN 'grant' WHEN 'O' THEN 'deny' ELSE 'refer' END AS outcome
  FROM orders
),
lines AS (
  SELECT l.k, l.n, l.p, l.s, l.s % 4 AS agent,
         lag(l.s % 4) OVER (PARTITION BY l.k ORDER BY l.n) AS sender,
         o.c, o.status, o.t0, o.session_id
  FROM lines0 l JOIN sess o ON o.k = l.k
),
handed AS (
  SELECT *,
    CASE WHEN p % 11 = 1 THEN
      (CASE WHEN sender <> 0 AND agent <> 0 THEN 0 WHEN sender <> 1 AND agent <> 1 THEN 1
            ELSE 2 END)
      ELSE agent END AS receiver
  FROM lines WHERE sender IS NOT NULL AND sender <> agent AND p % 11 <> 0
),
approvals AS (
  SELECT * FROM (
    SELECT l.*, CASE WHEN p % 10 = 0 THEN k + 1 ELSE k END AS decision,
           CASE WHEN s % 7 = 0 THEN 240 ELSE 120 END AS minute
    FROM lines l WHERE n = 1) a
  WHERE decision IN (SELECT k FROM sess)
),
ev AS (
  SELECT 'EV-' || k || '-000-session_start' AS event_id, 'session_start' AS event_type,
         t0 AS ts, session_id, k FROM sess
  UNION ALL SELECT 'EV-' || k || '-001-call_llm', 'call_llm', t0 + INTERVAL 1 MINUTE, session_id, k FROM sess
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n AS VARCHAR), 3, '0') || '-handoff', 'handoff',
         t0 + to_minutes(2*n), session_id, k FROM handed
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n+1 AS VARCHAR), 3, '0') || '-retrieve_data',
         'retrieve_data', t0 + to_minutes(2*n+1), session_id, k FROM lines
  UNION ALL SELECT 'EV-' || k || '-' || minute || '-grant_approval', 'grant_approval',
         t0 + to_minutes(minute), session_id, k FROM approvals
  UNION ALL SELECT 'EV-' || k || '-240-make_decision', 'make_decision', t0 + INTERVAL 240 MINUTE, session_id, k FROM sess
  UNION ALL SELECT 'EV-' || k || '-241-emit_reasoning', 'emit_reasoning', t0 + INTERVAL 241 MINUTE, session_id, k FROM sess
  UNION ALL SELECT 'EV-' || k || '-242-session_end', 'session_end', t0 + INTERVAL 242 MINUTE, session_id, k FROM sess
),
edge AS (
  SELECT event_id, session_id AS object_id, 'Session' AS object_type, 'within' AS qualifier FROM ev
  UNION ALL SELECT event_id, 'APP-' || k, 'Application', 'concerns' FROM ev
  UNION ALL SELECT 'EV-' || k || '-000-session_start', 'CUS-' || c, 'Applicant', 'concerns' FROM sess
  UNION ALL SELECT 'EV-' || k || '-240-make_decision', 'CUS-' || c, 'Applicant', 'concerns' FROM sess
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n+1 AS VARCHAR), 3, '0') || '-retrieve_data',
         'CUS-' || c, 'Applicant', 'concerns' FROM lines
  UNION ALL SELECT 'EV-' || k || '-000-session_start', 'POL-' || policy, 'PolicyVersion', 'governed_by' FROM sess
  UNION ALL SELECT 'EV-' || k || '-240-make_decision', 'POL-' || policy, 'PolicyVersion', 'governed_by' FROM sess
  UNION ALL SELECT 'EV-' || k || '-000-session_start', 'POL-5', 'PolicyVersion', 'declares' FROM sess
         WHERE k % 5 = 0 AND policy <> '5'
  UNION ALL SELECT 'EV-' || k || '-001-call_llm', 'AGT-0', 'Agent', 'performed_by' FROM sess
  UNION ALL SELECT 'EV-' || k || '-001-call_llm', 'MDL-' || (k % 3), 'Model', 'uses' FROM sess
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n AS VARCHAR), 3, '0') || '-handoff',
         'AGT-' || sender, 'Agent', 'from' FROM handed
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n AS VARCHAR), 3, '0') || '-handoff',
         'AGT-' || receiver, 'Agent', 'to' FROM handed
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n+1 AS VARCHAR), 3, '0') || '-retrieve_data',
         'AGT-' || agent, 'Agent', 'performed_by' FROM lines
  UNION ALL SELECT 'EV-' || k || '-' || lpad(CAST(2*n+1 AS VARCHAR), 3, '0') || '-retrieve_data',
         'RES-' || p, 'DataResource', 'reads' FROM lines
  UNION ALL SELECT 'EV-' || k || '-' || minute || '-grant_approval', 'HUM-' || s, 'HumanApprover', 'performed_by' FROM approvals
  UNION ALL SELECT 'EV-' || k || '-' || minute || '-grant_approval', 'DEC-' || decision, 'CreditDecision', 'approves' FROM approvals
  UNION ALL SELECT 'EV-' || k || '-240-make_decision', 'DEC-' || k, 'CreditDecision', 'produces' FROM sess
  UNION ALL SELECT 'EV-' || k || '-241-emit_reasoning', 'DEC-' || k, 'CreditDecision', 'explains' FROM sess WHERE c % 9 <> 0
  UNION ALL SELECT 'EV-' || k || '-242-session_end', 'DEC-' || k, 'CreditDecision', 'concerns' FROM sess
),
rel AS (
  SELECT e.event_id, v.event_type, v.ts, v.session_id, e.object_id, e.object_type, e.qualifier
  FROM edge e JOIN ev v ON v.event_id = e.event_id
),
o2o AS (
  SELECT 'APP-' || k AS source_id, 'CUS-' || c AS target_id, 'submitted_by' AS qualifier FROM sess
  UNION ALL SELECT 'DEC-' || k, 'APP-' || k, 'derived_from' FROM sess WHERE k % 17 <> 0
  UNION ALL SELECT DISTINCT 'AGT-' || sender, 'AGT-' || receiver, 'delegates_to' FROM handed
),
approver_role AS (
  SELECT 'HUM-' || s_suppkey AS object_id,
         CASE s_nationkey % 4 WHEN 0 THEN 'credit_officer' WHEN 1 THEN 'risk_manager'
              WHEN 2 THEN 'contractor' ELSE 'intern' END AS role FROM supplier
),
resource AS (
  SELECT 'RES-' || p_partkey AS object_id, p_type AS resource_type,
         CASE WHEN p_type = 'PROMO' THEN 'special_category' ELSE 'internal' END AS classification,
         CASE WHEN p_size % 2 = 0 THEN '' ELSE 'art10' END AS lawful_basis FROM part
)
"""

VIOLATIONS = {
    "T1": """
t1 AS (
  SELECT d.event_id, d.ts, d.session_id, d.object_id AS decision_id
  FROM rel d JOIN sess o ON o.session_id = d.session_id
  WHERE d.event_type = 'make_decision' AND d.qualifier = 'produces' AND o.outcome IN ('grant', 'deny')
),
appr AS (
  SELECT a.event_id, a.ts, a.session_id, a.object_id AS decision_id, h.object_id AS approver, r.role
  FROM rel a JOIN rel h ON h.event_id = a.event_id AND h.object_type = 'HumanApprover'
  JOIN approver_role r ON r.object_id = h.object_id
  WHERE a.event_type = 'grant_approval' AND a.qualifier = 'approves'
),
t1_open AS (
  SELECT d.*,
    (SELECT min({'ts': a.ts, 'id': a.event_id}) FROM appr a
      WHERE a.decision_id = d.decision_id AND a.ts < d.ts) AS prior,
    (SELECT min({'ts': a.ts, 'id': a.event_id}) FROM appr a
      WHERE a.session_id = d.session_id) AS insess
  FROM t1 d
  WHERE NOT EXISTS (SELECT 1 FROM appr a WHERE a.decision_id = d.decision_id AND a.ts < d.ts
                    AND a.role IN ('credit_officer', 'senior_underwriter', 'risk_manager'))
),
v_t1 AS (
  SELECT 'T1.synchronised_approval' AS constraint_id,
    CASE WHEN prior IS NOT NULL THEN prior.id
         WHEN insess IS NULL THEN t.event_id
         WHEN insess.ts < t.ts OR (insess.ts = t.ts AND insess.id < t.event_id)
           THEN insess.id || ',' || t.event_id
         ELSE t.event_id || ',' || insess.id END AS events,
    CASE WHEN prior IS NOT NULL THEN p.approver
         WHEN insess IS NULL OR i.decision_id = t.decision_id THEN t.decision_id
         ELSE t.decision_id || ',' || i.decision_id END AS objects,
    CASE WHEN prior IS NOT NULL THEN p.session_id ELSE t.session_id END AS session_id,
    'high' AS severity
  FROM t1_open t LEFT JOIN appr p ON p.event_id = t.prior.id
  LEFT JOIN appr i ON i.event_id = t.insess.id
)""",
    "T2": """
v_t2 AS (
  SELECT 'T2.mandatory_data_coverage' AS constraint_id, d.event_id AS events, '' AS objects,
         d.session_id, 'medium' AS severity
  FROM ev d WHERE d.event_type = 'make_decision' AND (
    SELECT count(DISTINCT q.resource_type)
    FROM rel r JOIN rel a ON a.event_id = r.event_id AND a.object_type = 'Application'
    JOIN resource q ON q.object_id = r.object_id
    WHERE r.event_type = 'retrieve_data' AND r.qualifier = 'reads'
      AND a.object_id = 'APP-' || d.k AND q.resource_type IN ('ECONOMY', 'SMALL')) < 2
)""",
    "T3": """
first_act AS (
  SELECT session_id, object_id AS agent, min({'ts': ts, 'id': event_id}) AS f
  FROM rel WHERE qualifier = 'performed_by' AND object_type = 'Agent' GROUP BY 1, 2
),
orphan AS (
  SELECT f.* FROM first_act f WHERE f.agent <> 'AGT-0' AND NOT EXISTS (
    SELECT 1 FROM rel h WHERE h.event_type = 'handoff' AND h.qualifier = 'to'
      AND h.session_id = f.session_id AND h.object_id = f.agent AND h.ts < f.f.ts)
),
placed AS (
  SELECT event_id, lag(event_type) OVER w AS before_type, lag(event_id) OVER w AS before_id
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)
),
orphan_at AS (
  SELECT o.session_id, o.agent, o.f.id AS event_id,
         CASE WHEN p.before_type = 'handoff' THEN p.before_id END AS handoff_id
  FROM orphan o JOIN placed p ON p.event_id = o.f.id
),
hand AS (
  SELECT a.session_id, a.ts, a.event_id, a.object_id AS u, b.object_id AS v
  FROM rel a JOIN rel b ON b.event_id = a.event_id AND b.qualifier = 'to'
  WHERE a.event_type = 'handoff' AND a.qualifier = 'from'
    AND a.event_id NOT IN (SELECT handoff_id FROM orphan_at WHERE handoff_id IS NOT NULL)
),
e1 AS (SELECT DISTINCT session_id, u, v FROM hand),
e2 AS (SELECT * FROM e1 UNION SELECT a.session_id, a.u, b.v FROM e1 a JOIN e1 b ON a.session_id = b.session_id AND a.v = b.u),
e4 AS (SELECT * FROM e2 UNION SELECT a.session_id, a.u, b.v FROM e2 a JOIN e2 b ON a.session_id = b.session_id AND a.v = b.u),
cyc AS (
  SELECT h.* FROM hand h JOIN e4 r ON r.session_id = h.session_id AND r.u = h.v AND r.v = h.u
),
v_t3 AS (
  SELECT 'T3.delegation_integrity' AS constraint_id,
    CASE WHEN handoff_id IS NULL THEN event_id ELSE handoff_id || ',' || event_id END AS events,
    agent AS objects, session_id, 'medium' AS severity
  FROM orphan_at
  UNION ALL
  SELECT 'T3.delegation_integrity', string_agg(event_id, ',' ORDER BY ts, event_id),
    (SELECT string_agg(n, ',' ORDER BY n) FROM (
       SELECT u AS n FROM cyc x WHERE x.session_id = c.session_id
       UNION SELECT v FROM cyc x WHERE x.session_id = c.session_id)), session_id, 'medium'
  FROM cyc c GROUP BY session_id
)""",
    "T4": """
v_t4 AS (
  SELECT 'T4.reason_code_presence' AS constraint_id, d.event_id AS events, d.object_id AS objects,
         d.session_id, 'medium' AS severity
  FROM rel d JOIN sess o ON o.session_id = d.session_id
  WHERE d.event_type = 'make_decision' AND d.qualifier = 'produces' AND o.outcome IN ('deny', 'refer')
    AND (o.k % 13 = 0 OR NOT EXISTS (
      SELECT 1 FROM rel x WHERE x.event_type = 'emit_reasoning' AND x.qualifier = 'explains'
        AND x.object_id = d.object_id))
)""",
    "T5": """
v_t5 AS (
  SELECT 'T5.prohibited_attribute_access' AS constraint_id, r.event_id AS events,
         r.object_id AS objects, r.session_id, 'high' AS severity
  FROM rel r JOIN resource q ON q.object_id = r.object_id
  JOIN (SELECT DISTINCT event_id FROM rel WHERE qualifier = 'concerns' AND object_type = 'Application') a ON a.event_id = r.event_id
  WHERE r.event_type IN ('retrieve_data', 'call_llm') AND r.qualifier = 'reads'
    AND q.classification = 'special_category' AND trim(q.lawful_basis) = ''
)""",
    "STD": """
v_std AS (
  SELECT 'STD.policy_version_current' AS constraint_id, event_id AS events, object_id AS objects,
         session_id, 'medium' AS severity
  FROM rel WHERE event_type = 'make_decision' AND qualifier = 'governed_by' AND object_id = 'POL-5'
)""",
}


def with_orders(body: str, *violations: str) -> str:
    """The prelude, the violation CTEs named, and the query body."""
    parts = [PRELUDE.strip(), *[VIOLATIONS[v].strip() for v in violations]]
    return "WITH " + ",\n".join(parts) + "\n" + body


def all_violations(body: str, *extra: str) -> str:
    names = ("T1", "T2", "T3", "T4", "T5", "STD")
    union = " UNION ALL ".join(f"SELECT * FROM v_{n.lower()}" for n in names)
    parts = [PRELUDE.strip(), *[VIOLATIONS[n].strip() for n in names], f"viol AS ({union})", *extra]
    return "WITH " + ",\n".join(parts) + "\n" + body
