"""Constraint templates over the order log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.operators.constraints import TEMPLATES, evaluate
from ocelens.operators.rules import Rule
from verification.order_log import order_log, order_rules
from ocelens.session import configure
from verification.order_sql import all_violations, with_orders


def flat(violations: DataFrame) -> DataFrame:
    """Violation rows with the id lists as comma-joined text."""
    return violations.select(
        "constraint_id",
        F.array_join("ocel_event_ids", ",").alias("events"),
        F.array_join("ocel_object_ids", ",").alias("objects"),
        "session_id",
        "severity",
    )


def _shipped(prefix: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        (rule,) = [r for r in order_rules() if r.constraint_id.startswith(prefix)]
        return flat(TEMPLATES[rule.template](order_log(spark, sf_dir), rule))

    return run


def _with_rule(rule: Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return flat(TEMPLATES[rule.template](order_log(spark, sf_dir), rule))

    return run


EXISTENCE = Rule(
    "STD.decision_derived",
    "object_existence",
    "low",
    {
        "anchor_object_type": "CreditDecision",
        "related_object_type": "Application",
        "o2o_qualifier": "derived_from",
        "direction": "outgoing",
    },
)
INCOMING = Rule(
    "STD.applicant_submits",
    "object_existence",
    "low",
    {
        "anchor_object_type": "Application",
        "related_object_type": "CreditDecision",
        "o2o_qualifier": "derived_from",
        "direction": "incoming",
    },
)
ABSENCE = Rule(
    "STD.no_session_reads",
    "object_absence",
    "low",
    {
        "anchor_event_type": "call_llm",
        "qualifier": "uses",
        "object_type": "Model",
        "attribute": "version",
        "violating_when": "equals",
        "value": "2.1",
    },
)
RESPONSE = Rule(
    "STD.decision_explained",
    "synchronised_response",
    "low",
    {"activity_a": "grant_approval", "activity_b": "emit_reasoning", "object_type": "CreditDecision"},
)
PRECEDENCE = Rule(
    "STD.decision_approved",
    "synchronised_precedence",
    "low",
    {"activity_a": "grant_approval", "activity_b": "make_decision", "object_type": "CreditDecision"},
)


def ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return flat(evaluate(order_log(spark, sf_dir), order_rules()))


QUERIES = {
    "synchronised_approval": _shipped("T1"),
    "mandatory_data_coverage": _shipped("T2"),
    "delegation_integrity": _shipped("T3"),
    "reason_code_presence": _shipped("T4"),
    "prohibited_attribute_access": _shipped("T5"),
    "policy_version_current": _shipped("STD"),
    "object_existence": _with_rule(EXISTENCE),
    "object_existence_incoming": _with_rule(INCOMING),
    "object_absence_equals": _with_rule(ABSENCE),
    "synchronised_response": _with_rule(RESPONSE),
    "synchronised_precedence": _with_rule(PRECEDENCE),
    "ruleset_evaluation": ruleset,
}

_EXISTENCE_SQL = """
SELECT '{cid}' AS constraint_id, f.first.id AS events, f.object_id AS objects,
       f.first.sess AS session_id, 'low' AS severity
FROM (SELECT object_id, min({{'ts': ts, 'id': event_id, 'sess': session_id}}) AS first
      FROM rel WHERE object_type = '{kind}' GROUP BY object_id) f
WHERE NOT EXISTS (SELECT 1 FROM o2o WHERE qualifier = 'derived_from' AND {near} = f.object_id)"""

ORACLES = {
    "synchronised_approval": with_orders("SELECT * FROM v_t1", "T1"),
    "mandatory_data_coverage": with_orders("SELECT * FROM v_t2", "T2"),
    "delegation_integrity": with_orders("SELECT * FROM v_t3", "T3"),
    "reason_code_presence": with_orders("SELECT * FROM v_t4", "T4"),
    "prohibited_attribute_access": with_orders("SELECT * FROM v_t5", "T5"),
    "policy_version_current": with_orders("SELECT * FROM v_std", "STD"),
    "object_existence": with_orders(
        _EXISTENCE_SQL.format(cid="STD.decision_derived", kind="CreditDecision", near="source_id")
    ),
    "object_existence_incoming": with_orders(
        _EXISTENCE_SQL.format(cid="STD.applicant_submits", kind="Application", near="target_id")
    ),
    "object_absence_equals": with_orders("""
SELECT 'STD.no_session_reads' AS constraint_id, event_id AS events, object_id AS objects,
       session_id, 'low' AS severity
FROM rel WHERE event_type = 'call_llm' AND qualifier = 'uses' AND object_id = 'MDL-1'"""),
    "synchronised_response": with_orders("""
SELECT 'STD.decision_explained' AS constraint_id, a.event_id AS events, a.object_id AS objects,
       a.session_id, 'low' AS severity
FROM rel a WHERE a.event_type = 'grant_approval' AND a.object_type = 'CreditDecision'
  AND NOT EXISTS (SELECT 1 FROM rel b WHERE b.event_type = 'emit_reasoning'
                  AND b.object_id = a.object_id AND b.ts > a.ts)"""),
    "synchronised_precedence": with_orders("""
SELECT 'STD.decision_approved' AS constraint_id, b.event_id AS events, b.object_id AS objects,
       b.session_id, 'low' AS severity
FROM rel b WHERE b.event_type = 'make_decision' AND b.object_type = 'CreditDecision'
  AND NOT EXISTS (SELECT 1 FROM rel a WHERE a.event_type = 'grant_approval'
                  AND a.object_id = b.object_id AND a.ts < b.ts)"""),
    "ruleset_evaluation": all_violations("SELECT * FROM viol"),
}
