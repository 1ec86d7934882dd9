"""Small hand-built logs: events as (id, type, minute, {object: qualifier}, attrs)."""

from __future__ import annotations

import datetime
import json

from ocelens.model import EVENTS_SCHEMA, O2O_SCHEMA, OBJECTS_SCHEMA, E2O_SCHEMA, EventLog

BASE = datetime.datetime(2026, 3, 2, 9, 0, tzinfo=datetime.timezone.utc)


def value(v):
    if isinstance(v, bool):
        return ("boolean", "true" if v else "false")
    if isinstance(v, int):
        return ("integer", str(v))
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, (list, tuple)):
        return ("string_list", json.dumps(list(v), separators=(",", ":"), ensure_ascii=False))
    return ("string", v)


def values(attrs):
    return {k: value(v) for k, v in attrs.items()}


def make_log(spark, events, objects, o2o=()):
    return EventLog(
        spark.createDataFrame(
            [(e, t, BASE + datetime.timedelta(minutes=m), values(a)) for e, t, m, _, a in events], EVENTS_SCHEMA
        ),
        spark.createDataFrame([(o, t, values(a)) for o, t, a in objects], OBJECTS_SCHEMA),
        spark.createDataFrame([(e, o, q) for e, _, _, rel, _ in events for o, q in rel.items()], E2O_SCHEMA),
        spark.createDataFrame(list(o2o), O2O_SCHEMA),
    )


OBJECTS = [
    ("S1", "Session", {"session_id": "S1"}),
    ("S2", "Session", {"session_id": "S2"}),
    ("A1", "Application", {"application_id": "A1", "amount": 10}),
    ("A2", "Application", {"application_id": "A2", "amount": 20}),
    ("D1", "CreditDecision", {"decision_id": "D1", "reason_codes": ["RC1"]}),
    ("D2", "CreditDecision", {"decision_id": "D2", "reason_codes": []}),
    ("H1", "HumanApprover", {"role": "risk_manager"}),
    ("H2", "HumanApprover", {"role": "intern"}),
    ("G0", "Agent", {"role": "intake", "agent_id": "G0", "version": "1"}),
    ("G1", "Agent", {"role": "scoring", "agent_id": "G1", "version": "1"}),
    ("G2", "Agent", {"role": "review", "agent_id": "G2", "version": "2"}),
    ("R1", "DataResource", {"resource_type": "credit_bureau", "classification": "internal"}),
    ("R2", "DataResource", {"resource_type": "income_verification", "classification": "special_category", "lawful_basis": "  "}),
    ("P1", "PolicyVersion", {"version": "1", "effective_to": ""}),
    ("P0", "PolicyVersion", {"version": "0", "effective_to": "2026-01-01"}),
]


def decision(eid, minute, session="S1", app="A1", dec="D1", policy="P1", outcome="grant"):
    rel = {session: "within", app: "concerns", dec: "produces", policy: "governed_by"}
    return (eid, "make_decision", minute, rel, {"outcome": outcome})


def approval(eid, minute, session="S1", dec="D1", by="H1"):
    return (eid, "grant_approval", minute, {session: "within", dec: "approves", by: "performed_by"}, {})


def handoff(eid, minute, sender, receiver, session="S1"):
    return (eid, "handoff", minute, {session: "within", sender: "from", receiver: "to"}, {})


def act(eid, minute, agent, session="S1"):
    return (eid, "invoke_agent", minute, {session: "within", agent: "performed_by"}, {})


def read(eid, minute, resource, session="S1", app="A1"):
    return (eid, "retrieve_data", minute, {session: "within", app: "concerns", resource: "reads"}, {})
