"""Declarative multi-object constraints: one function per template, plus ``evaluate``.

Every template maps an event log to violation rows. Existence and ordering questions
("is there an earlier approval") are answered by comparing with one aggregated row per
object or session, never by pairing events, so the shuffles carry partial aggregates
and no hot object produces a product of its events. ``declares`` edges never count as
evidence; equal seconds are never "before"; event ids only break display ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.attributes import attr_list_empty, attr_string, attr_text
from ocelens.functions.ordering import with_neighbours
from ocelens.model import VIOLATIONS_SCHEMA, EventLog, empty
from ocelens.operators.graph import cyclic_edges
from ocelens.operators.rules import DEFAULT_RULES, Rule
from ocelens.session import materialise

Template = Callable[[EventLog, Rule], DataFrame]

_BLANK = r"^[\s\p{Z}]*$"


def edges(log: EventLog, event_type: str, qualifier: str, object_type: str) -> DataFrame:
    """Edges of exactly this event type, qualifier and object type."""
    return log.relations_of(event_type).where(
        (F.col("qualifier") == qualifier) & (F.col("object_type") == object_type)
    )


def _objects(log: EventLog, object_type: str, **attributes: Column) -> DataFrame:
    return log.objects_of(object_type).select(
        "object_id", *[expr.alias(name) for name, expr in attributes.items()]
    )


def _violations(
    df: DataFrame, rule: Rule, events: Column, objects: Column, detail: Column
) -> DataFrame:
    return df.select(
        F.lit(rule.constraint_id).alias("constraint_id"),
        events.alias("ocel_event_ids"),
        objects.alias("ocel_object_ids"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.lit(rule.severity).alias("severity"),
        detail.alias("detail"),
    )


def _no_objects() -> Column:
    return F.array().cast("array<string>")


def _decisions_with_outcome(log: EventLog, outcomes: Iterable[str]) -> DataFrame:
    """(event, decision) pairs whose *event* outcome is one of ``outcomes``."""
    wanted = (
        log.events_of("make_decision")
        .select("event_id", attr_string(F.col("attrs"), "outcome").alias("outcome"))
        .where(F.col("outcome").isin(list(outcomes)))
    )
    return (
        edges(log, "make_decision", "produces", "CreditDecision")
        .select("event_id", "ts", "session_id", F.col("object_id").alias("decision_id"))
        .join(wanted, "event_id")
    )


def t1_synchronised_approval(log: EventLog, rule: Rule) -> DataFrame:
    """Approval-bound decisions need an earlier grant of that decision by an allowed role.

    Citation: the first earlier approval (all approvers unauthorised), else the first
    approval of the session together with the decision, else the decision alone.
    """
    decisions = _decisions_with_outcome(log, rule.params["decision_outcomes"])
    approves = edges(log, "grant_approval", "approves", "CreditDecision").select(
        F.col("event_id").alias("approval_id"),
        "ts",
        F.col("session_id").alias("approval_session"),
        F.col("object_id").alias("decision_id"),
    )
    roles = _objects(log, "HumanApprover", role=attr_text(F.col("attrs"), "role"))
    performed = edges(log, "grant_approval", "performed_by", "HumanApprover").select(
        F.col("event_id").alias("approval_id"), "object_id"
    )
    allowed = roles.where(F.col("role").isin(list(rule.params["allowed_roles"])))
    authorised = (
        performed.join(allowed, "object_id", "left_semi")
        .select("approval_id", F.lit(True).alias("authorised"))
        .distinct()
    )
    per_decision = (
        approves.join(authorised, "approval_id", "left")
        .groupBy("decision_id")
        .agg(
            F.min(F.struct("ts", "approval_id", "approval_session")).alias("first"),
            F.min(F.when(F.col("authorised"), F.col("ts"))).alias("authorised_ts"),
        )
    )
    per_session = (
        log.relations_of("grant_approval")
        .where("session_id IS NOT NULL")
        .groupBy("session_id")
        .agg(F.min(F.struct("ts", F.col("event_id").alias("approval_id"))).alias("in_session"))
    )
    breached = (
        decisions.join(per_decision, "decision_id", "left")
        .where("authorised_ts IS NULL OR authorised_ts >= ts")
        .join(per_session, "session_id", "left")
        .withColumn("prior", F.when(F.col("first.ts") < F.col("ts"), F.col("first")))
        .withColumn(
            "cited", F.coalesce(F.col("prior.approval_id"), F.col("in_session.approval_id"))
        )
    )
    # approver and target lists are built for cited approvals only
    cited_ids = breached.select(F.col("cited").alias("approval_id")).where("approval_id IS NOT NULL").distinct()
    approvers = (
        performed.join(cited_ids, "approval_id", "left_semi")
        .join(roles, "object_id")
        .groupBy("approval_id")
        .agg(
            F.sort_array(F.collect_set("object_id")).alias("approvers"),
            F.sort_array(F.collect_list(F.coalesce("role", F.lit("")))).alias("approver_roles"),
        )
    )
    targets = (
        approves.join(cited_ids, "approval_id", "left_semi")
        .groupBy("approval_id")
        .agg(F.sort_array(F.collect_set("decision_id")).alias("targets"))
    )
    told = (
        breached.withColumn("approval_id", F.col("cited"))
        .join(approvers, "approval_id", "left")
        .join(targets, "approval_id", "left")
        .withColumn("targets", F.coalesce("targets", _no_objects()))
        .withColumn("approvers", F.coalesce("approvers", _no_objects()))
        .withColumn(
            "session_id",
            F.when(
                F.col("prior").isNotNull(),
                F.coalesce(F.col("prior.approval_session"), F.col("session_id")),
            ).otherwise(F.col("session_id")),
        )
    )
    approval_first = F.struct(F.col("in_session.ts"), F.col("in_session.approval_id")) < F.struct(
        F.col("ts"), F.col("event_id")
    )
    others = F.array_except("targets", F.array("decision_id"))
    is_prior, in_session = F.col("prior").isNotNull(), F.col("in_session").isNotNull()
    return _violations(
        told,
        rule,
        F.when(is_prior, F.array("prior.approval_id"))
        .when(in_session & approval_first, F.array("in_session.approval_id", "event_id"))
        .when(in_session, F.array("event_id", "in_session.approval_id"))
        .otherwise(F.array("event_id")),
        F.when(is_prior, F.col("approvers"))
        .when(in_session, F.concat(F.array("decision_id"), others))
        .otherwise(F.array("decision_id")),
        F.when(
            is_prior,
            F.concat_ws(
                " ", F.col("decision_id"), F.lit("has only unauthorised approvals:"),
                F.array_join("approver_roles", ", "),
            ),
        )
        .when(
            in_session & (F.size("targets") > 0) & (F.size(others) == 0),
            F.concat(F.lit("approval not before "), F.col("decision_id")),
        )
        .when(
            in_session,
            F.concat(
                F.lit("session approval targets ["), F.array_join("targets", ", "),
                F.lit("] instead of "), F.col("decision_id"),
            ),
        )
        .otherwise(F.concat_ws(" ", F.col("decision_id"), F.lit("was never approved"))),
    )


def t2_mandatory_data_coverage(log: EventLog, rule: Rule) -> DataFrame:
    """Retrievals for a decision's applications must cover every required source type."""
    required = list(dict.fromkeys(rule.params["required_sources"]))
    flags = [f"covers_{i}" for i in range(len(required))]
    sources = (
        edges(log, "retrieve_data", "reads", "DataResource")
        .join(
            _objects(log, "DataResource", source=attr_text(F.col("attrs"), "resource_type")).where(
                F.col("source").isin(required)
            ),
            "object_id",
        )
        .select("event_id", "source")
        .distinct()
    )
    coverage = (
        edges(log, "retrieve_data", "concerns", "Application")
        .select("event_id", "object_id")
        .join(sources, "event_id")
        .groupBy("object_id")
        .agg(*[F.bool_or(F.col("source") == s).alias(f) for s, f in zip(required, flags)])
    )
    per_event = (
        edges(log, "make_decision", "concerns", "Application")
        .select("event_id", "object_id")
        .join(coverage, "object_id")
        .groupBy("event_id")
        .agg(*[F.bool_or(f).alias(f) for f in flags])
    )
    decisions = (
        log.relations_of("make_decision")
        .groupBy("event_id")
        .agg(F.max("session_id").alias("session_id"))
    )
    missing = F.filter(
        F.array(
            *[
                F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(s))
                for s, f in zip(required, flags)
            ]
        ),
        lambda s: s.isNotNull(),
    )
    breached = (
        decisions.join(per_event, "event_id", "left")
        .withColumn("missing", F.array_sort(missing))
        .where(F.size("missing") > 0)
    )
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        _no_objects(),
        F.concat(F.lit("sources not retrieved: "), F.array_join("missing", ", ")),
    )


def _orphans(log: EventLog, entrypoints: list[str]) -> DataFrame:
    """First events of agents that act in a session nobody handed to them in time."""
    first = (
        log.relations.where(
            "qualifier = 'performed_by' AND object_type = 'Agent' AND session_id IS NOT NULL"
        )
        .groupBy("session_id", F.col("object_id").alias("agent_id"))
        .agg(F.min(F.struct("ts", "event_id")).alias("first"))
    )
    received = (
        edges(log, "handoff", "to", "Agent")
        .where("session_id IS NOT NULL")
        .groupBy("session_id", F.col("object_id").alias("agent_id"))
        .agg(F.min("ts").alias("received_ts"))
    )
    outside = _objects(log, "Agent", role=attr_text(F.col("attrs"), "role")).where(
        ~F.coalesce(F.col("role"), F.lit("")).isin(entrypoints)
    )
    return (
        first.join(outside.withColumnRenamed("object_id", "agent_id"), "agent_id")
        .join(received, ["session_id", "agent_id"], "left")
        .where("received_ts IS NULL OR received_ts >= first.ts")
        .select("session_id", "agent_id", "role", F.col("first.event_id").alias("event_id"))
    )


def delegation_orphans(log: EventLog, entrypoints: list[str]) -> DataFrame:
    """Orphan agents with the handoff directly before their first event, if it is one.

    Columns: session_id, agent_id, role, event_id, handoff_id (null when the event
    before is not a handoff).
    """
    orphans = materialise(_orphans(log, entrypoints))
    # exactly one edge per event names its own session
    events = log.relations.where("qualifier = 'within' AND object_id = session_id").select(
        "session_id", "ts", "event_id", "event_type"
    )
    in_play = events.join(orphans.select("session_id").distinct(), "session_id", "left_semi")
    placed = with_neighbours(
        in_play, ["session_id"], ["ts", "event_id"], previous="before", carry=["event_id", "event_type"]
    )
    handed = placed.where("before.event_type = 'handoff'").select(
        "session_id", "event_id", F.col("before.event_id").alias("handoff_id")
    )
    return orphans.join(handed, ["session_id", "event_id"], "left")


def delegation_cycles(log: EventLog, cited: DataFrame) -> DataFrame:
    """Handoffs on a from->to cycle of their session, ignoring the ``cited`` handoffs.

    Columns: session_id, ts, event_id, source, target (one row per cyclic edge).
    """
    sends = edges(log, "handoff", "from", "Agent").where("session_id IS NOT NULL").select(
        "session_id", "ts", "event_id", F.col("object_id").alias("source")
    )
    gets = edges(log, "handoff", "to", "Agent").select(
        "event_id", F.col("object_id").alias("target")
    )
    handoffs = sends.join(gets, "event_id").join(
        cited.where("handoff_id IS NOT NULL").select(F.col("handoff_id").alias("event_id")),
        "event_id",
        "left_anti",
    )
    looped = cyclic_edges(
        handoffs.select(
            F.col("session_id").alias("g"), F.col("source").alias("u"), F.col("target").alias("v")
        )
    ).select(
        F.col("g").alias("session_id"), F.col("u").alias("source"), F.col("v").alias("target")
    )
    return handoffs.join(looped, ["session_id", "source", "target"], "left_semi")


def t3_delegation_integrity(log: EventLog, rule: Rule) -> DataFrame:
    """Agents act only after a handoff to them, and a session's handoffs form no cycle."""
    # both arms read the orphans, so they are computed once
    orphans = materialise(delegation_orphans(log, list(rule.params["entrypoint_roles"])))
    orphan_arm = _violations(
        orphans,
        rule,
        F.when(F.col("handoff_id").isNotNull(), F.array("handoff_id", "event_id")).otherwise(
            F.array("event_id")
        ),
        F.array("agent_id"),
        F.concat(
            F.col("agent_id"),
            F.when(
                F.col("handoff_id").isNotNull(), F.lit(" acted after a handoff to someone else")
            ).otherwise(F.lit(" acted without being handed control")),
        ),
    )
    cyclic = delegation_cycles(log, orphans)
    # one violation row per session lists its cyclic handoffs; the row is the result
    per_session = cyclic.groupBy("session_id").agg(
        F.array_sort(F.collect_set(F.struct("ts", "event_id"))).alias("handoffs"),
        F.array_sort(
            F.array_distinct(F.concat(F.collect_set("source"), F.collect_set("target")))
        ).alias("agents"),
    )
    cycle_arm = _violations(
        per_session,
        rule,
        F.transform("handoffs", lambda h: h["event_id"]),
        F.col("agents"),
        F.concat(F.lit("handoffs cycle over "), F.array_join("agents", ", ")),
    )
    return orphan_arm.unionByName(cycle_arm)


def t4_reason_code_presence(log: EventLog, rule: Rule) -> DataFrame:
    """Adverse decisions need reason codes on the object and an event that explains them."""
    decisions = _decisions_with_outcome(log, rule.params["adverse_outcomes"])
    codes = _objects(
        log, "CreditDecision", no_codes=attr_list_empty(F.col("attrs"), "reason_codes")
    ).withColumnRenamed("object_id", "decision_id")
    explained = (
        edges(log, "emit_reasoning", "explains", "CreditDecision")
        .select(F.col("object_id").alias("decision_id"))
        .distinct()
        .withColumn("explained", F.lit(True))
    )
    breached = (
        decisions.join(codes, "decision_id")
        .join(explained, "decision_id", "left")
        .where("no_codes OR explained IS NULL")
    )
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        F.array("decision_id"),
        F.concat_ws(
            "; ",
            F.when(F.col("no_codes"), F.lit("no reason codes on the decision")),
            F.when(F.col("explained").isNull(), F.lit("nothing explains the decision")),
        ),
    )


def t5_prohibited_attribute_access(log: EventLog, rule: Rule) -> DataFrame:
    """Application-related reads of prohibited resources need a non-blank lawful basis."""
    attrs = F.col("attrs")
    prohibited = _objects(
        log,
        "DataResource",
        classification=attr_text(attrs, "classification"),
        basis=attr_text(attrs, "lawful_basis"),
    ).where(
        F.col("classification").isin(list(rule.params["prohibited_classifications"]))
        & (F.col("basis").isNull() | F.col("basis").rlike(_BLANK))
    )
    in_scope = log.relations_of("retrieve_data", "call_llm")
    concerning = in_scope.where("qualifier = 'concerns' AND object_type = 'Application'").select(
        "event_id"
    )
    reads = in_scope.where("qualifier = 'reads' AND object_type = 'DataResource'")
    breached = reads.join(prohibited, "object_id").join(concerning, "event_id", "left_semi")
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        F.array("object_id"),
        F.concat_ws(
            " ", F.col("event_type"), F.lit("read"), F.col("object_id"), F.lit("without a basis")
        ),
    )


def object_existence(log: EventLog, rule: Rule) -> DataFrame:
    """Each anchor object needs an o2o edge to (or from) an object of the related type.

    Citation: the first event touching the anchor by any qualifier, ``declares`` included.
    """
    p = rule.params
    anchor_type, related_type = p["anchor_object_type"], p["related_object_type"]
    near, far = ("source_id", "target_id")
    if p.get("direction", "outgoing") == "incoming":
        near, far = far, near
    satisfied = (
        log.o2o.where(F.col("qualifier") == p["o2o_qualifier"])
        .select(F.col(near).alias("object_id"), F.col(far).alias("far_id"))
        .join(
            _objects(log, related_type).withColumnRenamed("object_id", "far_id"),
            "far_id",
            "left_semi",
        )
    )
    first = (
        log.relations.where(F.col("object_type") == anchor_type)
        .groupBy("object_id")
        .agg(F.min(F.struct("ts", "event_id", "session_id")).alias("first"))
    )
    breached = first.join(satisfied, "object_id", "left_anti").select(
        "object_id", F.col("first.event_id").alias("event_id"), F.col("first.session_id").alias("session_id")
    )
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        F.array("object_id"),
        F.concat(
            F.col("object_id"), F.lit(f" lacks a {p['o2o_qualifier']} edge with a {related_type}")
        ),
    )


def attribute_violates(value: Column, when: str, expected: str | None = None) -> Column:
    """The attribute predicate over a VALUE: ``always``, ``non_empty`` or ``equals``."""
    if when == "always":
        return F.lit(True)
    text = value["text"]
    if when == "non_empty":
        filled = (
            F.when(value["kind"] == "string", ~text.rlike(_BLANK))
            .when(value["kind"] == "string_list", text != "[]")
            .otherwise(F.lit(True))
        )
        return text.isNotNull() & filled
    if when == "equals":
        # booleans compare by their capitalised spelling, lists never equal a scalar
        spelled = F.when(value["kind"] == "boolean", F.initcap(text)).when(
            value["kind"] != "string_list", text
        )
        return F.coalesce(spelled == expected, F.lit(expected == "None") & text.isNull())
    raise ValueError(f"unknown predicate {when!r}")


def object_absence(log: EventLog, rule: Rule) -> DataFrame:
    """No anchor event may relate so to an object of the type (whose attribute matches)."""
    p = rule.params
    value = F.col("attrs")[p.get("attribute") or ""]
    matching = log.objects_of(p["object_type"]).where(
        attribute_violates(value, p["violating_when"], p.get("value"))
    )
    breached = edges(log, p["anchor_event_type"], p["qualifier"], p["object_type"]).join(
        matching.select("object_id"), "object_id", "left_semi"
    )
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        F.array("object_id"),
        F.concat(F.col("object_id"), F.lit(f" matches the {p['violating_when']} predicate")),
    )


def _touching(log: EventLog, event_type: str, object_type: str) -> DataFrame:
    return log.relations_of(event_type).where(
        (F.col("object_type") == object_type) & (F.col("qualifier") != "declares")
    )


def _unanswered(log: EventLog, rule: Rule, checked: str, other: str, later: bool) -> DataFrame:
    p = rule.params
    extreme = F.max("ts") if later else F.min("ts")
    bound = _touching(log, p[other], p["object_type"]).groupBy("object_id").agg(extreme.alias("bound"))
    missed = "bound <= ts" if later else "bound >= ts"
    breached = (
        _touching(log, p[checked], p["object_type"])
        .select("event_id", "object_id", "ts", "session_id")
        .distinct()
        .join(bound, "object_id", "left")
        .where(f"bound IS NULL OR {missed}")
    )
    relation = "follows" if later else "precedes"
    return _violations(
        breached,
        rule,
        F.array("event_id"),
        F.array("object_id"),
        F.concat(F.lit(f"no {p[other]} {relation} {p[checked]} on "), F.col("object_id")),
    )


def synchronised_response(log: EventLog, rule: Rule) -> DataFrame:
    """Every A on an object needs a strictly later B on the same object."""
    return _unanswered(log, rule, "activity_a", "activity_b", later=True)


def synchronised_precedence(log: EventLog, rule: Rule) -> DataFrame:
    """Every B on an object needs a strictly earlier A on the same object."""
    return _unanswered(log, rule, "activity_b", "activity_a", later=False)


TEMPLATES: dict[str, Template] = {
    "t1_synchronised_approval": t1_synchronised_approval,
    "t2_mandatory_data_coverage": t2_mandatory_data_coverage,
    "t3_delegation_integrity": t3_delegation_integrity,
    "t4_reason_code_presence": t4_reason_code_presence,
    "t5_prohibited_attribute_access": t5_prohibited_attribute_access,
    "object_existence": object_existence,
    "object_absence": object_absence,
    "synchronised_response": synchronised_response,
    "synchronised_precedence": synchronised_precedence,
}

ENGINE_VERSION = "engine/0.1.0"


def register_template(name: str, template: Template) -> None:
    """Add a template; it takes (log, rule) and returns violation rows."""
    TEMPLATES[name] = template


def evaluate(log: EventLog, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The union of every rule's violations, unsorted (order at the sink)."""
    out = empty(log.spark, VIOLATIONS_SCHEMA)
    for rule in rules:
        template = TEMPLATES.get(rule.template)
        if template is None:
            raise ValueError(f"{rule.constraint_id}: unknown template {rule.template!r}")
        out = out.unionByName(template(log, rule))
    return out


def in_canonical_order(violations: DataFrame) -> DataFrame:
    """Sort for output: constraint, then cited events, then objects."""
    return violations.orderBy("constraint_id", "ocel_event_ids", "ocel_object_ids")
