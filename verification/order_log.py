"""An event log projected from the order tables: one session per order.

Objects: Session SES-k, Application APP-k and CreditDecision DEC-k per order k,
Applicant CUS-c per customer, DataResource RES-p per part, PolicyVersion POL-d per
order priority, HumanApprover HUM-s per supplier, Agent AGT-0..3 (supplier modulo 4)
and Model MDL-0..2. Events, in minutes from the order date:

    +0    session_start
    +1    call_llm by AGT-0
    +2n   handoff from the previous line's agent when it differs (left out when
          l_partkey % 11 = 0, sent to a third agent when l_partkey % 11 = 1)
    +2n+1 retrieve_data of the line's part by the line's agent
    +120  grant_approval by line 1's supplier (+240, a tie with the decision, when
          l_suppkey % 7 = 0; for the next order's decision when l_partkey % 10 = 0)
    +240  make_decision (F grant, O deny, P refer)
    +241  emit_reasoning (without ``explains`` when o_custkey % 9 = 0)
    +242  session_end

``(l_orderkey, l_linenumber)`` is not a key, so lines are first reduced to one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocelens.functions.attributes import (
    attribute_map,
    boolean_value,
    float_value,
    integer_value,
    list_value,
    string_value,
)
from ocelens.functions.canonical import utc_text
from ocelens.functions.ordering import spread
from ocelens.model import EventLog, Partitioned
from ocelens.operators.rules import DEFAULT_RULES, Rule
from ocelens.session import materialise, size_shuffles

APPROVER_ROLES = ("credit_officer", "risk_manager", "contractor", "intern")
AGENT_ROLES = ("intake", "retrieval", "scoring", "adjudication")
REQUIRED_SOURCES = ("ECONOMY", "SMALL")


def order_rules() -> tuple[Rule, ...]:
    """The default rules with the data sources this projection retrieves."""
    return tuple(
        Rule(**{**rule.__dict__, "params": {"required_sources": list(REQUIRED_SOURCES)}})
        if rule.template == "t2_mandatory_data_coverage"
        else rule
        for rule in DEFAULT_RULES
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(minutes: str) -> str:
    return f"t0 + ({minutes}) * INTERVAL '1' MINUTE"


def _id(prefix: str, col: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("t0"),
        F.substring("o_orderpriority", 1, 1).alias("policy"),
        _id("SES-", "o_orderkey").alias("session_id"),
    )


def _lines(spark: SparkSession, sf_dir: str, rows: int = 0) -> DataFrame:
    """One row per (order, line number); dealt by order to tasks of about a million of ``rows``."""
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
        .agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    )
    if rows:
        lines = spread(lines, "k", rows=rows)
    # at most one row per line number is left in an order, so the window stays small
    by_line = Window.partitionBy("k").orderBy("n")
    return lines.withColumn("agent", F.col("s") % 4).withColumns(
        {"sender": F.lag("agent").over(by_line), "place": F.row_number().over(by_line)}
    )


# a misdirected handoff goes to the lowest agent that is neither sender nor receiver
_THIRD = "CASE WHEN 0 NOT IN (sender, s % 4) THEN 0L WHEN 1 NOT IN (sender, s % 4) THEN 1L ELSE 2L END"
_TOLD = ("s % 4 AS agent", f"IF(p % 11 = 1, {_THIRD}, s % 4) AS receiver")
_DECISION = "IF(p % 10 = 0, k + 1, k)"


class _Orders:
    """The per-event-type row sources, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, period: str) -> None:
        self.spark, self.sf_dir, self.period = spark, sf_dir, period

    @cached_property
    def sessions(self) -> DataFrame:
        return _sessions(self.spark, self.sf_dir).where(self.period)

    @cached_property
    def lines(self) -> DataFrame:
        # three event types, o2o and the approvals read these rows, so they are written once;
        # what other columns tell is left out of the copy
        written = materialise(
            _lines(self.spark, self.sf_dir).drop("agent", "place").join(self.sessions.select("k", "c", "t0"), "k")
        )
        return written.selectExpr("*", *_TOLD, "concat('SES-', k) AS session_id")

    @cached_property
    def whole(self) -> DataFrame:
        """The sessions with their lines, in the order of ``place``; one row without a line where there is none."""
        spark, sf_dir = self.spark, self.sf_dir
        rows = sum(_table(spark, sf_dir, name).count() for name in ("orders", "lineitem"))
        before = _sessions(spark, sf_dir).selectExpr("try_subtract(k, 1) AS k", "true AS next_known").distinct()
        sessions = spread(self.sessions.select("k", "c", "t0", "policy", "session_id"), "k", rows=rows)
        lines = _lines(spark, sf_dir, rows).drop("agent")
        return sessions.join(before, "k", "left").join(lines, "k", "left").selectExpr(
            "*", *_TOLD, f"{_DECISION} AS decision"
        )

    @cached_property
    def handoffs(self) -> DataFrame:
        return self.lines.where(_EVENTS["handoff"][1])

    @cached_property
    def approvals(self) -> DataFrame:
        return (
            self.lines.where("n = 1")
            .withColumn("decision", F.expr(_DECISION))
            # any order's decision, also one outside the period
            .join(
                _sessions(self.spark, self.sf_dir).select(F.col("k").alias("decision")),
                "decision",
                "left_semi",
            )
        )

    def rows(self, event_type: str) -> DataFrame:
        """The source rows of an event type with its id, time and type."""
        source, condition, minutes = _EVENTS[event_type]
        return getattr(self, source).where(condition).selectExpr(
            "*",
            f"concat_ws('-', 'EV', k, lpad({minutes}, 3, '0'), '{event_type}') AS event_id",
            f"{_at(minutes)} AS ts",
            f"'{event_type}' AS event_type",
        )


# (source rows, condition on them, minutes from the order date) per event type
_EVENTS = {
    "session_start": ("sessions", "true", "0"),
    "call_llm": ("sessions", "true", "1"),
    "handoff": ("lines", "sender IS NOT NULL AND sender <> agent AND p % 11 <> 0", "2 * n"),
    "retrieve_data": ("lines", "true", "2 * n + 1"),
    "grant_approval": ("approvals", "true", "IF(s % 7 = 0, 240, 120)"),
    "make_decision": ("sessions", "true", "240"),
    "emit_reasoning": ("sessions", "true", "241"),
    "session_end": ("sessions", "true", "242"),
}
EVENT_TYPES = tuple(_EVENTS)

# (object id expression, object type, qualifier) per event type; a null id means no edge
_SESSION = ("session_id", "Session", "within")
_APPLICATION = ("concat('APP-', k)", "Application", "concerns")
_APPLICANT = ("concat('CUS-', c)", "Applicant", "concerns")
_POLICY = ("concat('POL-', policy)", "PolicyVersion", "governed_by")
_EDGES = {
    "session_start": (
        _SESSION,
        _APPLICATION,
        _APPLICANT,
        _POLICY,
        ("IF(k % 5 = 0 AND policy <> '5', 'POL-5', NULL)", "PolicyVersion", "declares"),
    ),
    "call_llm": (
        _SESSION,
        _APPLICATION,
        ("'AGT-0'", "Agent", "performed_by"),
        ("concat('MDL-', k % 3)", "Model", "uses"),
    ),
    "handoff": (
        _SESSION,
        _APPLICATION,
        ("concat('AGT-', sender)", "Agent", "from"),
        ("concat('AGT-', receiver)", "Agent", "to"),
    ),
    "retrieve_data": (
        _SESSION,
        _APPLICATION,
        _APPLICANT,
        ("concat('AGT-', agent)", "Agent", "performed_by"),
        ("concat('RES-', p)", "DataResource", "reads"),
    ),
    "grant_approval": (
        _SESSION,
        _APPLICATION,
        ("concat('HUM-', s)", "HumanApprover", "performed_by"),
        ("concat('DEC-', decision)", "CreditDecision", "approves"),
    ),
    "make_decision": (
        _SESSION,
        _APPLICATION,
        _APPLICANT,
        _POLICY,
        ("concat('DEC-', k)", "CreditDecision", "produces"),
    ),
    "emit_reasoning": (
        _SESSION,
        _APPLICATION,
        ("IF(c % 9 <> 0, concat('DEC-', k), NULL)", "CreditDecision", "explains"),
    ),
    "session_end": (_SESSION, _APPLICATION, ("concat('DEC-', k)", "CreditDecision", "concerns")),
}


def _relations(orders: _Orders, event_type: str) -> DataFrame:
    structs = ", ".join(
        f"named_struct('object_id', {oid}, 'object_type', '{kind}', 'qualifier', '{qualifier}')"
        for oid, kind, qualifier in _EDGES[event_type]
    )
    # absent edges are left out behind the generator: a lambda inside it would be interpreted
    return (
        orders.rows(event_type)
        .selectExpr("event_id", "event_type", "ts", "session_id", f"inline(array({structs}))")
        .where("object_id IS NOT NULL")
    )


def _touches(orders: _Orders) -> DataFrame:
    """What the edges add to lifecycles: a row for each object that a session with one of its lines touches."""
    held = {
        "sessions": "coalesce(place = 1, true)",
        "lines": "place IS NOT NULL",
        "approvals": "n = 1 AND (coalesce(p % 10 <> 0, true) OR next_known)",
    }
    flags = [
        f"coalesce({held[source]} AND {condition}, false) AS has_{t}" for t, (source, condition, _) in _EVENTS.items()
    ]
    times = [f"IF(has_{t}, {_at(minutes)}, NULL) AS ts_{t}" for t, (_, _, minutes) in _EVENTS.items()]
    touching: dict[tuple[str, str], list[str]] = {}
    for t, edges in _EDGES.items():
        for oid, kind, _ in edges:
            touching.setdefault((oid, kind), []).append(t)

    def over(fold: str, found: list[str]) -> str:
        return f"{fold}({', '.join(f'ts_{t}' for t in found)})" if len(found) > 1 else f"ts_{found[0]}"

    # objects of the same events share what they add
    shared = {tuple(found): number for number, found in enumerate(touching.values())}
    folds = [
        column
        for found, number in shared.items()
        for column in (
            f"{over('least', found)} AS first_{number}",
            f"{over('greatest', found)} AS last_{number}",
            f"{' + '.join(f'CAST(has_{t} AS BIGINT)' for t in found)} AS events_{number}",
        )
    ]
    structs = ", ".join(
        f"named_struct('object_id', IF(events_{number} > 0, {oid}, NULL), 'object_type', '{kind}', "
        f"'first_ts', first_{number}, 'last_ts', last_{number}, 'events', events_{number})"
        for (oid, kind), number in ((key, shared[tuple(found)]) for key, found in touching.items())
    )
    return (
        orders.whole.selectExpr("*", *flags)
        .selectExpr("*", *times)
        .selectExpr("*", *folds)
        .selectExpr(f"inline(array({structs}))")
        .where("object_id IS NOT NULL")
    )


def _outcome() -> Column:
    return (
        F.when(F.col("status") == "F", F.lit("grant"))
        .when(F.col("status") == "O", F.lit("deny"))
        .otherwise(F.lit("refer"))
    )


def _reason_codes(empty: Column) -> Column:
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.array(F.lit("RC01"), _id("RC1", F.col("k") % 7)))


def _attrs_of(event_type: str) -> Column:
    return {
        "session_start": lambda: attribute_map(
            run_id=string_value(F.lit("orders")), seed=integer_value(F.col("k"))
        ),
        "call_llm": lambda: attribute_map(
            max_tokens=integer_value(F.lit(1024)),
            purpose=string_value(F.lit("summary")),
            temperature=float_value((F.col("k") % 4) / F.lit(4)),
        ),
        "handoff": lambda: attribute_map(handoff_kind=string_value(F.lit("line"))),
        "retrieve_data": lambda: attribute_map(record_count=integer_value(F.col("n"))),
        "grant_approval": lambda: attribute_map(authority_level=integer_value(F.col("s") % 4)),
        "make_decision": lambda: attribute_map(
            adverse=boolean_value(F.col("status") != "F"),
            outcome=string_value(_outcome()),
            reason_codes=list_value(_reason_codes(F.lit(False))),
            score=integer_value(F.floor("price")),
        ),
        "emit_reasoning": lambda: attribute_map(reasoning_kind=string_value(F.lit("rationale"))),
        "session_end": lambda: attribute_map(
            duration_seconds=integer_value(F.lit(14520)), outcome=string_value(_outcome())
        ),
    }[event_type]()


def _objects(orders: _Orders) -> dict[str, Callable[[], DataFrame]]:
    spark, sf_dir = orders.spark, orders.sf_dir

    def objects(df: DataFrame, object_id: Column, object_type: str, **attrs: Column) -> DataFrame:
        return df.select(
            object_id.alias("object_id"),
            F.lit(object_type).alias("object_type"),
            attribute_map(**attrs).alias("attrs"),
        )

    def one_of(names: tuple[str, ...], index: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))

    return {
        "Session": lambda: objects(
            orders.sessions,
            F.col("session_id"),
            "Session",
            session_id=string_value(F.col("session_id")),
            workflow_name=string_value(F.lit("credit_scoring")),
        ),
        "Application": lambda: objects(
            orders.sessions,
            _id("APP-", "k"),
            "Application",
            application_id=string_value(_id("APP-", "k")),
            amount=integer_value(F.floor("price")),
            submitted_at=string_value(utc_text(F.col("t0"))),
        ),
        "CreditDecision": lambda: objects(
            orders.sessions,
            _id("DEC-", "k"),
            "CreditDecision",
            decision_id=string_value(_id("DEC-", "k")),
            outcome=string_value(_outcome()),
            reason_codes=list_value(_reason_codes(F.col("k") % 13 == 0)),
        ),
        "Applicant": lambda: objects(
            _table(spark, sf_dir, "customer"),
            _id("CUS-", "c_custkey"),
            "Applicant",
            applicant_id=string_value(_id("CUS-", "c_custkey")),
            jurisdiction=string_value(_id("N", "c_nationkey")),
        ),
        "DataResource": lambda: objects(
            _table(spark, sf_dir, "part"),
            _id("RES-", "p_partkey"),
            "DataResource",
            resource_type=string_value(F.col("p_type")),
            classification=string_value(
                F.when(F.col("p_type") == "PROMO", F.lit("special_category")).otherwise(F.lit("internal"))
            ),
            lawful_basis=string_value(F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit("art10"))),
        ),
        "PolicyVersion": lambda: objects(
            _table(spark, sf_dir, "orders")
            .select(F.substring("o_orderpriority", 1, 1).alias("policy"))
            .distinct(),
            _id("POL-", "policy"),
            "PolicyVersion",
            version=string_value(F.concat(F.lit("2026."), F.col("policy"))),
            effective_to=string_value(
                F.when(F.col("policy") == "5", F.lit("2026-01-31T23:59:59Z")).otherwise(F.lit(""))
            ),
        ),
        "HumanApprover": lambda: objects(
            _table(spark, sf_dir, "supplier"),
            _id("HUM-", "s_suppkey"),
            "HumanApprover",
            approver_id=string_value(_id("HUM-", "s_suppkey")),
            role=string_value(one_of(APPROVER_ROLES, F.col("s_nationkey") % 4)),
        ),
        "Agent": lambda: objects(
            spark.range(4),
            _id("AGT-", "id"),
            "Agent",
            agent_id=string_value(_id("AGT-", "id")),
            role=string_value(one_of(AGENT_ROLES, F.col("id"))),
            version=string_value(F.concat(F.lit("1."), F.col("id").cast("string"))),
        ),
        "Model": lambda: objects(
            spark.range(3),
            _id("MDL-", "id"),
            "Model",
            model_id=string_value(_id("MDL-", "id")),
            version=string_value(F.concat(F.lit("2."), F.col("id").cast("string"))),
        ),
    }


def _o2o(orders: _Orders) -> DataFrame:
    submitted = orders.sessions.selectExpr(
        "concat('APP-', k) AS source_id", "concat('CUS-', c) AS target_id", "'submitted_by' AS qualifier"
    )
    derived = orders.sessions.where("k % 17 <> 0").selectExpr(
        "concat('DEC-', k) AS source_id", "concat('APP-', k) AS target_id", "'derived_from' AS qualifier"
    )
    delegated = orders.handoffs.selectExpr(
        "concat('AGT-', sender) AS source_id",
        "concat('AGT-', receiver) AS target_id",
        "'delegates_to' AS qualifier",
    ).distinct()
    return submitted.unionByName(derived).unionByName(delegated)


def order_log(spark: SparkSession, sf_dir: str, period: str = "true") -> EventLog:
    """The order history as one event log, lazily; ``period`` is a predicate on t0."""
    # an order or line has some ten edges
    size_shuffles(spark, 10 * sum(_table(spark, sf_dir, name).count() for name in ("orders", "lineitem")))
    orders = _Orders(spark, sf_dir, period)
    events = {
        kind: lambda kind=kind: orders.rows(kind).select(
            "event_id", "event_type", "ts", _attrs_of(kind).alias("attrs")
        )
        for kind in EVENT_TYPES
    }
    relations = {kind: lambda kind=kind: _relations(orders, kind) for kind in EVENT_TYPES}
    return EventLog(
        events=Partitioned("event_type", events),
        objects=Partitioned("object_type", _objects(orders)),
        e2o=None,
        o2o=lambda: _o2o(orders),
        relations=Partitioned("event_type", relations),
        touches=lambda: _touches(orders),
    )
