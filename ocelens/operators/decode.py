"""Span attributes to events, object references and object edges, and back.

A span row holds everything its event needs, so decoding is done inside the row with
map and array functions and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.attributes import BOOLEAN, INTEGER, STRING
from ocelens.operators.findings import failed_checks, union
from ocelens.vocabulary import CREDIT, DECLARES, SPAN_CONTRACT, Vocabulary

# Attribute keys of the governance contract.
EVENT_TYPE_KEY = "at.event.type"
ROLE_KEY = "at.span.role"
ROOT_ROLE = "session_root"
ATTR_PREFIX = "at.event.attr."
SCOPE_KEYS = {
    "contract": "at.contract",
    "scenario_name": "at.scenario.name",
    "scenario_version": "at.scenario.version",
    "run_id": "at.run.id",
    "run_seed": "at.run.seed",
    "session_id": "at.session.id",
    "workflow_name": "at.session.workflow",
    "application_id": "at.application.id",
    "applicant_id": "at.applicant.id",
}
ENVELOPE_CENSUS = (
    "at.event.type",
    "at.event.id",
    "at.event.seq",
    "at.event.time",
    "at.obj.count",
    "at.o2o.count",
)
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def _value(key: str | Column) -> Column:
    return F.col("attributes")[key]


def _string(key: str | Column) -> Column:
    return F.when(_value(key)["kind"] == STRING, _value(key)["text"])


def _integer(key: str | Column) -> Column:
    return F.when(_value(key)["kind"] == INTEGER, _value(key)["text"].try_cast("bigint"))


def _has(key: str) -> Column:
    return F.map_contains_key("attributes", F.lit(key))


def is_event() -> Column:
    """A span is an event exactly when it carries an event type."""
    return _has(EVENT_TYPE_KEY)


def scope_of(spans: DataFrame) -> DataFrame:
    """Add ``scope``: the nine session-scope fields, null without a contract."""
    fields = [
        (_integer(key).cast("string") if name == "run_seed" else _string(key)).alias(name)
        for name, key in SCOPE_KEYS.items()
    ]
    return spans.withColumn("scope", F.when(_has(SCOPE_KEYS["contract"]), F.struct(*fields)))


def scope_findings(spans: DataFrame) -> DataFrame:
    """Roots without a usable scope, and event spans whose scope differs from their root's."""
    scoped = scope_of(spans)
    roots = scoped.where("parent_span_id IS NULL")
    empty = [
        F.coalesce(F.col("scope")[n] == "", F.lit(True)) for n in SCOPE_KEYS if n != "contract"
    ]
    incomplete = empty[0]
    for bad in empty[1:]:
        incomplete = incomplete | bad
    unknown = F.coalesce(F.col("scope.contract") != SPAN_CONTRACT, F.lit(True))
    root_checks = {
        "root_without_scope": F.col("scope").isNull(),
        "contract_unknown": F.col("scope").isNotNull() & unknown,
        "scope_field_missing": F.col("scope").isNotNull() & incomplete,
        "root_role": F.coalesce(_string(ROLE_KEY) != ROOT_ROLE, F.lit(True)),
        "root_is_event": is_event(),
    }
    root_findings = roots.select(
        F.explode(failed_checks(root_checks)).alias("check_id"),
        F.col("source").alias("key"),
        F.col("trace_id").alias("detail"),
    )
    root_scopes = roots.groupBy("trace_id").agg(F.min("scope").alias("root_scope"))
    differing = (
        scoped.where(is_event())
        .join(root_scopes, "trace_id")
        .where("NOT (scope <=> root_scope)")
        .select(
            F.lit("scope_differs_from_root").alias("check_id"),
            F.col("source").alias("key"),
            F.col("trace_id").alias("detail"),
        )
    )
    sessions = (
        root_scopes.groupBy("root_scope.session_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1 AND session_id IS NOT NULL")
        .select(
            F.lit("session_id_repeated").alias("check_id"),
            F.col("session_id").alias("key"),
            F.lit("").alias("detail"),
        )
    )
    return union([root_findings, differing, sessions])


def _indices(prefix: str) -> Column:
    """The distinct index spellings used under ``prefix`` (as text)."""
    keys = F.filter(F.map_keys("attributes"), lambda k: k.rlike(rf"^at\.{prefix}\.[0-9]+\."))
    return F.array_distinct(
        F.transform(keys, lambda k: F.regexp_extract(k, rf"^at\.{prefix}\.([0-9]+)\.", 1))
    )


def _under(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _stripped(prefix: Column) -> Column:
    """The attributes below ``prefix`` with the prefix cut off their names."""
    below = F.map_filter("attributes", lambda k, _: F.startswith(k, prefix))
    return F.transform_keys(below, lambda k, _: F.substring(k, F.length(prefix) + 1, F.length(k)))


def event_spans(spans: DataFrame) -> DataFrame:
    """Event spans with their decoded envelope; bad fields are null (see findings)."""
    decoded = scope_of(spans.where(is_event()))
    return decoded.select(
        "trace_id",
        "span_id",
        "source",
        "scope",
        F.col("scope.session_id").alias("session_id"),
        _string("at.event.id").alias("event_id"),
        _string(EVENT_TYPE_KEY).alias("event_type"),
        _integer("at.event.seq").alias("seq"),
        _string("at.event.time").alias("time"),
        _string("at.event.actor.id").alias("actor_id"),
        _string("at.event.actor.type").alias("actor_type"),
        _stripped(F.lit(ATTR_PREFIX)).alias("attrs"),
        _integer("at.obj.count").alias("obj_count"),
        _integer("at.o2o.count").alias("o2o_count"),
        _indices("obj").alias("obj_indices"),
        _indices("o2o").alias("o2o_indices"),
        "attributes",
    )


def object_refs(events: DataFrame) -> DataFrame:
    """One row per object entry: type, id, qualifier, declares, attributes."""
    i = F.col("i")
    rows = events.select(
        "trace_id", "span_id", "event_id", "event_type", "seq", "source", "attributes", F.explode("obj_indices").alias("i")
    )
    declares = _value(_under("at.obj.", i, ".declares"))
    return rows.select(
        "trace_id",
        "span_id",
        "event_id",
        "event_type",
        "seq",
        "source",
        i.cast("int").alias("idx"),
        _string(_under("at.obj.", i, ".type")).alias("object_type"),
        _string(_under("at.obj.", i, ".id")).alias("object_id"),
        _value(_under("at.obj.", i, ".qualifier"))["text"].alias("qualifier"),
        F.coalesce(declares["text"] == "true", F.lit(False)).alias("declares"),
        F.coalesce(declares["kind"] != BOOLEAN, F.lit(False)).alias("declares_not_boolean"),
        _stripped(_under("at.obj.", i, ".attr.")).alias("attrs"),
    )


def o2o_refs(events: DataFrame) -> DataFrame:
    """One row per object-to-object entry: source, target, qualifier."""
    i = F.col("i")
    rows = events.select(
        "trace_id", "event_id", "source", "attributes", F.explode("o2o_indices").alias("i")
    )
    return rows.select(
        "trace_id",
        "event_id",
        "source",
        i.cast("int").alias("idx"),
        _string(_under("at.o2o.", i, ".source")).alias("source_id"),
        _string(_under("at.o2o.", i, ".target")).alias("target_id"),
        _string(_under("at.o2o.", i, ".qualifier")).alias("qualifier"),
    )


def _not_dense(count: str, indices: str) -> Column:
    """True unless the indices are exactly 0..count-1, canonically spelled."""
    used = F.col(indices)
    canonical = F.forall(used, lambda t: t.rlike("^(0|[1-9][0-9]{0,8})$"))
    inside = F.forall(used, lambda t: t.try_cast("bigint") < F.col(count))
    return ~(canonical & inside & (F.size(used) == F.col(count)))


def contract_findings(events: DataFrame, vocabulary: Vocabulary = CREDIT) -> DataFrame:
    """Every way an event span breaks the contract: (check_id, key, detail)."""
    required = F.create_map(
        *[
            x
            for kind in vocabulary.event_attributes
            for x in (
                F.lit(kind),
                F.array(*[F.lit(n) for n in vocabulary.required_attributes(kind)]),
            )
        ]
    )
    actors = F.create_map(*[F.lit(x) for item in vocabulary.actor_types.items() for x in item])
    wants = F.coalesce(actors[F.col("event_type")], F.lit(""))
    attrs = F.col("attrs")
    is_true = lambda name: F.coalesce(
        (attrs[name]["kind"] == BOOLEAN) & (attrs[name]["text"] == "true"), F.lit(False)
    )
    codes = attrs["reason_codes"]
    checks = {
        "event_type_unknown": ~F.col("event_type").isin(list(vocabulary.event_attributes)),
        "event_id_missing": F.col("event_id") == "",
        "seq_not_positive": F.col("seq") < 1,
        "time_not_zoned_iso": ~F.col("time").rlike(ISO_WITH_ZONE) | F.try_to_timestamp("time").isNull(),
        "actor_half_set": F.col("actor_id").isNull() != F.col("actor_type").isNull(),
        "actor_policy": F.coalesce(F.col("actor_type"), F.lit("")) != wants,
        "required_attributes": F.size(
            F.array_except(required[F.col("event_type")], F.map_keys("attrs"))
        )
        > 0,
        "attribute_value": F.exists(F.map_values("attrs"), lambda v: v["kind"] == "other"),
        "attribute_name": F.exists(F.map_keys("attrs"), lambda k: F.trim(k) == ""),
        "adverse_without_codes": (F.col("event_type") == "make_decision")
        & is_true("adverse")
        & F.coalesce((codes["kind"] != "string_list") | (codes["text"] == "[]"), F.lit(True)),
        "notice_without_codes": (F.col("event_type") == "notify_applicant")
        & is_true("adverse_action_notice")
        & ~is_true("contains_reason_codes"),
        "object_indices": _not_dense("obj_count", "obj_indices"),
        "o2o_indices": _not_dense("o2o_count", "o2o_indices"),
    }
    per_event = events.select(
        F.explode(failed_checks(checks)).alias("check_id"),
        F.col("source").alias("key"),
        F.coalesce("event_id", F.lit("")).alias("detail"),
    )
    refs = object_refs(events)
    named = F.size("attrs") > 0
    ref_checks = {
        "object_type_unknown": ~F.col("object_type").isin(list(vocabulary.object_attributes)),
        "object_id_missing": F.col("object_id") == "",
        "object_qualifier": F.col("qualifier").isNotNull()
        & ~F.col("qualifier").isin(vocabulary.e2o_qualifiers),
        "declares_not_boolean": F.col("declares_not_boolean"),
        "declaration_without_attributes": F.col("declares") & ~named,
        "attributes_without_declaration": ~F.col("declares") & named,
        "object_entry_empty": F.col("qualifier").isNull() & ~F.col("declares"),
        "object_attribute_value": F.exists(F.map_values("attrs"), lambda v: v["kind"] == "other"),
    }
    per_ref = refs.select(
        F.explode(failed_checks(ref_checks)).alias("check_id"),
        F.col("source").alias("key"),
        F.coalesce("object_id", F.lit("")).alias("detail"),
    )
    twice = (
        refs.groupBy("source", "object_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(
            F.lit("object_twice_in_event").alias("check_id"),
            F.col("source").alias("key"),
            F.col("object_id").alias("detail"),
        )
    )
    edge_checks = {
        "o2o_end_missing": (F.col("source_id") == "") | (F.col("target_id") == ""),
        "o2o_qualifier": ~F.col("qualifier").isin(list(vocabulary.o2o_endpoints)),
    }
    per_edge = o2o_refs(events).select(
        F.explode(failed_checks(edge_checks)).alias("check_id"),
        F.col("source").alias("key"),
        F.concat_ws(" ", "source_id", "target_id").alias("detail"),
    )
    return union([per_event, per_ref, twice, per_edge])


def sequence_findings(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Traces without events, or whose event numbers are not exactly 1..N."""
    per_trace = events.groupBy("trace_id").agg(
        F.count("*").alias("n"),
        F.count("seq").alias("numbered"),
        F.countDistinct("seq").alias("different"),
        F.min("seq").alias("low"),
        F.max("seq").alias("high"),
    )
    gaps = per_trace.where("NOT (low = 1 AND high = n AND different = n AND numbered = n)")
    silent = spans.select("trace_id").distinct().join(per_trace, "trace_id", "left_anti")
    return union(
        [
            gaps.select(
                F.lit("sequence_not_dense").alias("check_id"),
                F.col("trace_id").alias("key"),
                F.concat_ws("/", F.col("low"), F.col("high"), F.col("n")).alias("detail"),
            ),
            silent.select(
                F.lit("trace_without_events").alias("check_id"),
                F.col("trace_id").alias("key"),
                F.lit("").alias("detail"),
            ),
        ]
    )


def flatten_events(events: DataFrame, refs: DataFrame, o2o: DataFrame) -> DataFrame:
    """Encode events back to span attributes: (event_id, attributes).

    The inverse of the decoding. Object entries are renumbered in (qualifier, type, id)
    order and edges in (qualifier, source, target) order.
    """

    def text(value: Column) -> Column:
        return F.struct(F.lit(STRING).alias("kind"), value.alias("text"))

    def number(value: Column) -> Column:
        return F.struct(F.lit(INTEGER).alias("kind"), value.cast("string").alias("text"))

    def entry(key: Column | str, value: Column) -> Column:
        return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))

    ref_order = F.struct(
        F.coalesce("qualifier", F.lit("")).alias("q"),
        "object_type",
        "object_id",
        "qualifier",
        "declares",
        F.array_sort(F.map_entries("attrs")).alias("entries"),
    )
    per_event_refs = refs.groupBy("event_id").agg(F.array_sort(F.collect_list(ref_order)).alias("refs"))
    per_event_o2o = o2o.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("qualifier", "source_id", "target_id"))).alias("edges")
    )

    def ref_entries(r: Column, i: Column) -> Column:
        at = lambda leaf: F.concat(F.lit("at.obj."), i.cast("string"), F.lit("." + leaf))
        fixed = F.array(
            entry(at("type"), text(r["object_type"])),
            entry(at("id"), text(r["object_id"])),
            F.when(r["qualifier"].isNotNull(), entry(at("qualifier"), text(r["qualifier"]))),
            F.when(
                r["declares"],
                entry(at("declares"), F.struct(F.lit(BOOLEAN).alias("kind"), F.lit("true").alias("text"))),
            ),
        )
        named = F.transform(r["entries"], lambda e: entry(F.concat(at("attr."), e["key"]), e["value"]))
        return F.concat(F.array_compact(fixed), F.when(r["declares"], named).otherwise(F.slice(named, 1, 0)))

    def edge_entries(e: Column, i: Column) -> Column:
        at = lambda leaf: F.concat(F.lit("at.o2o."), i.cast("string"), F.lit("." + leaf))
        return F.array(
            entry(at("source"), text(e["source_id"])),
            entry(at("target"), text(e["target_id"])),
            entry(at("qualifier"), text(e["qualifier"])),
        )

    joined = events.join(per_event_refs, "event_id", "left").join(per_event_o2o, "event_id", "left")
    head = F.array_compact(
        F.array(
            entry(EVENT_TYPE_KEY, text(F.col("event_type"))),
            entry("at.event.id", text(F.col("event_id"))),
            entry("at.event.seq", number(F.col("seq"))),
            entry("at.event.time", text(F.col("time"))),
            F.when(F.col("actor_id").isNotNull(), entry("at.event.actor.id", text(F.col("actor_id")))),
            F.when(
                F.col("actor_type").isNotNull(), entry("at.event.actor.type", text(F.col("actor_type")))
            ),
            entry("at.obj.count", number(F.coalesce(F.size("refs"), F.lit(0)))),
            entry("at.o2o.count", number(F.coalesce(F.size("edges"), F.lit(0)))),
        )
    )
    own = F.transform(
        F.map_entries("attrs"), lambda e: entry(F.concat(F.lit(ATTR_PREFIX), e["key"]), e["value"])
    )
    none = F.slice(head, 1, 0)
    objects = F.coalesce(F.flatten(F.transform("refs", ref_entries)), none)
    edges = F.coalesce(F.flatten(F.transform("edges", edge_entries)), none)
    return joined.select(
        "event_id", F.map_from_entries(F.concat(head, own, objects, edges)).alias("attributes")
    )


def declared_qualifier() -> Column:
    """The stored qualifier of a reference: its own, or ``declares`` for a pure declaration."""
    return F.coalesce(F.col("qualifier"), F.lit(DECLARES))
