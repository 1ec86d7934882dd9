"""Spans to an event log: trees, declarations, edges, and the span index."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.functions.canonical import json_attrs, sha256
from ocelens.model import EventLog
from ocelens.operators import decode
from ocelens.operators.findings import finding, union
from ocelens.operators.graph import nearest_marked_ancestor
from ocelens.operators.normalise import normalise, normalise_findings
from ocelens.session import materialise
from ocelens.sources.spans import uniqueness_findings


def attribution(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, anchor): each enrichment span's nearest event span or root.

    The anchor is null for spans no root reaches (parent cycles, missing parents).
    """
    nodes = spans.select(
        F.col("trace_id").alias("tree"),
        F.col("span_id").alias("node"),
        F.col("parent_span_id").alias("parent"),
        (decode.is_event() | F.col("parent_span_id").isNull()).alias("marked"),
    )
    return nearest_marked_ancestor(nodes).toDF("trace_id", "span_id", "anchor")


def tree_findings(spans: DataFrame) -> DataFrame:
    """Traces without exactly one root, parents that do not resolve, and parent cycles."""
    rooted = spans.groupBy("trace_id").agg(
        F.count_if(F.col("parent_span_id").isNull()).alias("roots")
    )
    children = spans.where("parent_span_id IS NOT NULL")
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    orphans = children.join(ids, ["trace_id", "parent_span_id"], "left_anti")
    # every span must climb to the root, event spans included
    nodes = spans.select(
        F.col("trace_id").alias("tree"),
        F.col("span_id").alias("node"),
        F.col("parent_span_id").alias("parent"),
        F.col("parent_span_id").isNull().alias("marked"),
    )
    lost = nearest_marked_ancestor(nodes).where("ancestor IS NULL").toDF("trace_id", "span_id", "anchor")
    return union(
        [
            finding(rooted.where("roots <> 1"), "root_count", "trace_id", F.col("roots").cast("string")),
            finding(orphans, "parent_missing", "source", F.col("parent_span_id")),
            finding(lost, "unreachable_from_root", "trace_id", F.col("span_id")),
        ]
    )


class MappedRun:
    """A run's event log, span index and findings, each computed on first use."""

    def __init__(self, spans: DataFrame) -> None:
        self.spans = spans
        self.events = decode.event_spans(spans)
        self.refs = decode.object_refs(self.events)

    @cached_property
    def log(self) -> EventLog:
        return EventLog(
            events=self.events.select(
                "event_id", "event_type", F.try_to_timestamp("time").alias("ts"), "attrs"
            ),
            objects=declared_objects(self.refs),
            e2o=self.refs.select("event_id", "object_id", decode.declared_qualifier().alias("qualifier")),
            o2o=decode.o2o_refs(self.events).select("source_id", "target_id", "qualifier").distinct(),
        )

    @cached_property
    def enrichment(self) -> DataFrame:
        """(trace_id, span_id, anchor) of every attributed enrichment span."""
        return attribution(self.spans).where("anchor IS NOT NULL")

    def _indexed(self, rows: DataFrame) -> DataFrame:
        per_anchor = self.enrichment.groupBy("trace_id", F.col("anchor").alias("span_id")).agg(
            F.array_sort(F.collect_list("span_id")).alias("ids")
        )
        none = F.array().cast("array<string>")
        return rows.join(per_anchor, ["trace_id", "span_id"], "left").withColumn(
            "ids", F.coalesce("ids", none)
        )

    @cached_property
    def event_spans(self) -> DataFrame:
        return self._indexed(self.events).select(
            "event_id", "trace_id", "span_id", F.col("ids").alias("enrichment_span_ids")
        )

    @cached_property
    def session_spans(self) -> DataFrame:
        roots = decode.scope_of(self.spans.where("parent_span_id IS NULL"))
        return self._indexed(roots).select(
            F.col("scope.session_id").alias("session_id"),
            "trace_id",
            F.col("span_id").alias("root_span_id"),
            F.col("ids").alias("session_span_ids"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        # written once, so that the many checks of a span do not each repeat its parsing
        enrichment = materialise(self.spans.where(~decode.is_event() & F.col("parent_span_id").isNotNull()))
        repeated = self.events.groupBy("event_id").count().where("count > 1")
        return union(
            [
                tree_findings(self.spans),
                decode.scope_findings(self.spans),
                decode.contract_findings(self.events),
                decode.sequence_findings(self.spans, self.events),
                uniqueness_findings(self.spans),
                normalise_findings(normalise(enrichment)),
                declaration_findings(self.refs),
                finding(repeated, "event_id_repeated", "event_id"),
            ]
        )


def _declaration_facts(refs: DataFrame) -> DataFrame:
    return refs.where("declares").withColumn(
        "signature", sha256(F.concat_ws("|", "object_type", json_attrs(F.col("attrs"))))
    )


def declared_objects(refs: DataFrame) -> DataFrame:
    """One object per declared id; the first declaration's content (all must agree)."""
    first = F.struct("trace_id", "seq", "idx")
    return (
        _declaration_facts(refs)
        .groupBy("object_id")
        .agg(F.min_by(F.struct("object_type", "attrs"), first).alias("o"))
        .select("object_id", "o.object_type", "o.attrs")
    )


def declaration_findings(refs: DataFrame) -> DataFrame:
    """Ids declared differently somewhere in the run, or referenced but never declared."""
    declared = _declaration_facts(refs).groupBy("object_id").agg(
        F.min("signature").alias("low"), F.max("signature").alias("high")
    )
    undeclared = (
        refs.select("object_id").distinct().join(declared, "object_id", "left_anti")
    )
    return union(
        [
            finding(declared.where("low <> high"), "declaration_conflict", "object_id"),
            finding(undeclared, "object_undeclared", "object_id"),
        ]
    )


def map_spans(spans: DataFrame) -> MappedRun:
    """The event log, span index and findings of a run's spans."""
    return MappedRun(spans)
