"""Flattening, variants and directly-follows mining over object-centric logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import spread, with_neighbours, with_rank_in_group
from ocelens.model import EventLog

CASE_NOTIONS = ("Application", "Session", "CreditDecision", "Agent")
NOVEL_EDGE = "OCDFG.novel_edge"


def flatten(log: EventLog, case_notion: str) -> DataFrame:
    """One row per (event, object of the notion), by any qualifier (``declares`` counts)."""
    return log.relations.where(F.col("object_type") == case_notion).select(
        F.col("object_id").alias("case_id"), "event_id", F.col("event_type").alias("activity"), "ts"
    )


def case_sessions(log: EventLog, case_notion: str) -> DataFrame:
    """(case_id, session_id): sessions map to themselves, other objects to the first
    session that touches them; agents span sessions and map to none."""
    if case_notion == "Session":
        return log.objects_of("Session").select(
            F.col("object_id").alias("case_id"), F.col("object_id").alias("session_id")
        )
    touching = log.relations.where(
        (F.col("object_type") == case_notion) & F.col("session_id").isNotNull()
    )
    if case_notion == "Agent":
        touching = touching.limit(0)
    return touching.groupBy(F.col("object_id").alias("case_id")).agg(
        F.min("session_id").alias("session_id")
    )


def case_variants(flat: DataFrame) -> DataFrame:
    """(case_id, length, variant): a key equal exactly for equal activity sequences.

    The key folds position-tagged 128-bit hashes, so a case of any length is never
    gathered: positions come from a range sort and the fold aggregates map-side.
    """
    placed = with_rank_in_group(flat, ["case_id"], ["ts", "event_id"], "position")
    tag = F.md5(F.concat_ws(":", F.col("position").cast("string"), F.col("activity")))
    half = lambda start: F.conv(F.substring(tag, start, 16), 16, -10).cast("bigint")
    folded = placed.groupBy("case_id").agg(
        F.count("*").alias("length"), F.bit_xor(half(1)).alias("_hi"), F.bit_xor(half(17)).alias("_lo")
    )
    return folded.select(
        "case_id", "length", F.concat_ws("-", "length", F.hex("_hi"), F.hex("_lo")).alias("variant")
    )


def variant_counts(variants: DataFrame) -> DataFrame:
    """(variant, length, cases, example): how often each sequence occurs."""
    return variants.groupBy("variant", "length").agg(
        F.count("*").alias("cases"), F.min("case_id").alias("example")
    )


def novel_cases(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Cases whose whole sequence occurs in no reference case."""
    return variants.join(reference.select("variant").distinct(), "variant", "left_anti")


def directly_follows(
    log: EventLog, object_types: list[str] | None = None, sessions: bool = True
) -> DataFrame:
    """Consecutive event pairs per object, hub objects included.

    Columns: object_type, object_id, activity_a, activity_b, first_id, second_id,
    session_id (of the first event, else the second; a graph of edges needs no ``sessions``).
    """
    rows = log.relations
    if object_types:
        rows = rows.where(F.col("object_type").isin(object_types))
    session = ["session_id"] if sessions else []
    placed = with_neighbours(
        rows.select("object_type", "object_id", "ts", "event_id", "event_type", *session),
        ["object_type", "object_id"],
        ["ts", "event_id"],
        following="then",
        carry=["event_id", "event_type", *session],
    )
    return placed.where("then IS NOT NULL").select(
        "object_type",
        "object_id",
        F.col("event_type").alias("activity_a"),
        F.col("then.event_type").alias("activity_b"),
        F.col("event_id").alias("first_id"),
        F.col("then.event_id").alias("second_id"),
        *[F.coalesce(c, f"then.{c}").alias(c) for c in session],
    )


def _couples(follows: DataFrame) -> DataFrame:
    return follows.groupBy("object_type", "activity_a", "activity_b", "first_id", "second_id").agg(
        F.min("session_id").alias("session_id"), F.count("*").alias("objects")
    )


def dfg_edges(follows: DataFrame) -> DataFrame:
    """Directly-follows graph: distinct event couples and traversals per edge.

    Couples are told apart by 128-bit digests of their ids, so no id is shuffled.
    """
    couple = F.unhex(F.md5(F.to_json(F.array("first_id", "second_id"))))
    return (
        follows.groupBy("object_type", "activity_a", "activity_b", couple.alias("_couple"))
        .agg(F.count("*").alias("objects"))
        .groupBy("object_type", "activity_a", "activity_b")
        .agg(F.count("*").alias("event_couples"), F.sum("objects").alias("traversals"))
    )


def novel_edges(follows: DataFrame, reference_edges: DataFrame, per_mille: int = 0) -> DataFrame:
    """One violation per event couple on an edge the reference does not show.

    With ``per_mille`` an edge counts as reference behaviour only from that share of the
    couples of its object type on; 0 takes every edge.
    """
    edge = ["object_type", "activity_a", "activity_b"]
    if per_mille:
        totals = reference_edges.groupBy("object_type").agg(F.sum("event_couples").alias("_total"))
        reference_edges = reference_edges.join(totals, "object_type").where(
            F.col("event_couples") * 1000 >= F.col("_total") * per_mille
        )
    # a graph has few edges; couples on edges that it shows are left out before they are grouped
    known = F.broadcast(reference_edges.select(*edge).distinct())
    unseen = _couples(follows.join(known, edge, "left_anti"))
    return unseen.select(
        F.lit(NOVEL_EDGE).alias("constraint_id"),
        F.array("first_id", "second_id").alias("ocel_event_ids"),
        F.array().cast("array<string>").alias("ocel_object_ids"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.lit("medium").alias("severity"),
        F.concat(
            F.col("object_type"), F.lit(": "), F.col("activity_a"), F.lit(" > "), F.col("activity_b")
        ).alias("detail"),
    )


def notion_statistics(log: EventLog, *case_notions: str) -> DataFrame:
    """How many events flattening keeps, drops and duplicates; all notions from one grouping of the edges."""
    edges = log.relations.where(F.col("object_type").isin(list(case_notions))).select("event_id", "object_type")
    copies = [F.count_if(F.col("object_type") == n).alias(f"_{k}") for k, n in enumerate(case_notions)]
    per_event = spread(edges, "event_id").groupBy("event_id").agg(*copies)
    sums = [F.struct(F.count_if(F.col(f"_{k}") > 0).alias("kept"), F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias("rows")) for k in range(len(case_notions))]
    totals = log.events.agg(F.count("*").alias("events_total")).withColumn("_one", F.lit(1))
    kept = per_event.agg(*[c.alias(f"_{k}") for k, c in enumerate(sums)]).withColumn("_one", F.lit(1))
    notions = F.array(*[F.struct(F.lit(n).alias("case_notion"), F.col(f"_{k}.kept").alias("events_kept"), F.col(f"_{k}.rows").alias("_rows")) for k, n in enumerate(case_notions)])
    return totals.join(kept, "_one").select("events_total", F.inline(notions)).select(
        "case_notion",
        "events_total",
        "events_kept",
        (F.col("events_total") - F.col("events_kept")).alias("events_dropped"),
        (F.col("_rows") - F.col("events_kept")).alias("events_duplicated"),
    )


def activities_per_type(log: EventLog) -> DataFrame:
    """Which activities touch which object type, with edge counts."""
    return log.relations.groupBy("object_type", F.col("event_type").alias("activity")).agg(
        F.count("*").alias("edges")
    )


def sessions_per_type(log: EventLog, object_types: Sequence[str]) -> DataFrame:
    """(event_type, object_type, edges, sessions): edges and distinct sessions per couple of types.

    ``object_types`` names the types that may occur; another one fails. A session is met once per
    event type, with a count for each object type, instead of once per couple of types.
    """
    known = F.col("object_type").isin(list(object_types))
    unknown = F.count_if(~known | F.col("object_type").isNull()).alias("_unknown")
    counts = [F.count_if(F.col("object_type") == t).alias(f"_{k}") for k, t in enumerate(object_types)]
    met = log.relations.groupBy("event_type", "session_id").agg(*counts, unknown)
    # edges without a session count as edges only
    some = [F.struct(F.sum(f"_{k}").alias("edges"), F.count_if((F.col(f"_{k}") > 0) & F.col("session_id").isNotNull()).alias("sessions")) for k in range(len(object_types))]
    totals = met.groupBy("event_type").agg(*[c.alias(f"_{k}") for k, c in enumerate(some)], F.sum("_unknown").alias("_unknown"))
    rows = F.array(*[F.struct(F.lit(t).alias("object_type"), F.col(f"_{k}.edges").alias("edges"), F.col(f"_{k}.sessions").alias("sessions")) for k, t in enumerate(object_types)])
    checked = F.when(F.col("_unknown") == 0, rows).otherwise(F.raise_error(F.lit("an object type that was not named")))
    return totals.select("event_type", F.inline(checked)).where("edges > 0")


def events_per_timestamp(log: EventLog) -> DataFrame:
    return log.events.groupBy("ts").agg(F.count("*").alias("events"))


def object_lifecycles(log: EventLog) -> DataFrame:
    """First and last event time and number of events per object."""
    return log.touches.groupBy("object_type", "object_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events")
    )


def session_credit(violations: DataFrame) -> DataFrame:
    """The distinct non-empty sessions a detector implicates."""
    return violations.where("session_id IS NOT NULL AND session_id <> ''").select("session_id").distinct()
