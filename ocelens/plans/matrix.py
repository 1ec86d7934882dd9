"""What flattening hides: per case notion and fault class, how many labelled faults
stay visible in the control flow, and how many DECLARE conformance flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.model import EventLog
from ocelens.operators import declare, mining


def flattening_cells(
    clean: EventLog,
    evaluated: EventLog,
    labels: DataFrame,
    case_notion: str,
    templates: tuple[str, ...] = declare.TEMPLATES,
    **thresholds: float,
) -> DataFrame:
    """(case_notion, fault_class, total, control_flow_visible, declare_flagged)."""
    flat_clean = mining.flatten(clean, case_notion)
    flat = mining.flatten(evaluated, case_notion)
    novel = mining.novel_cases(mining.case_variants(flat), mining.case_variants(flat_clean))
    model = declare.discover(flat_clean, templates=templates, **thresholds)
    broken = declare.deviations(flat, model)
    flagged = mining.session_credit(
        declare.declare_violations(broken, mining.case_sessions(evaluated, case_notion))
    ).withColumn("flagged", F.lit(1))
    visible = (
        labels.select("violation_id", F.explode("ocel_event_ids").alias("event_id"))
        .join(flat.select("event_id", "case_id"), "event_id")
        .join(novel.select("case_id"), "case_id", "left_semi")
        .select("violation_id")
        .distinct()
        .withColumn("visible", F.lit(1))
    )
    return (
        labels.join(visible, "violation_id", "left")
        .join(flagged, "session_id", "left")
        .groupBy("fault_class")
        .agg(
            F.count("*").alias("total"),
            F.count("visible").alias("control_flow_visible"),
            F.count("flagged").alias("declare_flagged"),
        )
        .select(F.lit(case_notion).alias("case_notion"), "*")
    )


def flattening_matrix(
    clean: EventLog,
    evaluated: EventLog,
    labels: DataFrame,
    notions: tuple[str, ...] = mining.CASE_NOTIONS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The cells and the per-notion statistics over all case notions."""
    cells = [flattening_cells(clean, evaluated, labels, n, **options) for n in notions]
    stats = [mining.notion_statistics(evaluated, n) for n in notions]
    return reduce(DataFrame.unionByName, cells), reduce(DataFrame.unionByName, stats)
