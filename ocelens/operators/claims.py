"""Judge responses as tables: strict parsing, cache keys, aggregation over repeated runs.

A run is one response to one session; its claims stay nested in the run's row, so what
is compared or voted on per run is never larger than the response itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.canonical import json_list, json_object, json_string, sha256
from ocelens.operators.evaluation import event_set, normalise_label, verdict_row

CLAIMS_TYPE = "array<struct<constraint_id:string,event_ids:array<string>,explanation:string>>"
SCHEMA_FAILURE = '"SCHEMA_FAILURE"'


def parse_reports(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Parse response text strictly; anything off-schema is a flagged failure, never repaired.

    A report is an object with exactly ``violations``: a list of objects holding a
    non-empty constraint_id, a non-empty list of non-empty event ids and an optional
    explanation. Adds ``claims`` (null on failure) and ``schema_failure``.
    """
    # every step is a column that the next one names more than once, so that none is evaluated again
    fields = "try_variant_get({}, '$', 'map<string,variant>')"
    item_ok = (
        "coalesce(size(array_except(map_keys(e), array('constraint_id', 'event_ids', 'explanation'))) = 0"
        " AND schema_of_variant(e['constraint_id']) = 'STRING'"
        " AND try_variant_get(e['constraint_id'], '$', 'string') <> ''"
        " AND schema_of_variant(e['event_ids']) = 'ARRAY<STRING>'"
        " AND (NOT map_contains_key(e, 'explanation')"
        " OR schema_of_variant(e['explanation']) = 'STRING'), false)"
    )
    claim = (
        "named_struct('constraint_id', try_variant_get(e['constraint_id'], '$', 'string'),"
        " 'event_ids', try_variant_get(e['event_ids'], '$', 'array<string>'),"
        " 'explanation', coalesce(try_variant_get(e['explanation'], '$', 'string'), ''))"
    )
    return (
        responses.withColumn("_v", F.expr(f"try_parse_json({text})"))
        .withColumn("_top", F.expr(fields.format("_v")))
        .withColumn("_items", F.expr("IF(map_keys(_top) = array('violations'), try_variant_get(_top['violations'], '$', 'array<variant>'), NULL)"))
        .withColumn("_fields", F.expr(f"transform(_items, e -> {fields.format('e')})"))
        .withColumn("claims", F.expr(f"IF(forall(_fields, e -> {item_ok}), transform(_fields, e -> {claim}), NULL)"))
        .withColumn("schema_failure", F.expr("claims IS NULL"))
        .select(*responses.columns, "schema_failure", "claims")
    )


def claim_rows(runs: DataFrame) -> DataFrame:
    """One detection row per claim, with its position in the response."""
    return runs.select(
        "*", F.posexplode_outer("claims").alias("pos", "claim")
    ).where("pos IS NOT NULL").select(
        *[c for c in runs.columns if c != "claims"],
        "pos",
        F.col("claim.constraint_id").alias("constraint_id"),
        F.col("claim.event_ids").alias("ocel_event_ids"),
        F.col("claim.explanation").alias("detail"),
    )


def cache_key(
    model_id: Column, sample_index: Column, condition: Column, input_hash: Column, prompt_sha256: Column
) -> Column:
    """Content key of one response: model, sample, condition, input and prompt."""
    return sha256(
        json_object(
            condition=json_string(condition),
            input_hash=json_string(input_hash),
            model_id=json_string(model_id),
            prompt_sha256=json_string(prompt_sha256),
            sample_index=sample_index.cast("string"),
        )
    )


def verdict_key(claims: Column, schema_failure: Column) -> Column:
    """Order-insensitive key of a run's claims; a schema failure is its own class."""
    rows = F.transform(
        claims,
        lambda c: F.struct(
            c["constraint_id"].alias("constraint_id"), F.array_sort(c["event_ids"]).alias("ids")
        ),
    )
    text = json_list(
        F.transform(F.array_sort(rows), lambda r: verdict_row(r["constraint_id"], r["ids"]))
    )
    return F.when(schema_failure, F.lit(SCHEMA_FAILURE)).otherwise(text)


def modal_verdicts(runs: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The most frequent verdict set per group, smallest key on ties.

    Columns: the group, verdict_key, runs_agreeing, runs and the claims of the lowest
    (sample_index, model_id, condition) run that holds the key (null for a failure).
    """
    keyed = runs.withColumn("verdict_key", verdict_key(F.col("claims"), F.col("schema_failure")))
    per_key = keyed.groupBy(*by, "verdict_key").agg(
        F.count("*").alias("n"),
        F.min_by("claims", F.struct("sample_index", "model_id", "condition")).alias("claims"),
    )
    return per_key.groupBy(*by).agg(
        F.min(F.struct((-F.col("n")).alias("less"), "verdict_key")).alias("_best"),
        F.min_by("claims", F.struct((-F.col("n")).alias("less"), "verdict_key")).alias("claims"),
        F.sum("n").alias("runs"),
    ).select(
        *by,
        F.col("_best.verdict_key").alias("verdict_key"),
        (-F.col("_best.less")).alias("runs_agreeing"),
        "runs",
        "claims",
    )


def majority_vote(
    runs: DataFrame,
    *,
    k: int = 3,
    synonyms: Mapping[str, str] | None = None,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Claims that at least ``k`` runs of the group make, by label and event set.

    The representative is the earliest run's first such claim.
    """
    run = ["sample_index", "model_id", "condition"]
    # a failure has no claims; as a filter that would be pushed below the parsing, which then ran twice
    valid = runs.withColumn("claims", F.when(~F.col("schema_failure"), F.col("claims")))
    items = claim_rows(valid).select(
        *by,
        *run,
        "pos",
        "constraint_id",
        "ocel_event_ids",
        "detail",
        normalise_label(F.col("constraint_id"), synonyms or {}).alias("label"),
        event_set(F.col("ocel_event_ids")).alias("event_set"),
    )
    first = F.struct("constraint_id", "ocel_event_ids", "detail")
    # runs stand last, so that the rows sorted for this grouping are sorted for the next one too
    once_per_run = items.repartition(*by, "label", "event_set").groupBy(*by, "label", "event_set", *run).agg(
        F.min("pos").alias("pos"), F.min_by(first, "pos").alias("claim")
    )
    return (
        once_per_run.groupBy(*by, "label", "event_set")
        .agg(
            F.count("*").alias("support"),
            F.min_by("claim", F.struct(*run, "pos")).alias("claim"),
        )
        .where(F.col("support") >= k)
        .select(*by, "label", "support", "claim.*")
    )


def cost_summary(runs: DataFrame) -> DataFrame:
    """Calls, failures, cache use and tokens per model and condition."""
    return runs.groupBy("model_id", "condition").agg(
        F.count("*").alias("calls"),
        F.count_if("schema_failure").alias("failures"),
        F.count_if("from_cache").alias("cached"),
        F.count_if(~F.col("from_cache")).alias("fresh"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
