"""Sidecar files: span index, coverage report, labels, evidence bundles, judge responses.

Documents are written as ordered lines (see ``sources.ocel``), so no table is gathered
into one row, and read back with the same checks as findings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ocelens.functions.attributes import float_text
from ocelens.functions.canonical import json_list, json_object, json_string, json_strings
from ocelens.operators.evidence import record_json
from ocelens.operators.findings import failed_checks, finding, union
from ocelens.operators.normalise import mapped_fraction
from ocelens.operators.rules import LEGAL_BASIS_TYPE, STANDARD_REFS_TYPE
from ocelens.session import materialise
from ocelens.sources.ocel import ordered_lines
from ocelens.vocabulary import SPAN_CONTRACT

EVENT_ENTRY = ("event_id", "trace_id", "span_id", "enrichment_span_ids")
SESSION_ENTRY = ("session_id", "trace_id", "root_span_id", "session_span_ids")
#: What a labels document says about its ids; informative, nothing reads it back.
EVENT_ID_NOTE = (
    "Editing a session keeps every event id: the number inside an id is the event's place in the "
    "original session, at.event.seq its place in the edited one."
)
#: Cache keys that can name a file of the cache's folder.
CACHE_KEY = "^[0-9A-Za-z_.-]+$"
CACHE_RECORD = (
    "fingerprint struct<model_id:string,model_version:string,sample_index:int,condition:string,"
    "session_id:string,access_date:string>, latency_ms bigint, "
    "response struct<raw_text:string,schema_failure:boolean>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint>"
)
LABEL_TYPE = (
    "struct<violation_id:string,fault_class:string,constraint_id:string,session_id:string,"
    "ocel_event_ids:array<string>,ocel_object_ids:array<string>,"
    "expected_evidence_span_ids:array<string>,removed_span_ids:array<string>,"
    "severity:string,articles:array<string>,description:string>"
)
DISTRACTOR_TYPE = (
    "struct<distractor_id:string,kind:string,session_id:string,span_ids:array<string>,description:string>"
)
RECORD_SCHEMA = (
    "violation_id string, "
    "constraint struct<formal:string,id:string,natural_language:string,ruleset_version:string>, "
    f"legal_basis {LEGAL_BASIS_TYPE}, standard_refs {STANDARD_REFS_TYPE}, severity string, "
    "evidence struct<ocel_event_ids:array<string>,ocel_object_ids:array<string>,"
    "otel_span_ids:array<string>,otel_trace_id:string>, "
    "context struct<agent_versions:map<string,string>,model_versions:map<string,string>,policy_version:string>, "
    "provenance struct<engine_commit:string,engine_version:string,input_log_sha256:string>, "
    "reproducibility struct<rerun_command:string>, "
    "retention struct<class:string,min_retention_months:int,note:string>, "
    "integrity struct<chain_index:bigint,prev_record_sha256:string,record_sha256:string>"
)


def _entry(strings: tuple[str, ...], listed: str) -> Column:
    members = {name: json_string(F.col(name)) for name in strings if name != listed}
    return json_object(**members, **{listed: json_strings(F.col(listed))})


def span_index_lines(event_spans: DataFrame, session_spans: DataFrame) -> DataFrame:
    """The span index as the ordered lines of one canonical JSON document."""
    events = event_spans.select(
        F.col("event_id").alias("order_key"), _entry(EVENT_ENTRY, "enrichment_span_ids").alias("member")
    )
    sessions = session_spans.select(
        F.col("session_id").alias("order_key"), _entry(SESSION_ENTRY, "session_span_ids").alias("member")
    )
    return ordered_lines(
        [
            ('{"events":[', None),
            ("events", events),
            ('],"schema_version":1,"sessions":[', None),
            ("sessions", sessions),
            ("]}", None),
        ]
    )


def read_span_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(event_spans, session_spans, findings) of a span index document, strictly read."""
    document = materialise(
        spark.read.schema("events array<variant>, schema_version variant, sessions array<variant>, _bad string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    wrong_version = document.where(
        "_bad IS NOT NULL OR NOT coalesce(schema_of_variant(schema_version) = 'BIGINT'"
        " AND try_variant_get(schema_version, '$', 'int') = 1, false)"
        " OR events IS NULL OR sessions IS NULL"
    )

    def entries(column: str, names: tuple[str, ...], listed: str) -> DataFrame:
        rows = document.select(F.explode(column).alias("e")).select(
            F.try_variant_get("e", "$", "map<string,variant>").alias("m"), F.to_json("e").alias("raw")
        )
        strings = [
            F.when(
                F.schema_of_variant(F.col("m")[n]) == "STRING", F.try_variant_get(F.col("m")[n], "$", "string")
            ).alias(n)
            for n in names
            if n != listed
        ]
        ids = F.when(
            F.schema_of_variant(F.col("m")[listed]).isin("ARRAY<STRING>", "ARRAY<VOID>"),
            F.try_variant_get(F.col("m")[listed], "$", "array<string>"),
        ).alias(listed)
        keys = F.array_sort(F.map_keys("m")) == F.array(*[F.lit(n) for n in sorted(names)])
        return rows.select("raw", keys.alias("exact"), *strings, ids)

    events = entries("events", EVENT_ENTRY, "enrichment_span_ids")
    sessions = entries("sessions", SESSION_ENTRY, "session_span_ids")

    def checked(rows: DataFrame, names: tuple[str, ...], listed: str, key: str) -> DataFrame:
        checks = {"index_entry_keys": ~F.col("exact")}
        for n in names:
            checks[f"index_{n}"] = (
                F.exists(F.col(listed), lambda s: s.isNull() | (s == "")) if n == listed else F.col(n) == ""
            )
        failed = rows.select(
            F.explode(failed_checks(checks)).alias("check_id"), F.col("raw").alias("key"), F.lit("").alias("detail")
        )
        repeated = rows.groupBy(key).count().where("count > 1")
        return failed.unionByName(finding(repeated, f"index_{key}_repeated", F.coalesce(key, F.lit(""))))

    findings = union(
        [
            finding(wrong_version, "index_document", F.lit(path)),
            checked(events, EVENT_ENTRY, "enrichment_span_ids", "event_id"),
            checked(sessions, SESSION_ENTRY, "session_span_ids", "session_id"),
        ]
    )
    return events.select(*EVENT_ENTRY), sessions.select(*SESSION_ENTRY), findings



def coverage_report(census: DataFrame, kinds: DataFrame, keys: DataFrame, run: DataFrame | None = None) -> DataFrame:
    """One row: the coverage report as canonical JSON.

    Its inputs are aggregates over closed vocabularies and distinct keys of the dump.
    """
    pair = json_object(present=F.col("present").cast("string"), total=F.col("total").cast("string"))

    def mapping(df: DataFrame, key: str, value: Column) -> Column:
        member = F.struct(F.col(key).alias("k"), F.concat(json_string(F.col(key)), F.lit(":"), value).alias("v"))
        return F.concat(
            F.lit("{"),
            F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["v"]), ","),
            F.lit("}"),
        )

    one = F.lit(1).alias("one")
    zero = F.lit(0)
    layer_a = census.agg(
        one,
        F.coalesce(F.sum("spans"), zero).alias("events"),
        F.coalesce(F.sum("present"), zero).alias("a_present"),
        F.coalesce(F.sum("total"), zero).alias("a_total"),
        mapping(census, "event_type", pair).alias("per_event_type"),
    )
    layer_b = kinds.agg(
        one,
        F.coalesce(F.sum("spans"), zero).alias("spans"),
        F.coalesce(F.sum("present"), zero).alias("b_present"),
        F.coalesce(F.sum("total"), zero).alias("b_total"),
        mapping(kinds, "kind", pair).alias("per_kind"),
    )
    buckets = ["missing", "recorded", "unknown"]
    counted = keys.groupBy("bucket").agg(mapping(keys, "key", F.col("spans").cast("string")).alias("text"))
    per_bucket = counted.agg(
        one, *[F.max(F.when(F.col("bucket") == b, F.col("text"))).alias(b) for b in buckets]
    )
    fraction = mapped_fraction(census, kinds).select(one, "mapped_fraction")
    rows = layer_a.join(layer_b, "one").join(per_bucket, "one").join(fraction, "one")
    run_json = F.lit("null")
    if run is not None:
        fields = ("model_id", "provider", "run_id", "scenario_name", "scenario_version")
        numbers = ("genai_semconv", "seed", "session_count")
        described = run.select(
            one,
            json_object(
                **{f: json_string(F.col(f)) for f in fields}, **{n: F.col(n).cast("string") for n in numbers}
            ).alias("run"),
        )
        rows = rows.join(described, "one")
        run_json = F.col("run")
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        json_object(
            contract=json_string(F.lit(SPAN_CONTRACT)),
            layer_a=json_object(
                census_present=text("a_present"),
                census_total=text("a_total"),
                event_count=text("events"),
                per_event_type=F.col("per_event_type"),
            ),
            layer_b=json_object(
                expected_present=text("b_present"),
                expected_total=text("b_total"),
                per_kind=F.col("per_kind"),
                span_count=text("spans"),
            ),
            mapped_fraction=float_text(F.col("mapped_fraction")),
            missing_keys=F.coalesce("missing", F.lit("{}")),
            recorded_keys=F.coalesce("recorded", F.lit("{}")),
            run=run_json,
            schema_version=F.lit("1"),
            unknown_keys=F.coalesce("unknown", F.lit("{}")),
        ).alias("value")
    )


def label_lines(
    labels: DataFrame,
    distractors: DataFrame,
    *,
    split: str,
    base_run_id: str,
    injector_seed: int,
    catalogue_sha256: str,
    catalogue_version: str,
) -> DataFrame:
    """The labels of one split as the ordered lines of one canonical JSON document."""
    lists = ("articles", "expected_evidence_span_ids", "ocel_event_ids", "ocel_object_ids", "removed_span_ids")
    strings = ("constraint_id", "description", "fault_class", "session_id", "severity", "violation_id")
    truths = labels.select(
        F.concat_ws(" ", "session_id", "fault_class").alias("order_key"),
        json_object(
            **{n: json_string(F.col(n)) for n in strings}, **{n: json_strings(F.col(n)) for n in lists}
        ).alias("member"),
    )
    decoys = distractors.select(
        F.col("session_id").alias("order_key"),
        json_object(
            **{n: json_string(F.col(n)) for n in ("description", "distractor_id", "kind", "session_id")},
            span_ids=json_strings(F.col("span_ids")),
        ).alias("member"),
    )
    head = f'{{"base_run_id":"{base_run_id}","catalogue_version":"{catalogue_version}","distractors":['
    tail = (
        f'],"event_id_note":"{EVENT_ID_NOTE}","injector_seed":{injector_seed},"schema_version":1,'
        f'"split":"{split}","violations":['
    )
    return ordered_lines(
        [
            (head, None),
            ("distractors", decoys),
            (tail, None),
            ("violations", truths),
            (f'],"violations_catalogue_sha256":"{catalogue_sha256}"}}', None),
        ]
    )


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, distractors) of a labels document."""
    document = (
        spark.read.schema(f"violations array<{LABEL_TYPE}>, distractors array<{DISTRACTOR_TYPE}>")
        .option("multiLine", True)
        .json(path)
    )
    return document.select(F.inline("violations")), document.select(F.inline("distractors"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """One canonical JSON line per record, in chain order across the written parts."""
    rows = bundle.select(
        F.col("integrity.chain_index").alias("i"), record_json(integrity=True).alias("value")
    )
    rows.orderBy("i").select("value").write.text(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A written bundle as records again, ready for verification."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def write_judge_cache(responses: DataFrame, folder: str) -> None:
    """Write each row (cache_key, value) as the file ``<cache_key>.json`` of ``folder``.

    A task that runs again writes the same files with the same text. ``folder`` is a path or
    URI that pyarrow's file systems can open on every executor.
    """
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def run(rows: Iterator[Row]) -> None:
        target, path = fs.FileSystem.from_uri(folder)
        for row in rows:
            with target.open_output_stream(f"{path}/{row.cache_key}.json") as out:
                out.write(row.value.encode())

    responses.select("cache_key", "value").where(F.col("cache_key").rlike(CACHE_KEY) & F.col("value").isNotNull()).foreachPartition(run)


def _opened(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The text of the file of each key; keys without a file are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for key in batch.column("cache_key").to_pylist():
                try:
                    with files.open_input_stream(f"{path}/{key}.json") as stream:
                        text = stream.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([text])], ["cache_key", "value"])

    return run


def judge_costs(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """Usage and latency of cached judge responses, for the ``cache_key``s given.

    With keys, the distinct ones are dealt over tasks and only their files are opened; the
    folder is not even listed. Keys without a file, null ones and ones that could not name
    a file of the folder give no row. Without keys every file of the folder is read. A file
    that is no JSON object gives a row of nulls.
    """
    if keys is None:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
        texts = spark.read.text(folder, wholetext=True).select(name.alias("cache_key"), "value")
    else:
        asked = keys.select("cache_key").where(F.col("cache_key").rlike(CACHE_KEY)).distinct()
        texts = asked.mapInArrow(_opened(folder), "cache_key string, value string")
    record = F.from_json("value", CACHE_RECORD).alias("r")
    return texts.select("cache_key", record).select(
        "cache_key", "r.fingerprint.*", "r.usage.*", "r.latency_ms", "r.response.*"
    )
