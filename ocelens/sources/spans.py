"""Span dumps: line-numbered scans, strict envelope parsing, manifests and run checks.

Files are JSON Lines; a line ends at a newline only. Rows that break the envelope become
findings and are left out, never repaired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocelens.functions.attributes import variant_value
from ocelens.operators.findings import failed_checks, finding, union
from ocelens.session import materialise
from ocelens.vocabulary import SPAN_CONTRACT

# The exact keys of a span line and of its nested objects.
ENVELOPE_KEYS = (
    "schema_version",
    "trace_id",
    "span_id",
    "parent_span_id",
    "trace_flags",
    "trace_state",
    "name",
    "kind",
    "start_time_unix_nano",
    "end_time_unix_nano",
    "status",
    "attributes",
    "events",
    "links",
    "resource",
    "scope",
    "dropped",
    "creation_index",
)
STATUS_KEYS = ("code", "description")
SCOPE_KEYS = ("name", "version", "schema_url")
DROPPED_KEYS = ("attributes", "events", "links")
MANIFEST_STRINGS = (
    "contract",
    "run_id",
    "scenario_name",
    "scenario_version",
    "catalogue_sha256",
    "seed_data_sha256",
    "model_id",
    "provider",
)
MANIFEST_INTEGERS = ("schema_version", "seed", "session_count")
SCHEMA_VERSION = 1
OTHER = "other"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line) of every line, blank ones included in the numbering.

    Files are read in splits of any size. A line's number is its place inside its split
    plus the lines of the file's earlier splits, so no file is read by one task.
    """
    raw = materialise(
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("line"),
        )
    )
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # one row per split
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    return raw.join(offsets, ["file", "block"]).select(
        "source_file", (F.col("offset") + F.col("at") - F.col("first") + 1).alias("line_no"), "line"
    )


def _shape(col: Column) -> Column:
    return F.schema_of_variant(col)


def _get(name: str) -> Column:
    return F.col("m")[name]


def _same_keys(nested: Column, keys: tuple[str, ...]) -> Column:
    found = F.map_keys(F.try_variant_get(nested, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(found) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def _text(name: str) -> Column:
    return F.when(_shape(_get(name)) == "STRING", F.try_variant_get(_get(name), "$", "string"))


def _long(name: str) -> Column:
    return F.when(_shape(_get(name)) == "BIGINT", F.try_variant_get(_get(name), "$", "bigint"))


def _is_empty_list(name: str) -> Column:
    return F.coalesce(F.to_json(_get(name)).isin("[]", "null"), F.lit(True))


def _envelope_checks() -> dict[str, Column]:
    keys = F.map_keys("m")
    expected = F.array(*[F.lit(k) for k in ENVELOPE_KEYS])
    dropped = F.try_variant_get(_get("dropped"), "$", "map<string,variant>")
    zero = F.forall(
        F.map_values(dropped),
        lambda v: (F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") == 0),
    )
    parent = _shape(_get("parent_span_id"))
    checks = {
        "envelope_unknown_key": F.size(F.array_except(keys, expected)) > 0,
        "envelope_missing_key": F.size(F.array_except(expected, keys)) > 0,
        "schema_version": _long("schema_version") != SCHEMA_VERSION,
        "dropped_keys": ~_same_keys(_get("dropped"), DROPPED_KEYS),
        "dropped_not_zero": ~zero,
        "span_events": ~_is_empty_list("events"),
        "span_links": ~_is_empty_list("links"),
        "attributes_not_object": ~_shape(_get("attributes")).startswith("OBJECT"),
        "status_keys": ~_same_keys(_get("status"), STATUS_KEYS),
        "scope_keys": ~_same_keys(_get("scope"), SCOPE_KEYS),
        "parent_type": ~parent.isin("STRING", "VOID"),
        "status_code_type": _shape(F.try_variant_get(_get("status"), "$.code", "variant")) != "STRING",
        "scope_name_type": _shape(F.try_variant_get(_get("scope"), "$.name", "variant")) != "STRING",
    }
    for name in ("trace_id", "span_id"):
        checks[f"{name}_empty"] = _text(name) == ""
    for name in ("name", "kind"):
        checks[f"{name}_type"] = _text(name).isNull()
    for name, low in (("start_time_unix_nano", 0), ("end_time_unix_nano", 0), ("creation_index", 1)):
        checks[f"{name}_value"] = _long(name) < low
    return checks


def _parsed(lines: DataFrame) -> DataFrame:
    source = F.concat_ws(":", "source_file", F.col("line_no").cast("string"))
    return (
        lines.where(~F.col("line").rlike(r"^[\s\p{Z}]*$"))
        .withColumn("source", source)
        .withColumn("v", F.expr("try_parse_json(line)"))
        .withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
        .withColumn(
            "failed",
            F.when(F.col("v").isNull(), F.array(F.lit("not_json")))
            .when(~_shape(F.col("v")).startswith("OBJECT"), F.array(F.lit("not_an_object")))
            .otherwise(failed_checks(_envelope_checks())),
        )
    )


def parse_spans(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, findings). Attribute values stay verbatim as VALUEs; shapes no attribute may
    have keep the kind ``other`` so later checks can name them."""
    # both outputs read the parse, so it is done once
    parsed = materialise(_parsed(lines).drop("v"))
    findings = parsed.select(
        F.explode("failed").alias("check_id"), F.col("source").alias("key"), F.lit("").alias("detail")
    )
    other = lambda v: F.struct(F.lit(OTHER).alias("kind"), F.to_json(v).alias("text"))
    attributes = F.transform_values(
        F.try_variant_get(_get("attributes"), "$", "map<string,variant>"),
        lambda _, v: F.coalesce(variant_value(v), other(v)),
    )
    spans = parsed.where(F.size("failed") == 0).select(
        _text("trace_id").alias("trace_id"),
        _text("span_id").alias("span_id"),
        _text("parent_span_id").alias("parent_span_id"),
        _text("name").alias("name"),
        _text("kind").alias("kind"),
        _long("start_time_unix_nano").alias("start_ns"),
        _long("end_time_unix_nano").alias("end_ns"),
        F.try_variant_get(_get("status"), "$.code", "string").alias("status_code"),
        F.try_variant_get(_get("scope"), "$.name", "string").alias("scope_name"),
        _long("creation_index").alias("creation_index"),
        "source",
        attributes.alias("attributes"),
    )
    return spans, findings


def uniqueness_findings(spans: DataFrame) -> DataFrame:
    """Span ids, or (trace, creation index) pairs, that occur twice anywhere in the run."""
    ids = spans.groupBy("span_id").count().where("count > 1")
    places = spans.groupBy("trace_id", "creation_index").count().where("count > 1")
    return union(
        [
            finding(ids, "span_id_repeated", "span_id"),
            finding(
                places,
                "creation_index_repeated",
                F.concat_ws(" ", "trace_id", F.col("creation_index").cast("string")),
            ),
        ]
    )


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest row, findings) of a run manifest, strictly typed."""
    rows = (
        spark.read.text(path, wholetext=True)
        .withColumn("source", F.col("_metadata.file_name"))
        .withColumn("v", F.expr("try_parse_json(value)"))
        .withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    )
    checks = {"manifest_not_an_object": ~_shape(F.col("v")).startswith("OBJECT")}
    for name in MANIFEST_STRINGS:
        checks[f"manifest_{name}"] = _text(name).isNull()
    for name in MANIFEST_INTEGERS:
        checks[f"manifest_{name}"] = _long(name).isNull()
    files = F.try_variant_get(_get("files"), "$", "array<array<string>>")
    checks["manifest_genai_semconv"] = _shape(_get("genai_semconv")) != "BOOLEAN"
    checks["manifest_files"] = F.exists(
        files, lambda f: (F.size(f) < 2) | F.get(f, F.lit(0)).isNull() | F.get(f, F.lit(1)).isNull()
    )
    checks["manifest_version"] = _long("schema_version") != SCHEMA_VERSION
    checks["manifest_contract_known"] = _text("contract") != SPAN_CONTRACT
    findings = rows.select(
        F.explode(failed_checks(checks)).alias("check_id"), F.col("source").alias("key"), F.lit("").alias("detail")
    )
    manifest = rows.select(
        *[_text(n).alias(n) for n in MANIFEST_STRINGS],
        *[_long(n).alias(n) for n in MANIFEST_INTEGERS],
        F.try_variant_get(_get("genai_semconv"), "$", "boolean").alias("genai_semconv"),
        F.transform(
            files,
            lambda f: F.struct(F.get(f, F.lit(0)).alias("filename"), F.get(f, F.lit(1)).alias("sha256")),
        ).alias("files"),
    )
    return manifest, findings


def run_files(manifest: DataFrame) -> DataFrame:
    return manifest.select("run_id", F.inline("files"))


@contextmanager
def _whole_files(spark: SparkSession) -> Iterator[None]:
    """While this holds, planned scans give every file a partition of its own, unsplit."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, str(1 << 50))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def verified_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source_file, line_no, line) and (filename, actual) with the SHA-256 of each file, in one read.

    A file is one partition that streams through a task: what is hashed are the lines that
    are handed on, with their line ends. Memory holds a batch of lines, whatever the size
    of the file. A byte order mark is no part of a line, so a file that begins with one
    has another hash. An empty file is not seen by scans and so counts as missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_file", "line_no", "line", "actual"]
        current, size, digest, passed, count = None, 0, None, 0, 0

        def closed() -> pa.RecordBatch:
            if passed == size - 1:  # the last line has an end, too
                digest.update(b"\n")
            columns = ([current], [None], [None], [digest.hexdigest()])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names)

        for batch in batches:
            files, values = batch.column("source_file"), batch.column("line")
            start = 0
            while start < batch.num_rows:
                file = files[start].as_py()
                stop = start + 1
                if files[batch.num_rows - 1].as_py() == file:
                    stop = batch.num_rows
                while stop < batch.num_rows and files[stop].as_py() == file:
                    stop += 1
                if file != current:
                    if current is not None:
                        yield closed()
                    current, size, digest, passed, count = file, batch.column("size")[start].as_py(), hashlib.sha256(), 0, 0
                    if batch.column("block")[start].as_py() != size:
                        raise ValueError(f"{file} was split")
                part = values.slice(start, stop - start)
                data = (b"\n" if count else b"") + b"\n".join(part.cast(pa.binary()).to_pylist())
                digest.update(data)
                passed += len(data)
                numbers = pa.array(range(count + 1, count + 1 + len(part)), pa.int64())
                count += len(part)
                nothing = pa.nulls(len(part), pa.string())
                yield pa.RecordBatch.from_arrays([files.slice(start, stop - start), numbers, part, nothing], names)
                start = stop
        if current is not None:
            yield closed()

    meta = F.col("_metadata")
    scanned = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_name"].alias("source_file"), meta["file_size"].alias("size"), meta["file_block_length"].alias("block"), F.col("value").alias("line")
    )
    with _whole_files(spark):
        rows = materialise(scanned.mapInArrow(run, "source_file string, line_no long, line string, actual string"))
    lines = rows.where("line_no is not null").select("source_file", "line_no", "line")
    hashed = rows.where("line_no is null").select(F.col("source_file").alias("filename"), "actual")
    return lines, hashed


def file_findings(compared: DataFrame) -> DataFrame:
    """Listed files that are missing, changed, or differ from another only by case.

    A file without a listed hash counts as changed.
    """
    files = compared.select("filename")
    folded = files.groupBy(F.lower("filename").alias("folded")).agg(
        F.count("*").alias("n"), F.min("filename").alias("filename")
    )
    return union(
        [
            finding(compared.where("actual IS NULL"), "file_missing", "filename"),
            finding(
                compared.where("actual IS NOT NULL AND NOT (actual <=> sha256)"), "file_sha256", "filename", F.col("actual")
            ),
            finding(folded.where("n > 1"), "file_case_collision", "filename"),
        ]
    )


def read_run(spark: SparkSession, folder: str, manifest_name: str = "manifest.json") -> tuple[DataFrame, DataFrame]:
    """(spans, findings) of the files a manifest lists; files that fail their hash are left out."""
    manifest, manifest_findings = read_manifest(spark, f"{folder}/{manifest_name}")
    every_line, hashes = verified_lines(spark, folder)
    compared = materialise(run_files(manifest).join(hashes, "filename", "left"))
    sound = compared.where("actual <=> sha256 AND actual IS NOT NULL")
    lines = every_line.join(
        sound.select(F.col("filename").alias("source_file")), "source_file", "left_semi"
    )
    spans, span_findings = parse_spans(lines)
    traces = spans.agg(F.countDistinct("trace_id").alias("traces")).withColumn("one", F.lit(1))
    declared = manifest.select("session_count", "run_id").withColumn("one", F.lit(1))
    miscounted = declared.join(traces, "one").where("traces <> session_count")
    findings = union(
        [
            manifest_findings,
            file_findings(compared),
            span_findings,
            uniqueness_findings(spans),
            finding(miscounted, "session_count", "run_id", F.col("traces").cast("string")),
        ]
    )
    return spans, findings
