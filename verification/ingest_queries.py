"""Span parsing, decoding, normalisation, mapping and validation over conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.functions.canonical import json_attrs, utc_text
from ocelens.model import EventLog
from ocelens.operators import decode, mapping, normalise, validate
from verification.conversation_spans import conversation_lines
from verification.order_log import order_log
from ocelens.session import configure, materialise, shared_folder
from ocelens.sources import sidecars, spans
from ocelens.vocabulary import SPAN_CONTRACT
from verification.order_sql import with_orders


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    return run


def _spans(spark, sf_dir) -> DataFrame:
    return materialise(spans.parse_spans(conversation_lines(spark, sf_dir))[0])


def _damaged(lines: DataFrame) -> DataFrame:
    """The event line of every even turn broken in one of five ways, by conversation."""
    n = F.floor((F.col("line_no") - 1) / 3)
    conv = F.regexp_extract("source_file", "SES-([0-9]+)", 1).cast("int")
    way = F.when((F.col("line_no") % 3 == 1) & (n % 2 == 0), conv % 5)
    line = F.col("line")
    broken = (
        F.when(way == 0, F.expr("substring(line, 1, 40)"))
        .when(way == 1, F.replace(line, F.lit('"trace_flags"'), F.lit('"flags"')))
        .when(way == 2, F.replace(line, F.lit('"dropped":{"attributes":0'), F.lit('"dropped":{"attributes":2')))
        .when(way == 3, F.replace(line, F.lit('"schema_version":1'), F.lit('"schema_version":2')))
        .when(way == 4, F.replace(line, F.lit('"events":[]'), F.lit('"events":[{}]')))
        .otherwise(line)
    )
    return lines.select("source_file", "line_no", broken.alias("line"))


@_query
def span_lines(spark, sf_dir):
    """Lines written as text files and scanned back with their numbers."""
    lines = conversation_lines(spark, sf_dir)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines.repartitionByRange("source_file", "line_no").sortWithinPartitions("source_file", "line_no").select(
        F.col("line").alias("value")
    ).write.text(path)
    read = spans.read_lines(spark, path)
    # numbers are dense per file when the largest one is the number of lines
    per_file = read.groupBy("source_file").agg(
        F.count("*").alias("n"), F.max("line_no").alias("high"), F.countDistinct("line_no").alias("different")
    )
    return per_file.agg(
        F.sum("n").alias("lines"), F.bool_and((F.col("n") == F.col("high")) & (F.col("n") == F.col("different"))).alias("dense")
    )


@_query
def verified_run(spark, sf_dir):
    """A run written with its manifest and read again: findings by check, and the spans.

    One listed hash is wrong, one listed file is not there, and no session is declared. The
    spans of the file that fails are counted from the file, as they must be missing.
    """
    lines = conversation_lines(spark, sf_dir)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    dealt = lines.repartition(16, "source_file").sortWithinPartitions("source_file", "line_no")
    dealt.select(F.col("line").alias("value")).write.text(folder)
    # hashes by another way than the reader's
    written = spark.read.format("binaryFile").load(f"{folder}/part-*").where("length > 0")
    files = written.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    wrong = files.agg(F.min("name")).first()[0]
    listed = F.collect_list(F.array("name", F.when(F.col("name") == wrong, F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256"))))
    fixed = {"schema_version": 1, "contract": SPAN_CONTRACT, "run_id": "run", "seed": 1, "session_count": 0, "genai_semconv": False}
    fixed |= dict.fromkeys(("scenario_name", "scenario_version", "catalogue_sha256", "seed_data_sha256", "model_id", "provider"), "x")
    absent = F.array(F.array(F.lit("absent.jsonl"), F.repeat(F.lit("1"), 64)))
    manifest = files.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], F.concat(listed, absent).alias("files"))).alias("value"))
    manifest.coalesce(1).write.text(f"{folder}/manifest.json")
    rows, findings = spans.read_run(spark, folder)
    lost = spark.read.option("lineSep", "\n").text(f"{folder}/{wrong}").agg(F.count("*").alias("lost"))
    kept = rows.agg(F.count("*").alias("kept"))
    both = kept.join(lost).select(F.lit("spans").alias("check_id"), (F.col("kept") + F.col("lost")).alias("n"))
    return findings.groupBy("check_id").agg(F.count("*").alias("n")).unionByName(both)


@_query
def parsed_spans(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    return rows.select(
        "trace_id", "span_id", "parent_span_id", "name", "creation_index", "start_ns", F.size("attributes").alias("n_attributes")
    )


@_query
def span_findings(spark, sf_dir):
    _, findings = spans.parse_spans(_damaged(conversation_lines(spark, sf_dir)))
    return findings.groupBy("check_id").agg(F.count("*").alias("lines"))


@_query
def span_uniqueness(spark, sf_dir):
    """The dump with every tool span's line read twice."""
    rows = _spans(spark, sf_dir)
    doubled = rows.unionByName(rows.where("name = 'tool'"))
    return spans.uniqueness_findings(doubled).groupBy("check_id").agg(F.count("*").alias("keys"))


@_query
def decoded_events(spark, sf_dir):
    events = decode.event_spans(_spans(spark, sf_dir))
    return events.select(
        "event_id",
        "event_type",
        "session_id",
        "seq",
        "time",
        F.coalesce("actor_id", F.lit("")).alias("actor_id"),
        "obj_count",
        F.size("attrs").alias("n_attrs"),
    )


@_query
def decoded_object_refs(spark, sf_dir):
    refs = decode.object_refs(decode.event_spans(_spans(spark, sf_dir)))
    return refs.select(
        "event_id", "idx", "object_type", "object_id", F.coalesce("qualifier", F.lit("")).alias("qualifier"), "declares"
    )


@_query
def contract_findings(spark, sf_dir):
    """Contract breaks after claiming one object too many in every fourth turn and
    dropping the step index in every third."""
    lines = conversation_lines(spark, sf_dir)
    n = F.floor(F.col("line_no") / 3)
    spoiled = lines.withColumn(
        "line",
        F.when(n % 4 == 0, F.replace(F.col("line"), F.lit('"at.obj.count":3'), F.lit('"at.obj.count":4')))
        .when(n % 3 == 0, F.replace(F.col("line"), F.lit("at.event.attr.step_index"), F.lit("at.event.attr.stepindex")))
        .otherwise(F.col("line")),
    )
    events = decode.event_spans(spans.parse_spans(spoiled)[0])
    return decode.contract_findings(events).groupBy("check_id").agg(F.count("*").alias("events"))


@_query
def sequence_findings(spark, sf_dir):
    """Sequence gaps after every second turn of odd conversations went missing."""
    rows = _spans(spark, sf_dir)
    event_id = F.col("attributes")["at.event.id"]["text"]
    lost = F.coalesce(
        (F.split(event_id, "-")[1].cast("int") % 2 == 1) & (F.split(event_id, "-")[2] == "2"), F.lit(False)
    )
    kept = rows.where(~lost)
    return decode.sequence_findings(kept, decode.event_spans(kept)).select("check_id", "key")


@_query
def round_trip(spark, sf_dir):
    """Events encoded back to attributes and decoded again: nothing may change."""
    rows = _spans(spark, sf_dir)
    events = decode.event_spans(rows)
    encoded = decode.flatten_events(events, decode.object_refs(events), decode.o2o_refs(events))
    again = rows.where(decode.is_event()).withColumn("event_id", F.col("attributes")["at.event.id"]["text"])
    scoped = [*decode.SCOPE_KEYS.values(), "at.span.role", "session.id"]
    own = F.map_filter("attributes", lambda k, _: ~k.isin(*scoped))
    before = again.select("event_id", json_attrs(own).alias("before"))
    after = encoded.select("event_id", json_attrs(F.col("attributes")).alias("after"))
    both = before.join(after, "event_id")
    # re-encoding sorts the entries, so equal text means the writer was already canonical
    return both.agg(
        F.count("*").alias("events"),
        F.count_if(F.length("before") == F.length("after")).alias("same_length"),
    )


def _normalised(spark, sf_dir) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return normalise.normalise(rows.where(~decode.is_event() & F.col("parent_span_id").isNotNull()))


@_query
def normalised_attributes(spark, sf_dir):
    return _normalised(spark, sf_dir).select(
        "trace_id",
        "span_id",
        F.col("kind_of_span").alias("kind"),
        json_attrs(F.col("canonical")).alias("canonical"),
        F.array_join("failed", ",").alias("failed"),
    )


@_query
def attribute_key_counts(spark, sf_dir):
    return normalise.key_counts(_normalised(spark, sf_dir))


@_query
def attribute_coverage(spark, sf_dir):
    census = normalise.census_coverage(decode.event_spans(_spans(spark, sf_dir)))
    kinds = normalise.kind_coverage(_normalised(spark, sf_dir))
    return census.select(F.col("event_type").alias("name"), "spans", "present", "total").unionAll(kinds)


@_query
def mapped_fraction(spark, sf_dir):
    census = normalise.census_coverage(decode.event_spans(_spans(spark, sf_dir)))
    return normalise.mapped_fraction(census, normalise.kind_coverage(_normalised(spark, sf_dir)))


@_query
def coverage_report(spark, sf_dir):
    census = normalise.census_coverage(decode.event_spans(_spans(spark, sf_dir)))
    rows = _normalised(spark, sf_dir)
    return sidecars.coverage_report(census, normalise.kind_coverage(rows), normalise.key_counts(rows))


@_query
def nearest_ancestors(spark, sf_dir):
    return mapping.attribution(_spans(spark, sf_dir))


@_query
def tree_findings(spark, sf_dir):
    """Trees after the model spans of even conversations lost their place: every third
    of them points at its own child, the others at nothing."""
    rows = _spans(spark, sf_dir)
    own = F.conv(F.substring("span_id", 2, 8), 16, 10).cast("int")
    turn = F.conv(F.substring("span_id", 10, 7), 16, 10).cast("int")
    hit = (F.col("name") == "model") & (own % 2 == 0)
    child = F.concat(F.lit("d"), F.substring("span_id", 2, 15))
    parent = F.when(hit & (turn % 3 == 0), child).when(hit, F.lit("nowhere")).otherwise(F.col("parent_span_id"))
    findings = mapping.tree_findings(rows.withColumn("parent_span_id", parent))
    return findings.groupBy("check_id").agg(F.count("*").alias("spans"))


@_query
def mapped_relations(spark, sf_dir):
    run = mapping.map_spans(_spans(spark, sf_dir))
    return run.log.relations.select(
        "event_id", "event_type", utc_text(F.col("ts")).alias("ts"), "session_id", "object_id", "object_type", "qualifier"
    )


@_query
def mapped_objects(spark, sf_dir):
    run = mapping.map_spans(_spans(spark, sf_dir))
    return run.log.objects.select("object_id", "object_type", json_attrs(F.col("attrs")).alias("attrs"))


@_query
def span_index(spark, sf_dir):
    run = mapping.map_spans(_spans(spark, sf_dir))
    return run.event_spans.select(
        "event_id", "trace_id", "span_id", F.array_join("enrichment_span_ids", ",").alias("enrichment")
    )


@_query
def declaration_findings(spark, sf_dir):
    """Declarations after the models of conversations divisible by ten changed their text."""
    rows = _spans(spark, sf_dir)
    refs = decode.object_refs(decode.event_spans(rows))
    conv = F.split("event_id", "-")[1].cast("int")
    changed = refs.withColumn(
        "attrs",
        F.when(
            (F.col("object_type") == "Model") & (conv % 10 == 0) & (F.size("attrs") > 0),
            F.map_concat(
                "attrs", F.create_map(F.lit("version"), F.struct(F.lit("string").alias("kind"), F.lit("2").alias("text")))
            ),
        ).otherwise(F.col("attrs")),
    )
    return mapping.declaration_findings(changed).select("check_id", "key")


@_query
def log_findings(spark, sf_dir):
    """The order log after handoffs to AGT-0 became reads, every tenth applicant vanished,
    blank lawful bases of every fourth part turned to "none", approver roles became
    numbers and every hundredth decision was derived twice."""
    log = order_log(spark, sf_dir)
    number = F.regexp_extract("object_id", "([0-9]+)$", 1).cast("bigint")
    kind = F.col("object_type")
    spoiled = F.transform_values(
        "attrs",
        lambda n, v: F.when(
            (n == "lawful_basis") & (v["text"] == "") & (number % 4 == 0), v.withField("text", F.lit("none"))
        )
        .when((n == "role") & (kind == "HumanApprover"), v.withField("kind", F.lit("integer")))
        .otherwise(v),
    )
    objects = log.objects.where(~((kind == "Applicant") & (number % 10 == 0))).withColumn("attrs", spoiled)
    e2o = log.relations.select(
        "event_id",
        "object_id",
        F.when(F.expr("event_type = 'handoff' AND object_id = 'AGT-0' AND qualifier = 'to'"), F.lit("reads"))
        .otherwise(F.col("qualifier"))
        .alias("qualifier"),
    )
    twice = log.o2o.where(
        (F.col("qualifier") == "derived_from")
        & (F.regexp_extract("source_id", "([0-9]+)$", 1).cast("bigint") % 100 == 0)
    )
    damaged = EventLog(log.events, objects, e2o, log.o2o.unionByName(twice))
    return validate.log_findings(damaged).groupBy("check_id").agg(F.count("*").alias("rows"))


@_query
def cached_costs(spark, sf_dir):
    """A response for every conversation is cached in a file; conversations of four turns or more are asked for."""
    said = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.length("text"))), F.lit(0))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    talks = materialise(
        turns.groupBy("conv_id")
        .agg(F.count("*").alias("turns"), said("user").alias("asked"), said("assistant").alias("told"))
        .withColumn("cache_key", F.sha2(F.concat(F.lit("conversation:"), "conv_id"), 256))
    )
    record = F.to_json(
        F.struct(
            F.struct(
                F.concat(F.lit("SES-"), "conv_id").alias("session_id"), F.col("turns").cast("int").alias("sample_index")
            ).alias("fingerprint"),
            (F.col("turns") * 25).alias("latency_ms"),
            F.struct(F.concat(F.lit('{"turns": '), "turns", F.lit("}")).alias("raw_text"), (F.col("told") == 0).alias("schema_failure")).alias("response"),
            F.struct(F.col("asked").alias("input_tokens"), F.col("told").alias("output_tokens")).alias("usage"),
        )
    )
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sidecars.write_judge_cache(talks.select("cache_key", record.alias("value")), folder)
    asked = talks.where("turns >= 4").select(F.explode(F.array("cache_key", F.concat("cache_key", F.lit("0")), F.lit(None))).alias("cache_key"))
    return sidecars.judge_costs(spark, folder, asked).select(
        "cache_key", "session_id", "sample_index", "input_tokens", "output_tokens", "latency_ms", "raw_text", "schema_failure"
    )


QUERIES = {
    "cached_costs": cached_costs,
    "span_lines": span_lines,
    "verified_run": verified_run,
    "parsed_spans": parsed_spans,
    "span_findings": span_findings,
    "span_uniqueness": span_uniqueness,
    "decoded_events": decoded_events,
    "decoded_object_refs": decoded_object_refs,
    "contract_findings": contract_findings,
    "sequence_findings": sequence_findings,
    "span_round_trip": round_trip,
    "normalised_attributes": normalised_attributes,
    "attribute_key_counts": attribute_key_counts,
    "attribute_coverage": attribute_coverage,
    "mapped_fraction": mapped_fraction,
    "coverage_report": coverage_report,
    "nearest_ancestors": nearest_ancestors,
    "tree_findings": tree_findings,
    "mapped_relations": mapped_relations,
    "mapped_objects": mapped_objects,
    "span_index": span_index,
    "declaration_findings": declaration_findings,
    "log_findings": log_findings,
}

_T = """
WITH t AS (
  SELECT conv_id AS c, turn - min(turn) OVER (PARTITION BY conv_id) + 1 AS n, text,
    CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'session_start' WHEN role = 'user' THEN 'invoke_agent'
         WHEN role = 'assistant' THEN 'call_llm' ELSE 'call_tool' END AS event_type,
    lpad(upper(to_hex(conv_id)), 8, '0') AS hc
  FROM conversations
), u AS (
  SELECT *, lpad(upper(to_hex(c)), 32, '0') AS trace, hc || lpad(upper(to_hex(n)), 7, '0') AS tail FROM t
)"""
_TIME = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c * 60 + n), '%Y-%m-%dT%H:%M:%SZ')"
_REFS = _T + """, ref AS (
  SELECT c, n, event_type, 0 AS idx, 'Session' AS object_type, 'SES-' || c AS object_id, 'within' AS qualifier, event_type = 'session_start' AS declares FROM u
  UNION ALL SELECT c, n, event_type, 1, 'Application', 'APP-' || c, 'concerns', event_type = 'session_start' FROM u
  UNION ALL SELECT c, n, event_type, 2, 'Agent', 'AGT-CHAT', CASE WHEN event_type = 'session_start' THEN '' ELSE 'performed_by' END, event_type = 'session_start' FROM u
  UNION ALL SELECT c, n, event_type, 3, 'Applicant', 'APN-' || c, 'concerns', true FROM u WHERE event_type = 'session_start'
  UNION ALL SELECT c, n, event_type, 3, 'Model', 'MDL-' || (c % 3), 'uses', true FROM u WHERE event_type = 'call_llm'
)"""
_NORM = _T + """, e AS (
  SELECT trace AS trace_id, 'b' || tail AS span_id, 'LLM' AS kind,
    '{"invocation.max_tokens":256,"invocation.temperature":0.5,"model.name":"' ||
    (CASE WHEN c % 2 = 1 AND c % 7 = 0 THEN 'other' ELSE 'm' || (c % 3) END) || '"' ||
    (CASE WHEN c % 11 = 0 THEN '' ELSE ',"model.provider":"p"' END) ||
    ',"session.id":"SES-' || c || '","span.kind":"LLM","tokens.input":' || length(text) || ',"tokens.output":' || n ||
    ',"tokens.total":' || (length(text) + n) || '}' AS canonical,
    CASE WHEN c % 7 = 0 THEN 'conflicting_sources' ELSE '' END AS failed, c FROM u WHERE event_type = 'call_llm'
  UNION ALL
  SELECT trace, 'd' || tail, 'TOOL', '{"session.id":"SES-' || c || '","span.kind":"TOOL","tool.name":"lookup"}', '', c
  FROM u WHERE event_type = 'call_llm'
)"""
_COVER = _NORM + """, cov AS (
  SELECT event_type AS name, count(*) AS spans, CAST(sum(k) AS BIGINT) AS present, CAST(sum(k) AS BIGINT) AS total FROM (
    SELECT event_type, CASE event_type WHEN 'session_start' THEN 11 WHEN 'invoke_agent' THEN 8 WHEN 'call_llm' THEN 10 ELSE 8 END AS k FROM u)
  GROUP BY 1
  UNION ALL
  SELECT kind, count(*), CAST(sum(CASE WHEN kind = 'TOOL' THEN 3 WHEN c % 11 = 0 THEN 8 ELSE 9 END) AS BIGINT),
         CAST(sum(CASE WHEN kind = 'TOOL' THEN 4 ELSE 9 END) AS BIGINT) FROM e GROUP BY 1
), keyc AS (
  SELECT 'missing' AS bucket, 'tool.description' AS key, count(*) AS spans FROM e WHERE kind = 'TOOL' HAVING count(*) > 0
  UNION ALL SELECT 'missing', 'model.provider', count(*) FROM e WHERE kind = 'LLM' AND c % 11 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'recorded', 'input.value', count(*) FROM e WHERE kind = 'LLM' AND c % 2 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'recorded', 'gen_ai.response.id', count(*) FROM e WHERE kind = 'LLM' AND c % 2 = 1 HAVING count(*) > 0
  UNION ALL SELECT 'unknown', 'vendor.extra', count(*) FROM e WHERE kind = 'LLM' AND c % 2 = 0 HAVING count(*) > 0
)"""
_KEYS = (
    "coalesce((SELECT string_agg('\"' || key || '\":' || spans, ',' ORDER BY key) FROM keyc WHERE bucket = '{}'), '')"
)
_LINES = "(SELECT count(*) + count(*) FILTER (WHERE n = 1) + 2 * count(*) FILTER (WHERE event_type = 'call_llm') FROM u)"

ORACLES = {
    "cached_costs": """SELECT sha256('conversation:' || conv_id) AS cache_key, 'SES-' || conv_id AS session_id, CAST(turns AS INTEGER) AS sample_index,
  CAST(asked AS BIGINT) AS input_tokens, CAST(told AS BIGINT) AS output_tokens, turns * 25 AS latency_ms,
  '{"turns": ' || turns || '}' AS raw_text, told = 0 AS schema_failure
FROM (SELECT conv_id, count(*) AS turns, coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0) AS asked,
        coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS told
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
WHERE turns >= 4""",
    "verified_run": _T + f""" SELECT 'spans' AS check_id, CAST({_LINES} AS BIGINT) AS n
UNION ALL SELECT * FROM (VALUES ('file_missing', 1), ('file_sha256', 1), ('session_count', 1)) f(check_id, n)""",
    "span_lines": _T + f" SELECT CAST({_LINES} AS BIGINT) AS lines, true AS dense",
    "parsed_spans": _T + """
SELECT trace AS trace_id, 'a' || hc || '0000000' AS span_id, NULL AS parent_span_id, 'root' AS name, 1 AS creation_index,
       1000 AS start_ns, 11 AS n_attributes FROM u WHERE n = 1
UNION ALL SELECT trace, 'e' || tail, 'a' || hc || '0000000', 'event', 3 * n - 1, (3 * n - 1) * 1000,
  17 + CASE event_type WHEN 'session_start' THEN 29 WHEN 'invoke_agent' THEN 13 WHEN 'call_llm' THEN 20 ELSE 13 END FROM u
UNION ALL SELECT trace, 'b' || tail, 'e' || tail, 'model', 3 * n, 3 * n * 1000,
  8 + CASE WHEN c % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END FROM u WHERE event_type = 'call_llm'
UNION ALL SELECT trace, 'd' || tail, 'b' || tail, 'tool', 3 * n + 1, (3 * n + 1) * 1000, 3 FROM u WHERE event_type = 'call_llm'""",
    "span_uniqueness": _T + """
SELECT k AS check_id, count(*) AS keys FROM u, (VALUES ('span_id_repeated'), ('creation_index_repeated')) v(k)
WHERE event_type = 'call_llm' GROUP BY k""",
    "decoded_events": _T + f"""
SELECT 'EV-' || c || '-' || n AS event_id, event_type, 'SES-' || c AS session_id, n AS seq, {_TIME} AS time,
  CASE WHEN event_type = 'session_start' THEN '' ELSE 'AGT-CHAT' END AS actor_id,
  CASE WHEN event_type IN ('session_start', 'call_llm') THEN 4 ELSE 3 END AS obj_count,
  CASE event_type WHEN 'session_start' THEN 5 WHEN 'call_llm' THEN 4 ELSE 2 END AS n_attrs FROM u""",
    "decoded_object_refs": _REFS
    + " SELECT 'EV-' || c || '-' || n AS event_id, idx, object_type, object_id, qualifier, declares FROM ref",
    "contract_findings": _T + """
SELECT 'object_indices' AS check_id, count(*) AS events FROM u WHERE event_type IN ('invoke_agent', 'call_tool') AND n % 4 = 0 HAVING count(*) > 0
UNION ALL SELECT 'required_attributes', count(*) FROM u WHERE event_type = 'invoke_agent' AND n % 4 <> 0 AND n % 3 = 0 HAVING count(*) > 0""",
    "sequence_findings": _T + """
SELECT 'sequence_not_dense' AS check_id, trace AS key FROM u GROUP BY trace, c HAVING c % 2 = 1 AND max(n) > 2""",
    "normalised_attributes": _NORM + " SELECT trace_id, span_id, kind, canonical, failed FROM e",
    "attribute_key_counts": _COVER + " SELECT * FROM keyc",
    "attribute_coverage": _COVER + " SELECT * FROM cov",
    "mapped_fraction": _COVER
    + " SELECT CAST(sum(present) AS BIGINT) AS present, CAST(sum(total) AS BIGINT) AS total,"
    " CAST(sum(present) AS DOUBLE) / sum(total) AS mapped_fraction FROM cov",
    "nearest_ancestors": _T + """
SELECT trace AS trace_id, 'b' || tail AS span_id, 'e' || tail AS anchor FROM u WHERE event_type = 'call_llm'
UNION ALL SELECT trace, 'd' || tail, 'e' || tail FROM u WHERE event_type = 'call_llm'""",
    "tree_findings": _T + """
SELECT 'parent_missing' AS check_id, count(*) AS spans FROM u WHERE event_type = 'call_llm' AND c % 2 = 0 AND n % 3 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'unreachable_from_root', 2 * count(*) FROM u WHERE event_type = 'call_llm' AND c % 2 = 0 HAVING count(*) > 0""",
    "mapped_relations": _REFS + f"""
SELECT 'EV-' || c || '-' || n AS event_id, event_type, {_TIME} AS ts, 'SES-' || c AS session_id, object_id, object_type,
  CASE WHEN qualifier = '' THEN 'declares' ELSE qualifier END AS qualifier FROM ref""",
    "mapped_objects": _T + """
SELECT 'SES-' || c AS object_id, 'Session' AS object_type, '{"session_id":"SES-' || c || '","workflow_name":"chat"}' AS attrs FROM u WHERE n = 1
UNION ALL SELECT 'APP-' || c, 'Application', '{"amount":' || length(text) || '}' FROM u WHERE n = 1
UNION ALL SELECT 'APN-' || c, 'Applicant', '{"applicant_id":"APN-' || c || '"}' FROM u WHERE n = 1
UNION ALL SELECT 'AGT-CHAT', 'Agent', '{"role":"intake","version":"1"}'
UNION ALL SELECT DISTINCT 'MDL-' || (c % 3), 'Model', '{"model_id":"MDL-' || (c % 3) || '"}' FROM u WHERE event_type = 'call_llm'""",
    "span_index": _T + """
SELECT 'EV-' || c || '-' || n AS event_id, trace AS trace_id, 'e' || tail AS span_id,
  CASE WHEN event_type = 'call_llm' THEN 'b' || tail || ',d' || tail ELSE '' END AS enrichment FROM u""",
    "declaration_findings": _T + """
SELECT 'declaration_conflict' AS check_id, 'MDL-' || (c % 3) AS key FROM u WHERE event_type = 'call_llm'
GROUP BY c % 3 HAVING count(*) FILTER (WHERE c % 10 = 0) > 0 AND count(*) FILTER (WHERE c % 10 <> 0) > 0""",
    "log_findings": with_orders("""
SELECT 'edge_qualifier_illegal' AS check_id, count(*) AS rows FROM rel
WHERE event_type = 'handoff' AND qualifier = 'to' AND object_id = 'AGT-0' HAVING count(*) > 0
UNION ALL SELECT 'edge_object_undeclared', count(*) FROM rel
WHERE object_type = 'Applicant' AND CAST(substr(object_id, 5) AS BIGINT) % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'o2o_object_undeclared', count(*) FROM o2o
WHERE qualifier = 'submitted_by' AND CAST(substr(target_id, 5) AS BIGINT) % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'attribute_text', count(*) FROM resource
WHERE lawful_basis = '' AND CAST(substr(object_id, 5) AS BIGINT) % 4 = 0 HAVING count(*) > 0
UNION ALL SELECT 'attribute_kind', count(*) FROM approver_role HAVING count(*) > 0
UNION ALL SELECT 'attribute_integer_bound', count(*) FROM approver_role WHERE false HAVING count(*) > 0
UNION ALL SELECT 'o2o_repeated', count(*) FROM sess WHERE k % 100 = 0 AND k % 17 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'object_without_edge', count(*) FROM (
  SELECT object_id FROM resource UNION ALL SELECT object_id FROM approver_role
  UNION ALL SELECT 'CUS-' || c_custkey FROM customer WHERE c_custkey % 10 <> 0)
WHERE object_id NOT IN (SELECT object_id FROM rel) HAVING count(*) > 0"""),
    "span_findings": _T + """
SELECT v.name AS check_id, count(*) AS lines FROM u JOIN (VALUES (0, 'not_json'), (1, 'envelope_unknown_key'),
  (1, 'envelope_missing_key'), (2, 'dropped_not_zero'), (3, 'schema_version'), (4, 'span_events')) v(way, name)
  ON v.way = c % 5 WHERE n % 2 = 0 GROUP BY 1""",
    "span_round_trip": _T + " SELECT count(*) AS events, count(*) AS same_length FROM u",
    "coverage_report": _COVER + """
SELECT '{"contract":"at-span/1","layer_a":{"census_present":' || a.p || ',"census_total":' || a.t || ',"event_count":' || a.s ||
  ',"per_event_type":{' || a.m || '}},"layer_b":{"expected_present":' || b.p || ',"expected_total":' || b.t ||
  ',"per_kind":{' || b.m || '},"span_count":' || b.s || '},"mapped_fraction":' ||
  CAST(CAST(a.p + b.p AS DOUBLE) / (a.t + b.t) AS VARCHAR) || ',"missing_keys":{' || k('missing') || '},"recorded_keys":{' ||
  k('recorded') || '},"run":null,"schema_version":1,"unknown_keys":{' || k('unknown') || '}}' AS value
FROM (SELECT CAST(sum(present) AS BIGINT) AS p, CAST(sum(total) AS BIGINT) AS t, CAST(sum(spans) AS BIGINT) AS s,
        string_agg('"' || name || '":{"present":' || present || ',"total":' || total || '}', ',' ORDER BY name) AS m
      FROM cov WHERE name NOT IN ('LLM', 'TOOL')) a,
     (SELECT CAST(sum(present) AS BIGINT) AS p, CAST(sum(total) AS BIGINT) AS t, CAST(sum(spans) AS BIGINT) AS s,
        string_agg('"' || name || '":{"present":' || present || ',"total":' || total || '}', ',' ORDER BY name) AS m
      FROM cov WHERE name IN ('LLM', 'TOOL')) b"""
    .replace("k('missing')", _KEYS.format("missing"))
    .replace("k('recorded')", _KEYS.format("recorded"))
    .replace("k('unknown')", _KEYS.format("unknown")),
}
