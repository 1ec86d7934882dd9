import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ocelens.functions.canonical import json_attrs
from ocelens.model import EventLog
from ocelens.operators import bundles, evidence, mapping, validate
from ocelens.operators.constraints import evaluate
from ocelens.operators.findings import assert_valid
from ocelens.operators.rules import DEFAULT_RULES, rules_frame
from ocelens.sources import ocel, sidecars, spans, tables
from ocelens.vocabulary import CREDIT
from tests.builders import OBJECTS, decision, make_log


def _span(i, parent, attrs, **over):
    row = {
        "schema_version": 1, "trace_id": "f" * 32, "span_id": f"{i:016x}", "parent_span_id": parent, "trace_flags": 1,
        "trace_state": "", "name": "n", "kind": "INTERNAL", "start_time_unix_nano": i, "end_time_unix_nano": i + 1,
        "status": {"code": "UNSET", "description": ""}, "attributes": attrs, "events": [], "links": [],
        "resource": {"attributes": {}, "schema_url": ""}, "scope": {"name": "s", "version": "", "schema_url": ""},
        "dropped": {"attributes": 0, "events": 0, "links": 0}, "creation_index": i,
    }
    return {**row, **over}


def _write(path, rows):
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n" if isinstance(r, dict) else r + "\n" for r in rows)
    path.write_text(text, encoding="utf-8", newline="\n")
    return hashlib.sha256(text.encode()).hexdigest()


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    rows = [f"line {i}   {'x' * 50}" if i % 7 else "" for i in range(1, 4001)]
    _write(tmp_path / "a.jsonl", rows)
    _write(tmp_path / "b.jsonl", rows[:10])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = spans.read_lines(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.source_file, r.line_no, r.line) for r in got} == {
        (f, i + 1, t) for f, n in (("a.jsonl", 4000), ("b.jsonl", 10)) for i, t in enumerate(rows[:n])
    }


@pytest.mark.parametrize(
    "row, check",
    [
        ("not json", "not_json"),
        ("[1]", "not_an_object"),
        (_span(1, None, {}, extra=1), "envelope_unknown_key"),
        (_span(1, None, {}, schema_version=2), "schema_version"),
        (_span(1, None, {}, dropped={"attributes": 1, "events": 0, "links": 0}), "dropped_not_zero"),
        (_span(1, None, {}, dropped={"attributes": False, "events": 0, "links": 0}), "dropped_not_zero"),
        (_span(1, None, {}, events=[{}]), "span_events"),
        (_span(1, None, {}, links=[1]), "span_links"),
        (_span(1, None, []), "attributes_not_object"),
        (_span(1, 5, {}), "parent_type"),
        (_span(1, None, {}, trace_id=""), "trace_id_empty"),
        (_span(1, None, {}, creation_index=True), "creation_index_value"),
        (_span(1, None, {}, creation_index=0), "creation_index_value"),
        (_span(1, None, {}, status={"code": "OK"}), "status_keys"),
        (_span(1, None, {}, name=3), "name_type"),
    ],
)
def test_envelope_checks(spark, row, check):
    line = row if isinstance(row, str) else json.dumps(row)
    lines = spark.createDataFrame([("f", 1, line)], "source_file string, line_no long, line string")
    parsed, findings = spans.parse_spans(lines)
    assert check in {r.check_id for r in findings.collect()} and parsed.count() == 0


def test_manifest_verified_run(spark, tmp_path):
    digest = _write(tmp_path / "s.jsonl", [_span(1, None, {"a": 1.0, "b": [True]}), "", _span(2, f"{1:016x}", {})])
    _write(tmp_path / "unlisted.jsonl", ["garbage"])
    manifest = {
        "schema_version": 1, "contract": "at-span/1", "run_id": "r", "scenario_name": "s", "scenario_version": "1",
        "seed": 1, "session_count": 1, "catalogue_sha256": "", "seed_data_sha256": "", "model_id": "", "provider": "",
        "genai_semconv": False, "files": [["s.jsonl", digest]],
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    rows, findings = spans.read_run(spark, str(tmp_path))
    assert_valid(findings)
    assert [r.source for r in rows.orderBy("source").collect()] == ["s.jsonl:1", "s.jsonl:3"]
    kinds = rows.where("creation_index = 1").first().attributes
    assert kinds["a"].kind == "float" and kinds["b"].kind == "other"
    manifest.update(session_count=2, genai_semconv="false", files=[["s.jsonl", "0" * 64], ["S.jsonl", digest]])
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    _, findings = spans.read_run(spark, str(tmp_path))
    found = {r.check_id for r in findings.collect()}
    assert {"file_sha256", "file_missing", "file_case_collision", "session_count", "manifest_genai_semconv"} <= found
    with pytest.raises(ValueError):
        assert_valid(findings)


def test_files_are_hashed_and_numbered_in_one_read(spark, tmp_path):
    long = "x" * 300_000
    contents = {
        "a.jsonl": b"one\ntwo\n", "b.jsonl": b"one\ntwo", "d.jsonl": b"\n", "e.jsonl": b"\n\n a\r\n",
        "f.jsonl": ("\n".join(f"{k} {long if k % 1000 == 0 else ''}" for k in range(25_000))).encode(), "g.jsonl": "ü\u2028ß\n".encode(),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines, hashes = spans.verified_lines(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert dict(map(tuple, hashes.collect())) == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    got = {}
    for r in lines.collect():
        got.setdefault(r.source_file, []).append((r.line_no, r.line))
    want = {n: d.decode().removesuffix("\n").split("\n") for n, d in contents.items() if d}
    assert {n: sorted(v) for n, v in got.items()} == {n: list(enumerate(v, 1)) for n, v in want.items()}


def _facts(log):
    rows = [r for r in log.events.select("event_id", "event_type", "ts", json_attrs(F.col("attrs"))).collect()]
    rows += log.objects.select("object_id", "object_type", json_attrs(F.col("attrs"))).collect()
    rows += log.e2o.collect() + log.o2o.collect()
    return sorted(str(tuple(r)) for r in rows)


def _mini(spark):
    objects = [
        ("S1", "Session", {"session_id": "S1"}), ("A1", "Application", {"amount": 3}),
        ("C1", "Applicant", {"jurisdiction": "Süd \"x\""}), ("D1", "CreditDecision", {"reason_codes": ["RC1", "RC2"]}),
        ("P1", "PolicyVersion", {"effective_to": ""}), ("M1", "Model", {"version": "1"}),
    ]
    events = [
        ("e1", "session_start", 0, {"S1": "within", "C1": "concerns", "A1": "declares"}, {"seed": 4}),
        ("e2", "call_llm", 1, {"S1": "within", "M1": "uses"}, {"temperature": 0.5}),
        ("e3", "make_decision", 2, {"S1": "within", "D1": "produces", "P1": "governed_by"}, {"adverse": True, "reason_codes": []}),
    ]
    return make_log(spark, events, objects, [("A1", "C1", "submitted_by"), ("D1", "A1", "derived_from")])


def test_log_findings_look_at_suspect_objects_alone(spark):
    log = _mini(spark)
    assert validate._suspects(log, CREDIT).count() == 0
    edges = [("e1", "A1", "concerns"), ("e2", "NOBODY", "uses"), ("e3", "C1", "submitted_by"), ("gone", "M1", "uses"),
             ("gone", "LOST", "uses"), ("e2", None, "uses"), ("e2", "M1", None), ("e1", "-x", "within")]
    damaged = EventLog(
        log.events.unionByName(log.events.where("event_id = 'e2'").withColumn("event_id", F.lit("e4"))),
        log.objects.unionByName(log.objects.where("object_id = 'P1'").selectExpr("'P2' AS object_id", "'Policy' AS object_type", "attrs")),
        log.e2o.unionByName(spark.createDataFrame(edges, log.e2o.schema)),
        log.o2o,
    )
    got = sorted((r.check_id, r.key, r.detail) for r in validate.log_findings(damaged).collect() if not r.check_id.startswith("attribute"))
    assert got == sorted([
        ("edge_repeated", "e1 A1", ""), ("edge_repeated", "e2 M1", ""), ("event_without_edge", "e4", ""),
        ("edge_object_undeclared", "e2 NOBODY", ""), ("edge_object_undeclared", "gone LOST", ""), ("edge_object_undeclared", "e2", ""),
        ("edge_object_undeclared", "e1 -x", ""), ("edge_object_id_form", "e1 -x", ""),
        ("edge_qualifier_o2o", "e3 C1", "submitted_by"), ("edge_qualifier_illegal", "e3 C1", "make_decision submitted_by Applicant"),
        ("edge_qualifier_illegal", "e2 M1", "call_llm Model"),
        ("object_without_edge", "P2", ""), ("object_type_unknown", "P2", "Policy"),
    ])


def test_session_excerpt_evaluates_its_citations_once(spark):
    log, evaluated = _mini(spark), spark.sparkContext.accumulator(0)

    def tell(session):
        evaluated.add(1)
        return session

    cited = spark.createDataFrame([("S1", "e3"), ("S1", "e3"), ("S1", "e1")], "session_id string, event_id string")
    cited = cited.withColumn("session_id", F.udf(tell, "string")("session_id"))
    got = evidence.session_excerpt(log, cited).select("session_id", "event_id", "key_relations", "cited")
    assert sorted(map(tuple, got.collect())) == [
        ("S1", "e1", "concerns -> C1", True), ("S1", "e2", "uses -> M1", False),
        ("S1", "e3", "produces -> D1; governed_by -> P1", True),
    ]
    assert evaluated.value == 3


def _joined(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_ocel_json_round_trip(spark, tmp_path):
    log = _mini(spark)
    assert_valid(validate.log_findings(log))
    ocel.write_lines(ocel.ocel_json_lines(log), str(tmp_path / "parts"))
    document = json.loads(_joined(tmp_path / "parts"))
    assert {t["name"] for t in document["eventTypes"]} == set(CREDIT.event_attributes)
    (tmp_path / "log.json").write_text(json.dumps(document, ensure_ascii=False))
    again, findings = ocel.read_ocel_json(spark, str(tmp_path / "log.json"))
    assert_valid(findings)
    assert _facts(again) == _facts(log)
    assert evidence.log_digest(again).first() == evidence.log_digest(log).first()


def test_ocel_json_rejections(spark, tmp_path):
    attr = lambda n, v, **t: {"name": n, "value": v, **t}
    document = {
        "events": [{"id": "e", "type": "session_start", "time": "2026-01-01T00:00:00.5Z",
                    "attributes": [attr("seed", True), attr("nope", "x")], "relationships": [{"objectId": "S", "qualifier": "odd"}]}],
        "objects": [{"id": "S", "type": "Session", "attributes": [attr("session_id", "x", time="2026-02-01T00:00:00Z")], "relationships": []}],
    }
    (tmp_path / "log.json").write_text(json.dumps(document))
    _, findings = ocel.read_ocel_json(spark, str(tmp_path / "log.json"))
    assert {r.check_id for r in findings.collect()} == {
        "attribute_undecodable", "attribute_unknown", "timestamp_form", "dynamic_attribute", "qualifier_unknown"
    }


def test_ocel_xml(spark, tmp_path):
    (tmp_path / "log.xml").write_text(
        """<?xml version='1.0' encoding='UTF-8'?><log><object-types/><event-types/>
<objects><object id="A1" type="Application"><attributes><attribute name="amount" time="1970-01-01T00:00:00Z">3</attribute></attributes>
<objects><object object-id="C1" qualifier="submitted_by" type="Applicant"/></objects></object>
<object id="C1" type="Applicant"><attributes><attribute name="jurisdiction" time="1970-01-01T00:00:00Z"></attribute></attributes></object></objects>
<events><event id="e1" type="session_start" time="2026-03-02T09:00:00Z"><attributes><attribute name="seed">4</attribute></attributes>
<objects><relationship object-id="A1" qualifier="concerns"/><object object-id="C1" qualifier="concerns" type="Applicant"/></objects></event></events></log>"""
    )
    log, findings = ocel.read_ocel_xml(spark, str(tmp_path / "log.xml"))
    assert_valid(findings)
    got = {r.object_id: r[1] for r in log.objects.select("object_id", json_attrs(F.col("attrs"))).collect()}
    assert got == {"A1": '{"amount":3}', "C1": '{"jurisdiction":""}'}
    assert {tuple(r) for r in log.e2o.collect()} == {("e1", "A1", "concerns"), ("e1", "C1", "concerns")}
    assert [tuple(r) for r in log.o2o.collect()] == [("A1", "C1", "submitted_by")]


def test_stored_tables_and_pruning(spark, tmp_path):
    log = _mini(spark)
    tables.write_log(log, str(tmp_path / "t"))
    again = tables.read_log(spark, str(tmp_path / "t"))
    assert _facts(again) == _facts(log)
    plan = again.relations_of("call_llm").where("qualifier = 'uses'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "call_llm" in plan


def test_span_index_document(spark, tmp_path):
    events = spark.createDataFrame([("e1", "t", "a", ["x"]), ("e2", "t", "b", [])], "event_id string, trace_id string, span_id string, enrichment_span_ids array<string>")
    sessions = spark.createDataFrame([("S", "t", "r", ["y"])], "session_id string, trace_id string, root_span_id string, session_span_ids array<string>")
    ocel.write_lines(sidecars.span_index_lines(events, sessions), str(tmp_path / "i"))
    text = _joined(tmp_path / "i").replace("\n", "")
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    (tmp_path / "i.json").write_text(text)
    e, s, findings = sidecars.read_span_index(spark, str(tmp_path / "i.json"))
    assert_valid(findings)
    assert evidence.span_index_digest(e, s).first() == evidence.span_index_digest(events, sessions).first()
    broken = json.loads(text)
    broken["events"][1].update(event_id="e1", span_id="")
    broken["sessions"][0]["more"] = 1
    broken["schema_version"] = True
    (tmp_path / "b.json").write_text(json.dumps(broken))
    found = {r.check_id for r in sidecars.read_span_index(spark, str(tmp_path / "b.json"))[2].collect()}
    assert found == {"index_span_id", "index_event_id_repeated", "index_entry_keys", "index_document"}


def test_bundle_hashes_tampering_and_truncation(spark, tmp_path):
    events = [decision(f"d{i}", i, policy="P0") for i in range(5)]
    log = make_log(spark, events, OBJECTS)
    spans_of = spark.createDataFrame(
        [(f"d{i}", "a" * 32, f"{i:016x}", []) for i in range(5)], "event_id string, trace_id string, span_id string, enrichment_span_ids array<string>"
    )
    rules = tuple(r for r in DEFAULT_RULES if r.constraint_id.startswith("STD"))
    records = evidence.render(
        evaluate(log, rules), log, spans_of, rules_frame(spark, rules),
        input_log_sha256="1" * 64, span_index_sha256="2" * 64, crosswalk_sha256="3" * 64,
    )
    assert evidence.record_findings(records).count() == 0
    bundle = evidence.chain(records)
    sidecars.write_bundle(bundle, str(tmp_path / "b"))
    lines = [json.loads(x) for x in _joined(tmp_path / "b").splitlines()]
    previous = "0" * 64
    for i, record in enumerate(lines):
        own = record.pop("integrity")
        text = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert own == {
            "chain_index": i, "prev_record_sha256": previous, "record_sha256": hashlib.sha256(text.encode()).hexdigest()
        }
        previous = own["record_sha256"]
    assert lines[0]["context"] == {"agent_versions": {}, "model_versions": {}, "policy_version": "0"}
    stored = sidecars.read_bundle(spark, str(tmp_path / "b"))
    assert evidence.verify_chain(stored).first().verified
    assert evidence.bundle_differences(stored, bundle).count() == 0
    # a cut-off tail still verifies; a hole, an edit or a forged hash does not
    assert evidence.verify_chain(stored.where("integrity.chain_index < 3")).first().verified
    breaks = lambda b: {tuple(r) for r in evidence.chain_breaks(b).collect()}
    at = F.col("integrity.chain_index") == 2
    assert breaks(stored.where(~at)) == {(3, "gap before")}
    assert breaks(stored.withColumn("severity", F.when(at, F.lit("low")).otherwise(F.col("severity")))) == {(2, "content changed")}
    assert evidence.bundle_differences(stored.where(~at), bundle).count() == 1


def test_bundle_trees_differ_where_records_do(spark, tmp_path):
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], sidecars.RECORD_SCHEMA).schema[2:]]
    rule = F.struct(F.lit("f").alias("formal"), F.lit("T1.x").alias("id"), F.lit("n").alias("natural_language"), F.lit("1").alias("ruleset_version"))
    name = lambda n: F.sha2(n.cast("string"), 256)
    bundle = spark.range(2000).select(name(F.col("id")).alias("violation_id"), rule.alias("constraint"), *fields)
    is_ = lambda *n: F.col("violation_id").isin([hashlib.sha256(str(i).encode()).hexdigest() for i in n])
    edited = bundle.where(~is_(3)).withColumn("severity", F.when(is_(5, 6), F.lit("low")).otherwise(F.col("severity")))
    other = edited.unionByName(bundle.where(is_(7))).unionByName(bundle.where(is_(8)).withColumn("violation_id", F.lit("new")))
    for folder, df in (("a", bundle), ("b", bundle.orderBy(F.desc("violation_id"))), ("c", other), ("none", bundle.limit(0))):
        bundles.write_bundle_tree(df, str(tmp_path / folder))
    diff = lambda x, y: {(r.violation_id, r.change, r.recorded, r.actual) for r in bundles.bundle_difference(spark, str(tmp_path / x), str(tmp_path / y)).collect()}
    assert diff("a", "b") == diff("none", "none") == set()
    assert len(diff("a", "none")) == 2000 and {t[1:] for t in diff("none", "a")} == {("extra", 0, 1)}
    h = lambda n: hashlib.sha256(str(n).encode()).hexdigest()
    want = {(h(3), "missing", 1, 0), (h(5), "changed", 1, 1), (h(6), "changed", 1, 1), (h(7), "extra", 0, 1), ("new", "extra", 0, 1)}
    assert diff("a", "c") == want
    # leaves of other branches are not opened: all but the seven at most that differ are made unreadable
    sides = [spark.read.schema(bundles.LEAF).parquet(str(tmp_path / x / "leaves")) for x in "ac"]
    touched = {r.branch for s, t in (sides, sides[::-1]) for r in s.exceptAll(t).collect()}
    assert 1 <= len(touched) <= 7
    broken = [f for f in (tmp_path / "a" / "leaves").rglob("*.parquet") if f.parent.name.split("=")[1] not in touched]
    for file in broken:
        file.write_bytes(b"x")
    assert len(broken) > 200 and diff("a", "c") == want


def test_labels_and_judge_cache(spark, tmp_path):
    labels = spark.createDataFrame(
        [("v", "V1", "T1.x", "S", ["e"], [], ["s"], [], "high", ["Art. 1"], "text")],
        "violation_id string, fault_class string, constraint_id string, session_id string, ocel_event_ids array<string>, "
        "ocel_object_ids array<string>, expected_evidence_span_ids array<string>, removed_span_ids array<string>, "
        "severity string, articles array<string>, description string",
    )
    decoys = spark.createDataFrame([("d", "D2", "S", [], "t")], "distractor_id string, kind string, session_id string, span_ids array<string>, description string")
    lines = sidecars.label_lines(labels, decoys, split="single", base_run_id="r", injector_seed=1, catalogue_sha256="0", catalogue_version="1")
    ocel.write_lines(lines, str(tmp_path / "l"))
    (tmp_path / "l.json").write_text(_joined(tmp_path / "l"))
    got, distractors = sidecars.read_labels(spark, str(tmp_path / "l.json"))
    assert got.select(*labels.columns).collect() == labels.collect() and distractors.count() == 1
    (tmp_path / "cache").mkdir()
    for key in ("k1", "k2"):
        record = {"fingerprint": {"model_id": "m", "sample_index": 0, "condition": "c", "session_id": "S", "access_date": "d", "model_version": "1"},
                  "latency_ms": 5, "response": {"raw_text": "x", "schema_failure": False}, "usage": {"input_tokens": 7, "output_tokens": 8}}
        (tmp_path / "cache" / f"{key}.json").write_text(json.dumps(record, indent=2))
    keys = spark.createDataFrame([("k2",)], "cache_key string")
    rows = sidecars.judge_costs(spark, str(tmp_path / "cache"), keys).collect()
    assert [(r.cache_key, r.input_tokens, r.latency_ms) for r in rows] == [("k2", 7, 5)]
    # every file without keys; with keys the others are not opened, such as one that cannot be
    assert {r.cache_key for r in sidecars.judge_costs(spark, str(tmp_path / "cache")).collect()} == {"k1", "k2"}
    sidecars.write_judge_cache(spark.createDataFrame([("k3", "no json"), ("../k4", "{}"), ("k5", None)], "cache_key string, value string"), str(tmp_path / "cache"))
    assert not (tmp_path / "k4.json").exists() and not (tmp_path / "cache" / "k5.json").exists()
    (tmp_path / "cache" / "k6.json").mkdir()
    keys = spark.createDataFrame([("k1",), ("k1",), ("k3",), ("k7",), ("../k1",), (None,)], "cache_key string")
    rows = sidecars.judge_costs(spark, str(tmp_path / "cache"), keys).collect()
    assert {(r.cache_key, r.output_tokens, r.raw_text) for r in rows} == {("k1", 8, "x"), ("k3", None, None)} and len(rows) == 2


def test_mapping_finds_what_is_wrong(spark):
    scope = {"at.contract": "at-span/1", "at.scenario.name": "s", "at.scenario.version": "1", "at.run.id": "r", "at.run.seed": 1,
             "at.session.id": "S", "at.session.workflow": "w", "at.application.id": "A", "at.applicant.id": "C"}
    event = {**scope, "at.event.type": "handoff", "at.event.id": "e", "at.event.seq": 2, "at.event.time": "2026-01-01T00:00:00", "at.obj.count": 1,
             "at.o2o.count": 0, "at.obj.0.type": "Agent", "at.obj.0.id": "G", "at.obj.0.qualifier": "delegates_to", "at.session.id": "T"}
    rows = [_span(1, None, {**scope, "at.span.role": "event"}), _span(2, f"{1:016x}", event)]
    lines = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], "source_file string, line_no long, line string")
    run = mapping.map_spans(spans.parse_spans(lines)[0])
    found = {r.check_id for r in run.findings.collect()}
    assert found == {
        "root_role", "scope_differs_from_root", "time_not_zoned_iso", "actor_policy", "required_attributes",
        "object_qualifier", "sequence_not_dense", "object_undeclared",
    }
