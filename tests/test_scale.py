"""What the shared steps shuffle and write, as far as a plan or a count of writes shows it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ocelens import session
from ocelens.functions import canonical, ordering
from ocelens.model import EventLog
from ocelens.operators import bundles, claims, evidence, mining, perturb
from ocelens.session import materialise
from verification import order_log


def _writes(monkeypatch, module) -> list:
    writes = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, *codec: writes.append(df.columns) or real(df, *codec))
    return writes


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line]


def test_small_groups_are_met_without_a_write(spark, monkeypatch):
    writes = _writes(monkeypatch, ordering)
    df = spark.range(900).selectExpr("CAST(id % 300 AS STRING) AS g", "id AS t")
    placed = ordering.with_neighbours(df, ["g"], ["t"], previous="p", following="n", carry=["t"]).collect()
    assert all((r.p and r.p.t) == (r.t - 300 if r.t >= 300 else None) for r in placed)
    assert all((r.n and r.n.t) == (r.t + 300 if r.t < 600 else None) for r in placed)
    ranked = ordering.with_rank_in_group(df, ["g"], ["t"]).collect()
    assert all(r.position == r.t // 300 for r in ranked) and len(ranked) == 900
    assert writes == []


def test_a_digest_shuffles_each_hash_once(spark):
    rows = [(hashlib.sha256(str(i % 400).encode()).hexdigest(),) for i in range(1000)]
    digest = canonical.content_digest(spark.createDataFrame(rows, "row_sha256 string"))
    # the leaves, and the two levels of nodes above them
    assert len(_exchanges(digest)) == 3
    hashes = {}
    for (h,) in rows:
        hashes[h] = hashes.get(h, 0) + 1
    level = {h: hashlib.sha256(f"{h}:{n}".encode()).hexdigest() for h, n in hashes.items()}
    for length in canonical.HASH_PREFIXES:
        nodes = {}
        for prefix, d in level.items():
            nodes.setdefault(prefix[:length], []).append(d)
        level = {p: hashlib.sha256("".join(sorted(ds)).encode()).hexdigest() for p, ds in nodes.items()}
    assert digest.first()["digest"] == level[""]


def test_graph_edges_shuffle_no_ids(spark):
    rows = [("O", "o1", "a", "b", "1", "2"), ("O", "o2", "a", "b", "1", "2"), ("O", "o3", "a", "b", "1", "3")]
    follows = spark.createDataFrame(rows, "object_type string, object_id string, activity_a string, activity_b string, first_id string, second_id string")
    edges = mining.dfg_edges(follows)
    assert not any("first_id" in line for line in _exchanges(edges))
    assert [tuple(r) for r in edges.collect()] == [("O", "a", "b", 2, 3)]


def test_a_chain_places_no_shared_text(spark, monkeypatch):
    writes = _writes(monkeypatch, ordering)
    rows = spark.range(40).select(
        F.concat(F.lit("v"), "id").alias("violation_id"),
        F.struct(F.concat(F.lit("T"), F.col("id") % 2).alias("id"), F.lit("a long text").alias("formal")).alias("constraint"),
        F.array(F.lit("law")).alias("legal_basis"),
        F.struct(F.array(F.lpad(F.col("id").cast("string"), 3, "0")).alias("ocel_event_ids"), F.array(F.lit("o")).alias("ocel_object_ids")).alias("evidence"),
        F.sha2(F.col("id").cast("string"), 256).alias("record_sha256"),
    )
    records = rows.union(rows.where("violation_id = 'v7'"))
    chained = evidence.chain(records)
    assert writes and all("legal_basis" not in w and "constraint" not in w for w in writes)
    got = sorted(chained.collect(), key=lambda r: r.integrity.chain_index)
    expected = sorted(records.collect(), key=lambda r: (r.constraint.id, r.evidence.ocel_event_ids, r.record_sha256))
    assert [r.violation_id for r in got] == [r.violation_id for r in expected]
    assert [r.integrity.chain_index for r in got] == list(range(41))
    before = [evidence.GENESIS] + [r.record_sha256 for r in expected[:-1]]
    assert [r.integrity.prev_record_sha256 for r in got] == before
    assert all(r.constraint.formal == "a long text" and r.legal_basis == ["law"] for r in got)


def test_replicas_meet_a_session_once_per_event_type(spark):
    rows = [(f"e{i}", f"t{i % 2}", f"s{i % 3}" if i % 5 else None, f"o{j}", kind) for i in range(30) for j, kind in enumerate("AAB"[: 1 + i % 3])]
    relations = spark.createDataFrame(rows, "event_id string, event_type string, session_id string, object_id string, object_type string")
    none = spark.createDataFrame([], "source_id string, target_id string")
    copies = perturb.replicate(EventLog(relations, relations, None, none, relations), 3)
    counts = mining.sessions_per_type(copies, ["A", "B", "C"])
    assert not any("object_type" in line for line in _exchanges(counts))
    want = {}
    for _, event, session, _, kind in rows:
        edges, sessions = want.setdefault((event, kind), ([], set()))
        edges.append(1)
        sessions.update({session} - {None})
    assert {(r.event_type, r.object_type): (r.edges, r.sessions) for r in counts.collect()} == {k: (3 * len(e), 3 * len(s)) for k, (e, s) in want.items()}
    assert {r.event_id[-2:] for r in copies.relations.collect()} == {"~0", "~1", "~2"}
    with pytest.raises(Exception, match="not named"):
        mining.sessions_per_type(copies, ["A"]).collect()


def test_votes_parse_each_response_once(spark):
    texts = ["broken", '{"violations":[]}', '{"violations":[{"constraint_id":"X ","event_ids":["b","a"]},{"constraint_id":"x","event_ids":["a","b"]}]}']
    rows = [("s", "m", "c", i, texts[i % 3]) for i in range(9)]
    runs = claims.parse_reports(spark.createDataFrame(rows, "session_id string, model_id string, condition string, sample_index int, raw_text string"))
    votes = claims.majority_vote(runs, k=3)
    plan = votes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert len(_exchanges(votes)) == 1
    assert [(v.label, v.support, v.constraint_id, list(v.ocel_event_ids)) for v in votes.collect()] == [("x", 3, "X ", ["b", "a"])]


def test_index_and_log_meet_in_one_grouping(spark):
    rows = [("a",), ("b",), ("b",), (None,), ("c",)]
    events = spark.createDataFrame(rows, "event_id string").selectExpr("event_id", "'t' AS event_type", "current_timestamp() AS ts", "map() AS attrs")
    sessions = spark.createDataFrame([("s1", "Session"), ("s2", "Session")], "object_id string, object_type string")
    none = spark.createDataFrame([], "source_id string, target_id string")
    log = EventLog(events, sessions, None, none, events)
    spans = spark.createDataFrame([("c",), ("d",), (None,), ("c",)], "event_id string")
    found = evidence.index_mismatches(log, spans, spark.createDataFrame([("s2",), ("s3",)], "session_id string"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.key or "", r.detail) for r in found.collect())
    lost, more = "event missing from the index", "event not in the log"
    ends = [("s1", "session missing from the index"), ("s3", "session not in the log")]
    assert got == sorted([("a", lost), ("b", lost), ("b", lost), ("", lost), ("", more), ("d", more), *ends])


def _many_tasks(spark, monkeypatch) -> EventLog:
    monkeypatch.setattr(ordering, "_ROWS_IN_TASK", 10)
    rows = []
    for i in range(90):
        kind, session = ("session_end" if i % 9 == 0 else "t"), f"s{i // 9}"
        edges = [(session, "Session", "within"), ("A", "Agent", "from"), ("B", "Agent", "to")]
        rows += [(f"e{i}", kind, session, *e) for e in edges[: 1 + i % 3] + edges[: i % 2]]
    relations = spark.createDataFrame(rows, "event_id string, event_type string, session_id string, object_id string, object_type string, qualifier string")
    return EventLog(relations.select("event_id", "event_type").distinct(), relations, None, relations, relations)


def test_recounting_takes_more_tasks_for_more_rows(spark, monkeypatch):
    counts = perturb.recount_sessions(_many_tasks(spark, monkeypatch))
    assert any("event_id" in line and ", 10), REPARTITION_BY_NUM" in line for line in _exchanges(counts))
    assert {r.event_id: r.value.text for r in counts.collect()} == {f"e{i}": "9" for i in range(0, 90, 9)}


def test_notions_share_one_grouping(spark, monkeypatch):
    log = _many_tasks(spark, monkeypatch)
    stats = mining.notion_statistics(log, "Session", "Agent")
    assert sum("hashpartitioning(event_id" in line and "REPARTITION_BY_NUM" in line for line in _exchanges(stats)) == 1
    edges = [(r.event_id, r.object_type) for r in log.relations.collect()]
    want = set()
    for notion in ("Session", "Agent"):
        ids = [e for e, t in edges if t == notion]
        want.add((notion, 90, len(set(ids)), 90 - len(set(ids)), len(ids) - len(set(ids))))
    assert {tuple(r) for r in stats.collect()} == want


def test_lifecycles_meet_a_session_and_its_lines_in_one_pass(spark, monkeypatch, tmp_path):
    day = "CAST(DATE '2024-01-01' + CAST(id % 40 AS INT) AS TIMESTAMP_NTZ)"
    orders = spark.range(60).selectExpr(
        # gaps, a repeated key and a null one
        "IF(id = 59, NULL, IF(id = 58, 4, id + id DIV 7)) AS o_orderkey", "id % 9 AS o_custkey", "'F' AS o_orderstatus",
        "1.0D AS o_totalprice", f"IF(id = 3, NULL, {day}) AS o_orderdate", "concat(id % 5 + 1, '-X') AS o_orderpriority",
    )
    lines = spark.range(400).selectExpr(
        # lines without an order or a number, parts and suppliers that are null, orders without lines
        "IF(id % 50 = 7, NULL, id % 64) AS l_orderkey", "IF(id % 31 = 0, NULL, id * 7 % 110) AS l_partkey",
        "IF(id % 37 = 0, NULL, id * 5 % 23) AS l_suppkey", "IF(id % 41 = 0, NULL, CAST(id % 5 + 1 AS INT)) AS l_linenumber",
    ).where("l_orderkey % 6 <> 2 OR l_orderkey IS NULL")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(ordering, "_ROWS_IN_TASK", 10)
    writes = _writes(monkeypatch, order_log)
    for period in ("true", "t0 < TIMESTAMP_NTZ '2024-01-20 00:00:00'"):
        log = order_log.order_log(spark, str(tmp_path), period)
        found = mining.object_lifecycles(log)
        got = {tuple(r) for r in found.collect()}
        assert writes == []
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and "REPARTITION_BY_NUM" in plan
        edges = log.relations.groupBy("object_type", "object_id").agg(F.min("ts"), F.max("ts"), F.count("*"))
        assert got == {tuple(r) for r in edges.collect()} and len(got) > 100
        writes.clear()
    plain = EventLog(log.events, log.events, None, log.events, log.relations)
    assert {tuple(r) for r in mining.object_lifecycles(plain).collect()} == got


def test_patches_leave_the_relations_of_other_events_alone(spark, monkeypatch):
    def log(with_relations: bool) -> EventLog:
        kinds = [(f"e{i}", "handoff" if i % 3 else "session_start", i) for i in range(9)]
        events = spark.createDataFrame(kinds, "event_id string, event_type string, n int").selectExpr(
            "event_id", "event_type", "timestamp_seconds(n) AS ts", "CAST(map() AS map<string, struct<kind: string, text: string>>) AS attrs"
        )
        objects = spark.createDataFrame(
            [(f"s{i}", "Session") for i in range(3)] + [(f"a{i}", "Agent") for i in range(4)], "object_id string, object_type string"
        ).selectExpr("*", "CAST(map() AS map<string, struct<kind: string, text: string>>) AS attrs")
        edges = [(f"e{i}", f"s{i // 3}", "within") for i in range(9)] + [(f"e{i}", f"a{i % 2}", "to") for i in range(9)]
        e2o = spark.createDataFrame([*edges, ("e4", "a1", "from"), ("e4", "a1", "from")], perturb.EDGE)
        o2o = spark.createDataFrame([("a0", "a1", "delegates_to"), ("a2", "a1", "delegates_to")], "source_id string, target_id string, qualifier string")
        derived = EventLog(events, objects, e2o, o2o)
        return EventLog(events, objects, None, o2o, derived.relations) if with_relations else derived

    gone = perturb.Patch(removed_events=spark.createDataFrame([("e1",), ("e1",)], "event_id string"))
    moved = perturb.Patch(
        removed_edges=spark.createDataFrame([("e4", "a0"), ("e5", "s1")], "event_id string, object_id string"),
        added_edges=spark.createDataFrame([("e4", "a3", "to"), ("e5", "s2", "within"), ("e1", "a3", "to"), ("e8", "new", "to")], perturb.EDGE),
        added_objects=spark.createDataFrame([("new", "Agent")], "object_id string, object_type string").selectExpr("*", "CAST(map() AS map<string, struct<kind: string, text: string>>) AS attrs"),
    )
    for stored in (False, True):
        mine, plain = (perturb.apply_patches(log(own), [gone, moved], stored=stored) for own in (True, False))
        for table in ("relations", "objects", "o2o", "events"):
            columns = sorted(getattr(plain, table).columns)
            got, wanted = (sorted(str(r) for r in getattr(x, table).select(*columns).collect()) for x in (mine, plain))
            assert got == wanted, table
    # where events go and nothing else changes, neither objects nor sessions are met again
    only_gone = perturb.apply_patches(log(True).stored(), [gone]).relations
    plan = only_gone._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counted = spark.range(1000).selectExpr("id % 10 AS g").groupBy("g").count()
    copy = materialise(counted)
    assert _shuffle_files(spark) <= before
    # the same rows can still be asked for again
    assert sorted(counted.collect()) == sorted(counted.collect()) == sorted(copy.collect())


def test_a_digest_is_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(500)], "row_sha256 string")
    few = canonical.content_digest(rows)
    monkeypatch.setattr(ordering, "_ROWS_IN_TASK", 50)
    many = canonical.content_digest(rows, rows=500)
    assert any("hashpartitioning" in line and ", 11)" in line for line in _exchanges(many))
    assert many.first() == few.first()


def test_json_strings_are_escaped_as_the_json_writer_does(spark):
    texts = ["", "plain", 'a"b', "back\\slash", "tab\tnew\nline", "nul\x00", "\x1f\x7f", "ümläut", "𝄞/'", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", canonical.json_string(F.col("t")).alias("mine"), F.to_json(F.array("t")).alias("listed")).collect():
        assert row.mine == (None if row.t is None else row.listed[1:-1])


def test_a_chain_writes_its_rows_once_before_and_once_after_they_are_placed(spark, monkeypatch):
    placed, kept = _writes(monkeypatch, ordering), _writes(monkeypatch, evidence)
    rows = spark.range(30).select(
        F.struct(F.concat(F.lit("T"), F.col("id") % 2).alias("id")).alias("constraint"),
        F.struct(F.array(F.lpad(F.col("id").cast("string"), 3, "0")).alias("ocel_event_ids"), F.array(F.lit("o")).alias("ocel_object_ids")).alias("evidence"),
        F.sha2(F.col("id").cast("string"), 256).alias("record_sha256"),
    )
    got = evidence.chain(rows).select("integrity.*").orderBy("chain_index").collect()
    assert [r.prev_record_sha256 for r in got] == [evidence.GENESIS, *(r.record_sha256 for r in got[:-1])]
    # the records and their shared texts, then the placed rows
    assert len(kept) == 2 and len(placed) == 1


def test_spans_are_met_without_gathering_single_citations(spark):
    def violation(constraint, *events):
        return (constraint, list(events), ["o"], "s", "low")

    rows = [violation("A", "e1"), violation("A", "e1"), violation("B", "e2"), violation("C", "none"), violation("D", "e3", "e1"), violation("D", "e3", "e1")]
    rows += [violation("E", "e1", "e2"), violation("F", "e1", "none"), violation("G", "e1", "e4"), violation("H")]
    violations = spark.createDataFrame(rows, "constraint_id string, ocel_event_ids array<string>, ocel_object_ids array<string>, session_id string, severity string")
    spans = [("e1", "t", "s1"), ("e2", "t", "s2"), ("e2", "t", "s2b"), ("e3", "t", "s3"), ("e4", "u", "s4")]
    found = evidence._with_spans(violations, spark.createDataFrame(spans, "event_id string, trace_id string, span_id string"))
    got = sorted((r.constraint_id, r.trace_id, r.span_ids) for r in found.collect())
    # e2 has two spans, e4 another trace
    assert got == [("A", "t", ["s1"])] * 2 + [("D", "t", ["s3", "s1"])] * 2
    assert found.columns == ["constraint_id", "ocel_event_ids", "ocel_object_ids", "session_id", "severity", "trace_id", "span_ids"]


def test_a_bundle_tree_is_written_in_its_place(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bundles, "record_json", lambda: F.col("violation_id"))
    writes = _writes(monkeypatch, bundles)
    rows = spark.range(300).select(F.concat(F.lit("v"), F.col("id") % 290).alias("violation_id"), F.struct(F.lit("T").alias("id")).alias("constraint"))
    for name, df in (("a", rows), ("b", rows.where("violation_id <> 'v5'"))):
        bundles.write_bundle_tree(df, str(tmp_path / name))
    assert writes == []
    got = bundles.bundle_difference(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert [tuple(r) for r in got] == [("v5", "T", "missing", 2, 0)]


def _log_of(spark, edges) -> EventLog:
    """A log with relations from (event_id, session_id, object_id, object_type, qualifier)."""
    none = "CAST(map() AS map<string, struct<kind: string, text: string>>) AS attrs"
    relations = spark.createDataFrame(edges, "event_id string, session_id string, object_id string, object_type string, qualifier string").selectExpr(
        "event_id", "'call_llm' AS event_type", "timestamp_seconds(0) AS ts", "session_id", "object_id", "object_type", "qualifier"
    )
    events = relations.selectExpr("event_id", "event_type", "ts", none).dropDuplicates(["event_id"])
    objects = relations.selectExpr("object_id", "object_type", none).dropDuplicates(["object_id"])
    return EventLog(events, objects, None, spark.createDataFrame([], "source_id string, target_id string, qualifier string"), relations)


_PLAIN = [("e1", "s1", "s1", "Session", "within"), ("e1", "s1", "a", "Agent", "to"), ("e1", "s1", "a", "Agent", "from"), ("e2", "s2", "s2", "Session", "within"), ("e2", "s2", "a", "Agent", "to"), ("e2", "s2", "b", "Agent", "to"), ("e2", "s2", "b", "Agent", "to")]
_ODD = [("e3", "s1", "s1", "Session", "within"), ("e3", "s1", "s2", "Session", "concerns"), ("e3", "s1", "b", "Agent", "to"), ("e4", None, "s2", "Session", "concerns"), ("e4", None, "c", "Agent", "to"), ("e5", None, "c", "Agent", "to")]


@pytest.mark.parametrize("edges", [_PLAIN, _PLAIN + _ODD])
def test_foreign_objects_without_members_are_those_of_the_session_members(spark, edges):
    log = _log_of(spark, edges)
    got = sorted(tuple(r) for r in evidence.foreign_objects(log).collect())
    assert got == sorted(tuple(r) for r in evidence.foreign_objects(log, evidence.session_members(log)).collect())
    lines = evidence.session_payload_lines(log)
    told = sorted((r.session_id, r.sort_id) for r in lines.where("section = 'event'").collect())
    assert told == sorted((r.session_id, r.event_id) for r in evidence.session_members(log).collect())
    assert sorted((r.session_id, r.sort_id) for r in lines.where("section = 'object'").collect()) == [g[:2] for g in got]


def test_edges_of_plain_events_are_dealt_once_for_foreign_objects(spark):
    found = evidence.foreign_objects(_log_of(spark, _PLAIN))
    # no edge is met with members: what is dealt by event is gone
    assert not any("hashpartitioning(event_id" in line for line in _exchanges(found))


def test_a_large_log_starts_with_more_shuffle_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        session.size_shuffles(spark, 2_000_000)
        assert spark.conf.get(name, None) is None
        session.size_shuffles(spark, 9_500_000)
        assert spark.conf.get(name) == "10"
        session.size_shuffles(spark, 5_000_000)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.unset(name)
