"""The fault loop on a small base run, and registered queries against their SQL."""

import os

import duckdb
import pytest

from ocelens.operators import evaluation, evidence, validate
from ocelens.operators.constraints import evaluate
from ocelens.operators.findings import assert_valid
from verification import evidence_queries
from verification.fleet_log import fleet_log
from ocelens.plans.inject import inject
from verification.order_log import order_log, order_rules
from verification.order_spans import order_spans
from verification.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = ("reason_code_presence", "synchronised_precedence", "user_variants", "normalised_attributes", "split_partition", "majority_vote")


def test_every_injected_fault_is_found_and_nothing_else(spark, tmp_path):
    rows = [(k, k % 5, 1000.0 + k, f"2026-01-{1 + k % 28:02d} 00:00:00", "FOFOPFOO"[k % 8]) for k in range(16)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, d string, o_orderstatus string")
    orders.selectExpr("*", "to_timestamp(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    log = fleet_log(spark, str(tmp_path)).stored()
    assert_valid(validate.log_findings(log))
    splits = inject(
        log, order_spans(log)[0], {"clean": 4, "single": 8, "mixed": 4}, seed=7, base_run_id="r", catalogue_sha256="0" * 64, distractor_count=2
    )
    for name, split in splits.items():
        counts = evaluation.confusion(evaluate(split.log), split.labels).first()
        assert (counts.fp, counts.fn) == (0, 0), name
        assert counts.tp == split.labels.count()
        assert_valid(validate.log_findings(split.log))
    assert splits["single"].labels.select("fault_class").distinct().count() == 8
    assert splits["clean"].labels.count() == 0
    assert splits["single"].labels.where("length(violation_id) <> 16").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL_QUERIES") else CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(str(r) for r in cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_chain_verification_holds_every_rule(spark, monkeypatch):
    verify, seen = evidence.verify_chain, []
    monkeypatch.setattr(evidence, "verify_chain", lambda bundle: seen.append(bundle) or verify(bundle))
    assert QUERIES["chain_verification"](spark, SF).first()["verified"]
    got = {r[0] for r in seen[0].select("constraint.id").distinct().collect()}
    want = {r[0] for r in evaluate(order_log(spark, SF), order_rules()).select("constraint_id").distinct().collect()}
    assert got == want and len(want) == len(order_rules())


def test_reproduction_check_computes_the_pins_again(spark, monkeypatch):
    values = [{"input_log_sha256": "1" * 64}, {"input_log_sha256": "2" * 64}]
    monkeypatch.setattr(evidence_queries, "input_pins", lambda *_: values.pop(0))
    got = {r.pin: r.holds for r in QUERIES["reproduction_check"](spark, SF).collect()}
    assert got == {"input_log_sha256": False, "crosswalk_sha256": False}
