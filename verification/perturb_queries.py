"""Session views, hash-ranked allocation and the fault-injection loop over fleet sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.operators import evaluation, mining, perturb, sampling
from ocelens.operators.constraints import evaluate
from ocelens.operators.perturb import FAULTS
from verification.fleet_log import fleet_log
from ocelens.plans.inject import inject
from verification.order_log import order_log
from verification.order_spans import order_spans
from ocelens.session import configure, materialise
from ocelens.vocabulary import OBJECT_ATTRIBUTES

SEED = 7


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    return run


def split_sizes(total: int) -> dict[str, int]:
    """One part clean, four parts single (divisible by the classes), one part mixed."""
    single = len(FAULTS) * ((4 * total // 6) // len(FAULTS))
    clean = (total - single) // 2
    return {"clean": clean, "single": single, "mixed": total - single - clean}


@_query
def session_views(spark, sf_dir):
    views = perturb.session_views(fleet_log(spark, sf_dir))
    return views.select(
        "session_id",
        "decisions",
        "decision_event",
        "decision_id",
        "outcome",
        "has_grant_approval",
        "approver_id",
        "verdict_event",
    )


@_query
def session_retrievals(spark, sf_dir):
    return perturb.retrievals(fleet_log(spark, sf_dir)).select("session_id", "source", "event_id")


@_query
def split_partition(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = orders.select(F.concat(F.lit("SES-"), "o_orderkey").alias("session_id"))
    return sampling.partition(ids, "session_id", SEED, split_sizes(ids.count()))


@_query
def quota_allocation(spark, sf_dir):
    """Three classes sharing all orders: denials, approvals and any order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sessions = orders.select(F.concat(F.lit("SES-"), "o_orderkey").alias("session_id"), "o_orderstatus")
    classes = {
        "A": F.col("o_orderstatus") == "O",
        "B": F.col("o_orderstatus") != "P",
        "C": F.lit(True),
    }
    return sampling.allocate_quota(sessions, classes, SEED, sessions.count() // 5)


@_query
def compatible_allocation(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sessions = orders.select(F.concat(F.lit("SES-"), "o_orderkey").alias("session_id"), "o_orderstatus")
    classes = {"A": F.col("o_orderstatus") == "O", "B": F.lit(True), "C": F.lit(True)}
    return sampling.allocate_compatible(
        sessions, classes, {"A": ["C"], "B": ["C"], "C": ["A", "B"]}, SEED
    )


@_query
def reproducible_draw(spark, sf_dir):
    """Two and a half times as many draws as there are customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    count = rows.count() * 5 // 2
    return sampling.reproducible_draw(rows, "c_custkey", SEED, count)


@_query
def dense_sequence(spark, sf_dir):
    """Event numbers per order session after all handoffs were removed."""
    log = order_log(spark, sf_dir).stored()
    gone = log.events_of("handoff").select("event_id")
    kept = perturb.apply_patches(log, [perturb.Patch(removed_events=gone)])
    return perturb.dense_sequence(kept)


@_query
def recounted_sessions(spark, sf_dir):
    counts = perturb.recount_sessions(order_log(spark, sf_dir))
    return counts.select("event_id", F.col("value.text").alias("event_count"))


@_query
def replicated_log(spark, sf_dir):
    copies = perturb.replicate(order_log(spark, sf_dir), 3)
    return mining.sessions_per_type(copies, sorted(OBJECT_ATTRIBUTES))


def _detection(spark, sf_dir, split: str) -> DataFrame:
    """Inject into all sessions, evaluate, score: every fault found, nothing else."""
    log = fleet_log(spark, sf_dir)
    total = log.objects_of("Session").count()
    sizes = {"clean": 0, "single": 0, "mixed": 0, split: total}
    if split == "single":
        # the quota needs a multiple of the class count; the few left over stay clean
        sizes["single"] = total - total % len(FAULTS)
        sizes["clean"] = total - sizes["single"]
    splits = inject(
        log, order_spans(log)[0], sizes, seed=SEED, base_run_id="fleet", catalogue_sha256="0" * 64
    )
    found = materialise(evaluate(splits[split].log))
    return evaluation.confusion(found, splits[split].labels, by=["constraint_id"])


@_query
def single_fault_detection(spark, sf_dir):
    return _detection(spark, sf_dir, "single")


@_query
def mixed_fault_detection(spark, sf_dir):
    """How many faults the mixed sessions hold follows from hashes; only errors are listed."""
    return _detection(spark, sf_dir, "mixed").select("constraint_id", (F.col("tp") > 0).alias("found"), "fp", "fn")


QUERIES = {
    "session_views": session_views,
    "session_retrievals": session_retrievals,
    "split_partition": split_partition,
    "quota_allocation": quota_allocation,
    "compatible_allocation": compatible_allocation,
    "reproducible_draw": reproducible_draw,
    "dense_sequence": dense_sequence,
    "recounted_sessions": recounted_sessions,
    "replicated_log": replicated_log,
    "single_fault_detection": single_fault_detection,
    "mixed_fault_detection": mixed_fault_detection,
}

_SIZES = """
WITH n AS (SELECT count(*) AS total, 8 * (((4 * count(*)) // 6) // 8) AS single FROM orders),
z AS (SELECT *, (total - single) // 2 AS clean FROM n)"""
_QUOTA = """
WITH s AS (SELECT 'SES-' || o_orderkey AS session_id, o_orderstatus AS st FROM orders),
q AS (SELECT count(*) // 5 AS quota FROM s),
a AS (SELECT session_id FROM s WHERE st = 'O' ORDER BY sha256('7:A:' || session_id) LIMIT (SELECT quota FROM q)),
b AS (SELECT session_id FROM s WHERE st <> 'P' AND session_id NOT IN (SELECT session_id FROM a)
      ORDER BY sha256('7:B:' || session_id) LIMIT (SELECT quota FROM q)),
c AS (SELECT session_id FROM s WHERE session_id NOT IN (SELECT session_id FROM a) AND session_id NOT IN (SELECT session_id FROM b)
      ORDER BY sha256('7:C:' || session_id) LIMIT (SELECT quota FROM q))
SELECT session_id, 'A' AS fault_class FROM a UNION ALL SELECT session_id, 'B' FROM b UNION ALL SELECT session_id, 'C' FROM c"""

ORACLES = {
    "session_views": """
SELECT 'SES-' || o_orderkey AS session_id, 1 AS decisions, 'EV-' || o_orderkey || '-20-make_decision' AS decision_event,
  'DEC-' || o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'grant' WHEN 'O' THEN 'deny' ELSE 'refer' END AS outcome,
  o_orderstatus <> 'P' AS has_grant_approval, 'APR-00' || (1 + o_orderkey % 2) AS approver_id,
  'EV-' || o_orderkey || (CASE WHEN o_orderstatus = 'P' THEN '-19-deny_approval' ELSE '-18-grant_approval' END) AS verdict_event
FROM orders""",
    "session_retrievals": """
SELECT 'SES-' || o_orderkey AS session_id, s.source, 'EV-' || o_orderkey || '-' || s.step || '-retrieve_data' AS event_id
FROM orders, (VALUES ('credit_bureau', '06'), ('income_verification', '08'), ('internal_credit_history', '10'),
  ('applicant_demographics', '12')) s(source, step)""",
    "split_partition": _SIZES + """
SELECT session_id, CASE WHEN r <= clean THEN 'clean' WHEN r <= clean + single THEN 'single' ELSE 'mixed' END AS split
FROM (SELECT 'SES-' || o_orderkey AS session_id,
        row_number() OVER (ORDER BY sha256('7:split:SES-' || o_orderkey)) AS r FROM orders), z""",
    "quota_allocation": _QUOTA,
    "compatible_allocation": """
WITH s AS (SELECT 'SES-' || o_orderkey AS sid, o_orderstatus AS st FROM orders),
k AS (SELECT sid, st, CAST('0x' || substr(sha256('7:k:' || sid), 1, 8) AS BIGINT) / 4294967295.0 AS f,
        sha256('7:mix:' || sid || ':A') AS a, sha256('7:mix:' || sid || ':B') AS b, sha256('7:mix:' || sid || ':C') AS c FROM s),
w AS (SELECT *, (f >= 0.15)::INT + (f >= 0.5)::INT + (f >= 0.85)::INT AS want FROM k),
-- A and B exclude each other: the better ranked one that is eligible competes with C
p AS (SELECT *, CASE WHEN st = 'O' AND a < b THEN 'A' ELSE 'B' END AS ab,
        CASE WHEN st = 'O' AND a < b THEN a ELSE b END AS abr FROM w)
SELECT sid AS session_id, ab AS fault_class FROM p WHERE want >= 2 OR (want = 1 AND abr < c)
UNION ALL SELECT sid, 'C' FROM p WHERE want >= 2 OR (want = 1 AND c < abr)""",
    "reproducible_draw": """
SELECT c_custkey, d AS draw_index, 'APN-' || substr(sha256('7:' || d || ':' || c_custkey), 1, 10) AS pseudonym
FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256('7:' || c_custkey), c_custkey) - 1 AS r,
        (SELECT count(*) FROM customer) AS n FROM customer) x,
     generate_series(0, (SELECT count(*) * 5 // 2 FROM customer) - 1) g(d)
WHERE d % n = r""",
    "single_fault_detection": """
SELECT c AS constraint_id, m * (SELECT count(*) // 8 FROM orders) AS tp, 0 AS fp, 0 AS fn
FROM (VALUES ('T1.synchronised_approval', 3), ('T2.mandatory_data_coverage', 1), ('T3.delegation_integrity', 1),
  ('T4.reason_code_presence', 1), ('T5.prohibited_attribute_access', 1), ('STD.policy_version_current', 1)) v(c, m)""",
    "mixed_fault_detection": """
SELECT c AS constraint_id, true AS found, 0 AS fp, 0 AS fn
FROM (VALUES ('T1.synchronised_approval'), ('T2.mandatory_data_coverage'), ('T3.delegation_integrity'),
  ('T4.reason_code_presence'), ('T5.prohibited_attribute_access'), ('STD.policy_version_current')) v(c)""",
}


def _orders_sql() -> dict[str, str]:
    from verification.order_sql import with_orders

    return {
        "dense_sequence": with_orders("""
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS seq
FROM ev WHERE event_type <> 'handoff'"""),
        "recounted_sessions": with_orders("""
SELECT 'EV-' || k || '-242-session_end' AS event_id, CAST(count(*) AS VARCHAR) AS event_count FROM ev GROUP BY k"""),
        "replicated_log": with_orders("""
SELECT event_type, object_type, 3 * count(*) AS edges, 3 * count(DISTINCT session_id) AS sessions FROM rel GROUP BY 1, 2"""),
    }


ORACLES.update(_orders_sql())
