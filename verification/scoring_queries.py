"""Evaluation, judge-claim aggregation over detections derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_rank_in_group
from ocelens.operators import claims, evaluation
from ocelens.operators.constraints import TEMPLATES
from verification.order_log import order_log, order_rules
from ocelens.session import configure, materialise
from verification.order_sql import all_violations

SYNONYMS = {
    "missing reason codes": "T4.reason_code_presence",
    "special category access": "T5.prohibited_attribute_access",
    "stale policy": "STD.policy_version_current",
}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    return run


def _truth(spark, sf_dir) -> DataFrame:
    log, out = order_log(spark, sf_dir), None
    for rule in order_rules():
        rows = TEMPLATES[rule.template](log, rule)
        out = rows if out is None else out.unionByName(rows)
    rows = out.select(
        F.concat_ws("|", "constraint_id", F.array_join("ocel_event_ids", ",")).alias("violation_id"),
        "constraint_id",
        "ocel_event_ids",
        "session_id",
        F.substring("session_id", 5, 20).cast("bigint").alias("k"),
    )
    # truth, hits and false alarms all read these rows, so all rules are evaluated once
    return materialise(rows, "zstd")


def _predicted(truth: DataFrame) -> DataFrame:
    """A detector that misses every seventh session, repeats itself and cries wolf."""
    found = truth.where("k % 7 <> 0").withColumn("copy", F.explode(F.expr("IF(k % 11 = 0, array(1, 2), array(1))")))
    false = truth.where("k % 13 = 1").select(
        "violation_id",
        "constraint_id",
        F.array(F.concat_ws("-", F.lit("EV"), "k", F.lit("000-session_start"))).alias("ocel_event_ids"),
        "session_id",
        "k",
        F.lit(3).alias("copy"),
    )
    both = found.select(*false.columns).unionByName(false)
    return both.withColumn(
        "prediction_id", F.concat_ws("#", "violation_id", F.col("copy").cast("string"))
    ).drop("violation_id")


def _claims(truth: DataFrame) -> DataFrame:
    """The same detections in a judge's words, citing one event too many."""
    start = F.concat_ws("-", F.lit("EV"), "k", F.lit("000-session_start"))
    words = (
        F.when(F.col("k") % 2 == 0, F.col("constraint_id"))
        .when(F.col("constraint_id").startswith("T4"), F.lit(" Missing Reason Codes "))
        .when(F.col("constraint_id").startswith("T5"), F.lit("SPECIAL category access"))
        .when(F.col("constraint_id").startswith("STD"), F.lit("stale policy"))
        .otherwise(F.concat(F.lit(" "), F.upper("constraint_id")))
    )
    return _predicted(truth).select(
        F.col("prediction_id").alias("claim_id"),
        words.alias("constraint_id"),
        F.array_distinct(F.concat("ocel_event_ids", F.array(start))).alias("ocel_event_ids"),
        "session_id",
    )


@_query
def confusion_by_constraint(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    counts = evaluation.confusion(_predicted(truth), truth, by=["constraint_id"])
    return evaluation.with_ratios(counts)


@_query
def confusion_overall(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.with_ratios(evaluation.confusion(_predicted(truth), truth))


@_query
def session_confusion(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.session_confusion(_predicted(truth), truth)


@_query
def exact_matches(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.exact_matches(_predicted(truth), truth)


def _same_first_event(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """A caller's matcher: same constraint and first cited event, in the order of ids."""
    key = ["constraint_id", "first_event"]

    def ranked(df, name):
        rows = df.select("constraint_id", F.array_min("ocel_event_ids").alias("first_event"), name)
        return with_rank_in_group(rows, key, [name], "nth")

    pairs = ranked(predicted, "prediction_id").join(ranked(truth, "violation_id"), [*key, "nth"])
    return pairs.select("prediction_id", "violation_id")


@_query
def first_event_confusion(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.matched_confusion(_predicted(truth), truth, _same_first_event)


@_query
def overlap_matches(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.overlap_matches(_claims(truth), truth, SYNONYMS)


@_query
def overlap_matches_two(spark, sf_dir):
    """Two shared events are asked for, so truths that cite one event stay open."""
    truth = _truth(spark, sf_dir)
    return evaluation.overlap_matches(_claims(truth), truth, SYNONYMS, threshold=2)


@_query
def overlap_confusion(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluation.overlap_confusion(_claims(truth), truth, SYNONYMS)


@_query
def adjudication_queue(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    queue = evaluation.adjudication_queue(_claims(truth), truth.where("k % 5 <> 0"), SYNONYMS)
    return queue.select("claim_id", "session_id")


@_query
def verdict_determinism(spark, sf_dir):
    """Four detector runs, one of which also loses the sessions divisible by 4099."""
    truth = _truth(spark, sf_dir)
    runs = spark.range(4).select(F.concat(F.lit("run-"), "id").alias("run_id"))
    rows = truth.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(
        "run <> 3 OR k % 4099 <> 0"
    )
    digests = evaluation.verdict_digests(
        runs, rows.withColumn("run_id", F.concat(F.lit("run-"), F.col("run").cast("string")))
    )
    return evaluation.determinism_score(digests)


@_query
def evidence_reproducibility(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    records = truth.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.col("run").cast("string").alias("run_id"),
        "violation_id",
        F.sha2(
            F.concat_ws(":", "violation_id", F.when((F.col("k") % 9 == 0) & (F.col("run") == 1), F.lit("x"))), 256
        ).alias("record_sha256"),
    )
    return evaluation.evidence_reproducibility(records)


def _responses(spark, sf_dir) -> DataFrame:
    """Five sampled responses per order: agreeing, dissenting and malformed ones."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    # the keys are few bytes and parsing is much work, so the tasks do not follow the file's row groups
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    rows = orders.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(4))))
    text = F.expr("""
        CASE
          WHEN (k * 7 + sample_index) % 11 = 0 THEN 'no violations that I can see'
          WHEN (k + sample_index) % 13 = 0 THEN '{"violations":[],"note":"all clear"}'
          WHEN (k + sample_index) % 17 = 0 THEN '{"violations":[{"constraint_id":"stale policy","event_ids":[]}]}'
          WHEN (k + sample_index) % 3 = 0 THEN '{"violations":[]}'
          ELSE concat('{"violations":[',
            IF(k % 5 = 0, concat('{"constraint_id":"Stale Policy","event_ids":["EV-', k, '-b","EV-', k,
                                 '-a"],"explanation":"closed"},'), ''),
            '{"constraint_id":"T4.reason_code_presence","event_ids":["EV-', k, '-a"]}]}')
        END""")
    return rows.select(
        F.concat(F.lit("SES-"), "k").alias("session_id"),
        F.lit("judge-1").alias("model_id"),
        F.lit("spans").alias("condition"),
        "sample_index",
        text.alias("raw_text"),
        (F.length(text) % 97).alias("input_tokens"),
        F.lit(5).cast("bigint").alias("output_tokens"),
        (F.col("k") % 2 == 0).alias("from_cache"),
    )


@_query
def parsed_reports(spark, sf_dir):
    runs = claims.parse_reports(_responses(spark, sf_dir))
    return runs.select(
        "session_id", "sample_index", "schema_failure", F.coalesce(F.size("claims"), F.lit(-1)).alias("n_claims")
    )


@_query
def modal_verdicts(spark, sf_dir):
    runs = claims.parse_reports(_responses(spark, sf_dir))
    return claims.modal_verdicts(runs).select("session_id", "verdict_key", "runs_agreeing", "runs")


@_query
def majority_vote(spark, sf_dir):
    runs = claims.parse_reports(_responses(spark, sf_dir))
    voted = claims.majority_vote(runs, k=3, synonyms=SYNONYMS)
    return voted.select(
        "session_id", "label", "support", "constraint_id", F.array_join("ocel_event_ids", ",").alias("events")
    )


@_query
def claim_costs(spark, sf_dir):
    return claims.cost_summary(claims.parse_reports(_responses(spark, sf_dir)))


@_query
def claim_cache_keys(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    key = claims.cache_key(
        F.col("model_id"), F.col("sample_index"), F.col("condition"), F.sha2("raw_text", 256), F.lit("p0")
    )
    return rows.select("session_id", "sample_index", key.alias("cache_key"))


QUERIES = {
    "confusion_by_constraint": confusion_by_constraint,
    "confusion_overall": confusion_overall,
    "session_confusion": session_confusion,
    "exact_matches": exact_matches,
    "first_event_confusion": first_event_confusion,
    "overlap_matches": overlap_matches,
    "overlap_matches_two": overlap_matches_two,
    "overlap_confusion": overlap_confusion,
    "adjudication_queue": adjudication_queue,
    "verdict_determinism": verdict_determinism,
    "evidence_reproducibility": evidence_reproducibility,
    "parsed_reports": parsed_reports,
    "modal_verdicts": modal_verdicts,
    "majority_vote": majority_vote,
    "claim_costs": claim_costs,
    "claim_cache_keys": claim_cache_keys,
}

_TRUTH = """
truth AS (
  SELECT constraint_id || '|' || events AS violation_id, constraint_id, events, session_id,
         CAST(substr(session_id, 5) AS BIGINT) AS k
  FROM viol
),
predicted AS (
  SELECT violation_id || '#' || c.copy AS prediction_id, constraint_id, events, session_id, k
  FROM truth JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR k % 11 = 0 WHERE k % 7 <> 0
  UNION ALL
  SELECT violation_id || '#3', constraint_id, 'EV-' || k || '-000-session_start', session_id, k
  FROM truth WHERE k % 13 = 1
),
blocks AS (
  SELECT coalesce(p.constraint_id, t.constraint_id) AS constraint_id, coalesce(p.n, 0) AS p, coalesce(t.n, 0) AS t
  FROM (SELECT constraint_id, events, count(*) AS n FROM predicted GROUP BY 1, 2) p
  FULL JOIN (SELECT constraint_id, events, count(*) AS n FROM truth GROUP BY 1, 2) t
  ON p.constraint_id = t.constraint_id AND p.events = t.events
)"""


def _scored(body: str) -> str:
    return all_violations("").rstrip() + "," + _TRUTH + body


# Events of truths and of claims, which also cite the start of their session.
_CITED = """,
tev AS (SELECT violation_id, constraint_id, k, unnest(string_split(events, ',')) AS e FROM truth),
pev AS (
  SELECT prediction_id, constraint_id, unnest(list_distinct(list_append(string_split(events, ','), 'EV-' || k || '-000-session_start'))) AS e
  FROM predicted
)"""


def _greedy(shared: int) -> str:
    """Truths in order take their first free claim; those that share no claim need no order."""
    return (
        "WITH RECURSIVE"
        + _scored(_CITED).removeprefix("WITH")
        + f""",
cand AS (
  SELECT t.violation_id, p.prediction_id FROM tev t JOIN pev p ON p.constraint_id = t.constraint_id AND p.e = t.e
  GROUP BY 1, 2 HAVING count(*) >= {shared}
),
wanted AS (SELECT prediction_id FROM cand GROUP BY 1 HAVING count(*) > 1),
contested AS (
  SELECT t.violation_id, row_number() OVER (ORDER BY t.constraint_id, list_sort(string_split(t.events, ',')), t.violation_id) AS i
  FROM truth t WHERE t.violation_id IN (SELECT violation_id FROM cand WHERE prediction_id IN (SELECT prediction_id FROM wanted))
),
offers AS (SELECT i, violation_id, prediction_id FROM cand JOIN contested USING (violation_id)),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken
  UNION ALL
  SELECT w.i + 1, list_append(any_value(w.taken), coalesce(min(o.prediction_id) FILTER (NOT list_contains(w.taken, o.prediction_id)), ''))
  FROM walk w LEFT JOIN offers o ON o.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM contested) GROUP BY w.i
),
served AS (
  SELECT unnest(taken) AS claim_id, unnest(range(1, len(taken) + 1)) AS i FROM walk WHERE i = (SELECT count(*) FROM contested)
),
matches AS (
  SELECT s.claim_id, c.violation_id FROM served s JOIN contested c ON c.i = s.i WHERE s.claim_id <> ''
  UNION ALL
  SELECT min(prediction_id), violation_id FROM cand WHERE violation_id NOT IN (SELECT violation_id FROM contested) GROUP BY violation_id
)
"""
    )


_RATIOS = """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT *,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS recall
FROM ({})) """
_COUNTS = (
    "CAST(sum(least(p, t)) AS BIGINT) AS tp, CAST(sum(p - least(p, t)) AS BIGINT) AS fp, "
    "CAST(sum(t - least(p, t)) AS BIGINT) AS fn FROM blocks"
)

_RUNS = """
WITH runs AS (
  SELECT o_orderkey AS k, i AS sample_index,
    CASE WHEN (o_orderkey * 7 + i) % 11 = 0 OR (o_orderkey + i) % 13 = 0 OR (o_orderkey + i) % 17 = 0 THEN -1
         WHEN (o_orderkey + i) % 3 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n
  FROM orders CROSS JOIN generate_series(0, 4) s(i)
)"""

_TEXTS = """,
texts AS (
  SELECT *, CASE
    WHEN (k * 7 + sample_index) % 11 = 0 THEN 'no violations that I can see'
    WHEN (k + sample_index) % 13 = 0 THEN '{"violations":[],"note":"all clear"}'
    WHEN (k + sample_index) % 17 = 0 THEN '{"violations":[{"constraint_id":"stale policy","event_ids":[]}]}'
    WHEN n = 0 THEN '{"violations":[]}'
    ELSE '{"violations":[' || (CASE WHEN n = 2 THEN '{"constraint_id":"Stale Policy","event_ids":["EV-' || k ||
      '-b","EV-' || k || '-a"],"explanation":"closed"},' ELSE '' END) ||
      '{"constraint_id":"T4.reason_code_presence","event_ids":["EV-' || k || '-a"]}]}' END AS txt
  FROM runs
)"""

ORACLES = {
    "confusion_by_constraint": _scored(
        _RATIOS.format(f"SELECT constraint_id, {_COUNTS} GROUP BY constraint_id")
    ),
    "confusion_overall": _scored(_RATIOS.format(f"SELECT {_COUNTS}")),
    "session_confusion": _scored("""
SELECT CAST(sum(least(p, t)) AS BIGINT) AS tp, CAST(sum(p - least(p, t)) AS BIGINT) AS fp,
       CAST(sum(t - least(p, t)) AS BIGINT) AS fn
FROM (SELECT coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS t
  FROM (SELECT session_id, count(*) AS n FROM predicted GROUP BY 1) a
  FULL JOIN (SELECT session_id, count(*) AS n FROM truth GROUP BY 1) b ON a.session_id = b.session_id)"""),
    "exact_matches": _scored("""
SELECT p.prediction_id, t.violation_id, p.constraint_id
FROM (SELECT *, row_number() OVER (PARTITION BY constraint_id, events ORDER BY prediction_id) AS i FROM predicted) p
JOIN (SELECT *, row_number() OVER (PARTITION BY constraint_id, events ORDER BY violation_id) AS i FROM truth) t
ON p.constraint_id = t.constraint_id AND p.events = t.events AND p.i = t.i"""),
    "first_event_confusion": _scored("""
SELECT m AS tp, (SELECT count(*) FROM predicted) - m AS fp, (SELECT count(*) FROM truth) - m AS fn
FROM (SELECT CAST(sum(least(p.n, t.n)) AS BIGINT) AS m
  FROM (SELECT constraint_id, list_min(string_split(events, ',')) AS e, count(*) AS n FROM predicted GROUP BY 1, 2) p
  JOIN (SELECT constraint_id, list_min(string_split(events, ',')) AS e, count(*) AS n FROM truth GROUP BY 1, 2) t
  ON p.constraint_id = t.constraint_id AND p.e = t.e)"""),
    "overlap_matches": _greedy(1)
    + "SELECT claim_id, m.violation_id, t.constraint_id FROM matches m JOIN truth t ON t.violation_id = m.violation_id",
    "overlap_matches_two": _greedy(2)
    + "SELECT claim_id, m.violation_id, t.constraint_id FROM matches m JOIN truth t ON t.violation_id = m.violation_id",
    "overlap_confusion": _greedy(1)
    + """SELECT m AS tp, (SELECT count(*) FROM predicted) - m AS fp, (SELECT count(*) FROM truth) - m AS fn
FROM (SELECT count(*) AS m FROM matches)""",
    "adjudication_queue": _scored(_CITED + """
SELECT p.prediction_id AS claim_id, p.session_id FROM predicted p
WHERE p.prediction_id NOT IN (
  SELECT c.prediction_id FROM pev c JOIN tev t ON t.constraint_id = c.constraint_id AND t.e = c.e WHERE t.k % 5 <> 0)"""),
    "verdict_determinism": _scored("""
SELECT 4 AS runs, CAST(CASE WHEN EXISTS (SELECT 1 FROM truth WHERE k % 4099 = 0) THEN 0.75 ELSE 1.0 END AS DOUBLE)
       AS determinism"""),
    "evidence_reproducibility": _scored("""
SELECT count(*) AS records, avg(CASE WHEN k % 9 = 0 THEN 0.0 ELSE 1.0 END) AS reproducibility FROM truth"""),
    "parsed_reports": _RUNS + """
SELECT 'SES-' || k AS session_id, sample_index, n = -1 AS schema_failure, n AS n_claims FROM runs""",
    "modal_verdicts": _RUNS + """,
keyed AS (
  SELECT k, CASE n WHEN -1 THEN '"SCHEMA_FAILURE"' WHEN 0 THEN '[]'
    WHEN 1 THEN '[["T4.reason_code_presence",["EV-' || k || '-a"]]]'
    ELSE '[["Stale Policy",["EV-' || k || '-a","EV-' || k || '-b"]],["T4.reason_code_presence",["EV-' || k || '-a"]]]'
    END AS verdict_key FROM runs
), counted AS (
  SELECT k, verdict_key, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, verdict_key) AS r
  FROM keyed GROUP BY k, verdict_key
)
SELECT 'SES-' || k AS session_id, verdict_key, n AS runs_agreeing, 5 AS runs FROM counted WHERE r = 1""",
    "majority_vote": _RUNS + """
SELECT 'SES-' || k AS session_id, lower('T4.reason_code_presence') AS label, count(*) AS support,
       'T4.reason_code_presence' AS constraint_id, 'EV-' || k || '-a' AS events
FROM runs WHERE n >= 1 GROUP BY k HAVING count(*) >= 3
UNION ALL
SELECT 'SES-' || k, lower('STD.policy_version_current'), count(*), 'Stale Policy',
       'EV-' || k || '-b,EV-' || k || '-a'
FROM runs WHERE n = 2 GROUP BY k HAVING count(*) >= 3""",
    "claim_costs": _RUNS + _TEXTS + """
SELECT 'judge-1' AS model_id, 'spans' AS condition, count(*) AS calls,
       count(*) FILTER (WHERE n = -1) AS failures, count(*) FILTER (WHERE k % 2 = 0) AS cached,
       count(*) FILTER (WHERE k % 2 <> 0) AS fresh, CAST(sum(length(txt) % 97) AS BIGINT) AS input_tokens,
       CAST(sum(5) AS BIGINT) AS output_tokens FROM texts""",
    "claim_cache_keys": _RUNS + _TEXTS + """
SELECT 'SES-' || k AS session_id, sample_index,
       sha256('{"condition":"spans","input_hash":"' || sha256(txt) || '","model_id":"judge-1","prompt_sha256":"p0","sample_index":'
              || sample_index || '}') AS cache_key FROM texts""",
}
