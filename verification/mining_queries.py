"""Flattening, variants, directly-follows and DECLARE over both projected logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.functions.canonical import utc_text
from ocelens.operators import declare, mining
from verification.activity_log import activity_log
from verification.order_log import order_log
from ocelens.session import configure
from verification.order_sql import with_orders

EARLIER, LATER = "t0 < DATE '1998-01-01'", "t0 >= DATE '1998-01-01'"
FIRST_HALF, SECOND_HALF = "ts < DATE '2024-01-16'", "ts >= DATE '2024-01-16'"
MIN_SUPPORT, MIN_CONFIDENCE = 0.2, 0.8


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    return run


@_query
def flattened_agents(spark, sf_dir):
    flat = mining.flatten(order_log(spark, sf_dir), "Agent")
    return flat.select("case_id", "event_id", "activity", utc_text(F.col("ts")).alias("ts"))


@_query
def application_variants(spark, sf_dir):
    variants = mining.case_variants(mining.flatten(order_log(spark, sf_dir), "Application"))
    return mining.variant_counts(variants).select("example", "length", "cases")


@_query
def user_variants(spark, sf_dir):
    variants = mining.case_variants(mining.flatten(activity_log(spark, sf_dir), "User"))
    return mining.variant_counts(variants).select("example", "length", "cases")


@_query
def novel_application_variants(spark, sf_dir):
    clean = mining.case_variants(mining.flatten(order_log(spark, sf_dir, EARLIER), "Application"))
    later = mining.case_variants(mining.flatten(order_log(spark, sf_dir, LATER), "Application"))
    return mining.novel_cases(later, clean).select("case_id", "length")


@_query
def directly_follows_graph(spark, sf_dir):
    return mining.dfg_edges(mining.directly_follows(order_log(spark, sf_dir), sessions=False))


@_query
def user_directly_follows_graph(spark, sf_dir):
    return mining.dfg_edges(mining.directly_follows(activity_log(spark, sf_dir), sessions=False))


@_query
def novel_directly_follows(spark, sf_dir):
    clean = mining.dfg_edges(mining.directly_follows(order_log(spark, sf_dir, EARLIER), sessions=False))
    later = mining.directly_follows(order_log(spark, sf_dir, LATER))
    return mining.novel_edges(later, clean, per_mille=1).select(
        "constraint_id", F.array_join("ocel_event_ids", ",").alias("events"), "session_id", "detail"
    )


@_query
def notion_statistics(spark, sf_dir):
    return mining.notion_statistics(order_log(spark, sf_dir), *mining.CASE_NOTIONS)


@_query
def case_sessions(spark, sf_dir):
    log = order_log(spark, sf_dir)
    return reduce(
        DataFrame.unionByName,
        [
            mining.case_sessions(log, n).select(F.lit(n).alias("case_notion"), "*")
            for n in mining.CASE_NOTIONS
        ],
    )


@_query
def activities_per_type(spark, sf_dir):
    return mining.activities_per_type(order_log(spark, sf_dir))


@_query
def events_per_timestamp(spark, sf_dir):
    counts = mining.events_per_timestamp(order_log(spark, sf_dir))
    return counts.select(utc_text(F.col("ts")).alias("ts"), "events")


@_query
def object_lifecycles(spark, sf_dir):
    return mining.object_lifecycles(order_log(spark, sf_dir)).select(
        "object_type",
        "object_id",
        utc_text(F.col("first_ts")).alias("first_ts"),
        utc_text(F.col("last_ts")).alias("last_ts"),
        "events",
    )


def _model(df: DataFrame) -> DataFrame:
    return df.select(
        "template", "a", "b", "activated", "satisfied", F.round("confidence", 6).alias("confidence")
    )


@_query
def declare_model_users(spark, sf_dir):
    flat = mining.flatten(activity_log(spark, sf_dir), "User")
    return _model(declare.discover(flat, min_support=MIN_SUPPORT, min_confidence=0.5))


@_query
def declare_model_applications(spark, sf_dir):
    flat = mining.flatten(order_log(spark, sf_dir), "Application")
    return _model(declare.discover(flat, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE))


def _conformance(spark, sf_dir):
    clean = mining.flatten(order_log(spark, sf_dir, EARLIER), "Application")
    later = order_log(spark, sf_dir, LATER)
    flat = mining.flatten(later, "Application")
    model = declare.discover(clean, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE)
    return later, flat, declare.deviations(flat, model)


@_query
def declare_conformance(spark, sf_dir):
    later, _, broken = _conformance(spark, sf_dir)
    return declare.declare_violations(broken, mining.case_sessions(later, "Application"))


@_query
def declare_anchors(spark, sf_dir):
    _, flat, broken = _conformance(spark, sf_dir)
    anchors = declare.deviation_anchors(flat, broken)
    return anchors.groupBy("template", "a", "b").agg(
        F.countDistinct("case_id").alias("cases"),
        F.count("*").alias("citations"),
        F.min("event_id").alias("lowest_event"),
    )


QUERIES = {
    "flattened_agents": flattened_agents,
    "application_variants": application_variants,
    "user_variants": user_variants,
    "novel_application_variants": novel_application_variants,
    "directly_follows_graph": directly_follows_graph,
    "user_directly_follows_graph": user_directly_follows_graph,
    "novel_directly_follows": novel_directly_follows,
    "notion_statistics": notion_statistics,
    "case_sessions": case_sessions,
    "activities_per_type": activities_per_type,
    "events_per_timestamp": events_per_timestamp,
    "object_lifecycles": object_lifecycles,
    "declare_model_users": declare_model_users,
    "declare_model_applications": declare_model_applications,
    "declare_conformance": declare_conformance,
    "declare_anchors": declare_anchors,
}

_TS = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_APPLICATIONS = "SELECT object_id AS case_id, event_id, event_type AS activity, ts FROM rel WHERE object_type = 'Application'"
_USERS = "SELECT 'USR-' || user_id AS case_id, 'EV-' || event_id AS event_id, event_type AS activity, ts FROM events"
_PERIOD = " AND session_id IN (SELECT session_id FROM sess WHERE {})"
_VARIANT_COUNTS = """
SELECT min(case_id) AS example, length, count(*) AS cases FROM (
  SELECT case_id, count(*) AS length, list(activity ORDER BY ts, event_id) AS seq FROM ({flat})
  GROUP BY case_id) GROUP BY seq, length"""
_DFG = """
SELECT object_type, activity_a, activity_b, count(DISTINCT first_id || '>' || second_id) AS event_couples,
       count(*) AS traversals
FROM (SELECT object_type, object_id, event_type AS activity_a, event_id AS first_id,
        lead(event_type) OVER w AS activity_b, lead(event_id) OVER w AS second_id
      FROM {rel} WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, event_id))
WHERE second_id IS NOT NULL GROUP BY 1, 2, 3"""


def declare_ctes(tag: str, flat: str) -> str:
    """CTEs computing every template verdict of a flattened log in SQL."""
    return f"""
{tag}_flat AS ({flat}),
{tag}_letter AS (SELECT DISTINCT activity FROM {tag}_flat),
{tag}_seq AS (SELECT *, row_number() OVER w AS pos, lead(activity) OVER w AS nxt
  FROM {tag}_flat WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
{tag}_st AS (SELECT case_id, activity, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM {tag}_seq GROUP BY 1, 2),
{tag}_case AS (SELECT case_id, min(CASE WHEN pos = 1 THEN activity END) AS start FROM {tag}_seq GROUP BY 1),
{tag}_adj AS (SELECT case_id, activity AS a, nxt AS b, count(*) AS k FROM {tag}_seq GROUP BY 1, 2, 3),
{tag}_par AS (SELECT case_id, activity AS a, nx AS b, count(*) AS k FROM (
    SELECT f.case_id, f.activity, lead(f.activity) OVER (
      PARTITION BY f.case_id, least(f.activity, l.activity), greatest(f.activity, l.activity)
      ORDER BY f.ts, f.event_id) AS nx
    FROM {tag}_flat f JOIN {tag}_letter l ON l.activity <> f.activity) GROUP BY 1, 2, 3),
{tag}_pair AS (
  SELECT c.case_id, x.activity AS a, y.activity AS b, p.n AS na, p.lo AS la, p.hi AS ha,
         q.n AS nb, q.lo AS lb, q.hi AS hb, coalesce(j.k, 0) AS adj, coalesce(r.k, 0) AS par
  FROM {tag}_case c CROSS JOIN {tag}_letter x JOIN {tag}_letter y ON x.activity <> y.activity
  LEFT JOIN {tag}_st p ON p.case_id = c.case_id AND p.activity = x.activity
  LEFT JOIN {tag}_st q ON q.case_id = c.case_id AND q.activity = y.activity
  LEFT JOIN {tag}_adj j ON j.case_id = c.case_id AND j.a = x.activity AND j.b = y.activity
  LEFT JOIN {tag}_par r ON r.case_id = c.case_id AND r.a = x.activity AND r.b = y.activity
  WHERE p.n IS NOT NULL OR q.n IS NOT NULL),
{tag}_unary AS (
  SELECT c.case_id, x.activity AS a, p.n, c.start FROM {tag}_case c CROSS JOIN {tag}_letter x
  LEFT JOIN {tag}_st p ON p.case_id = c.case_id AND p.activity = x.activity),
{tag}_v AS (
  SELECT case_id, 'existence' AS template, a, '' AS b, n IS NOT NULL AS ok FROM {tag}_unary
  UNION ALL SELECT case_id, 'absence', a, '', n IS NULL FROM {tag}_unary
  UNION ALL SELECT case_id, 'exactly_one', a, '', n = 1 FROM {tag}_unary WHERE n IS NOT NULL
  UNION ALL SELECT case_id, 'init', a, '', start = a FROM {tag}_unary
  UNION ALL SELECT case_id, 'responded_existence', a, b, nb IS NOT NULL FROM {tag}_pair WHERE na IS NOT NULL
  UNION ALL SELECT case_id, 'coexistence', a, b, na IS NOT NULL AND nb IS NOT NULL FROM {tag}_pair WHERE a < b
  UNION ALL SELECT case_id, 'response', a, b, coalesce(hb > ha, false) FROM {tag}_pair WHERE na IS NOT NULL
  UNION ALL SELECT case_id, 'precedence', a, b, coalesce(la < lb, false) FROM {tag}_pair WHERE nb IS NOT NULL
  UNION ALL SELECT case_id, 'succession', a, b, coalesce(hb > ha AND la < lb, false) FROM {tag}_pair
  UNION ALL SELECT case_id, 'altresponse', a, b, par = na FROM {tag}_pair WHERE na IS NOT NULL
  UNION ALL SELECT case_id, 'altprecedence', a, b, par = nb FROM {tag}_pair WHERE nb IS NOT NULL
  UNION ALL SELECT case_id, 'altsuccession', a, b, coalesce(par = na AND par = nb, false) FROM {tag}_pair
  UNION ALL SELECT case_id, 'chainresponse', a, b, adj = na FROM {tag}_pair WHERE na IS NOT NULL
  UNION ALL SELECT case_id, 'chainprecedence', a, b, adj = nb FROM {tag}_pair WHERE nb IS NOT NULL
  UNION ALL SELECT case_id, 'chainsuccession', a, b, coalesce(adj = na AND adj = nb, false) FROM {tag}_pair
  UNION ALL SELECT case_id, 'noncoexistence', a, b, na IS NULL OR nb IS NULL FROM {tag}_pair WHERE a < b
  UNION ALL SELECT case_id, 'nonsuccession', a, b, coalesce(hb < la, true) FROM {tag}_pair WHERE na IS NOT NULL
  UNION ALL SELECT case_id, 'nonchainsuccession', a, b, adj = 0 FROM {tag}_pair WHERE na IS NOT NULL
)"""


def _model_sql(tag: str, confidence: float) -> str:
    return f"""
SELECT template, a, b, count(*) AS activated, count(*) FILTER (WHERE ok) AS satisfied,
       round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 6) AS confidence
FROM {tag}_v GROUP BY 1, 2, 3
HAVING count(*) >= {MIN_SUPPORT} * (SELECT count(*) FROM {tag}_case)
   AND count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) >= {confidence}"""


_CONFORMANCE = (
    declare_ctes("c", _APPLICATIONS + _PERIOD.format(EARLIER))
    + ","
    + declare_ctes("e", _APPLICATIONS + _PERIOD.format(LATER))
    + f", model AS ({_model_sql('c', MIN_CONFIDENCE)}), broken AS ("
    "SELECT v.case_id, v.template, v.a, v.b FROM e_v v JOIN model m "
    "ON m.template = v.template AND m.a = v.a AND m.b = v.b WHERE NOT v.ok)"
)


def _with_more(ctes: str, body: str) -> str:
    return with_orders("", ).rstrip() + ",\n" + ctes.strip().lstrip(",") + "\n" + body


ORACLES = {
    "flattened_agents": with_orders(
        f"SELECT object_id AS case_id, event_id, event_type AS activity, {_TS.format('ts')} AS ts "
        "FROM rel WHERE object_type = 'Agent'"
    ),
    "application_variants": with_orders(_VARIANT_COUNTS.format(flat=_APPLICATIONS)),
    "user_variants": _VARIANT_COUNTS.format(flat=_USERS),
    "novel_application_variants": with_orders(f"""
SELECT case_id, len(seq) AS length FROM (
  SELECT case_id, list(activity ORDER BY ts, event_id) AS seq
  FROM ({_APPLICATIONS + _PERIOD.format(LATER)}) GROUP BY case_id)
WHERE seq NOT IN (SELECT list(activity ORDER BY ts, event_id)
  FROM ({_APPLICATIONS + _PERIOD.format(EARLIER)}) GROUP BY case_id)"""),
    "directly_follows_graph": with_orders(_DFG.format(rel="rel")),
    "user_directly_follows_graph": _DFG.format(
        rel="(SELECT 'User' AS object_type, CAST(user_id AS VARCHAR) AS object_id, event_type, "
        "'EV-' || event_id AS event_id, ts FROM events UNION ALL "
        "SELECT 'Day', strftime(ts, '%Y%m%d'), event_type, 'EV-' || event_id, ts FROM events)"
    ),
    "novel_directly_follows": with_orders(f"""
SELECT 'OCDFG.novel_edge' AS constraint_id, first_id || ',' || second_id AS events, min(session_id) AS session_id,
       object_type || ': ' || activity_a || ' > ' || activity_b AS detail
FROM (SELECT object_type, session_id, event_type AS activity_a, event_id AS first_id,
        lead(event_type) OVER w AS activity_b, lead(event_id) OVER w AS second_id
      FROM rel WHERE session_id IN (SELECT session_id FROM sess WHERE {LATER})
      WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, event_id))
WHERE second_id IS NOT NULL AND (object_type, activity_a, activity_b) NOT IN (
  SELECT (object_type, activity_a, activity_b) FROM (SELECT *, sum(event_couples) OVER (PARTITION BY object_type) AS total
    FROM ({_DFG.format(rel=f"(SELECT * FROM rel WHERE session_id IN (SELECT session_id FROM sess WHERE {EARLIER}))")}))
  WHERE event_couples * 1000 >= total)
GROUP BY object_type, activity_a, activity_b, first_id, second_id"""),
    "notion_statistics": with_orders("""
SELECT n.case_notion, t.total AS events_total, count(DISTINCT r.event_id) AS events_kept,
       t.total - count(DISTINCT r.event_id) AS events_dropped,
       count(r.event_id) - count(DISTINCT r.event_id) AS events_duplicated
FROM (VALUES ('Application'), ('Session'), ('CreditDecision'), ('Agent')) n(case_notion)
CROSS JOIN (SELECT count(*) AS total FROM ev) t
LEFT JOIN rel r ON r.object_type = n.case_notion GROUP BY 1, t.total"""),
    "case_sessions": with_orders("""
SELECT 'Session' AS case_notion, session_id AS case_id, session_id FROM sess
UNION ALL SELECT object_type, object_id, min(session_id) FROM rel
WHERE object_type IN ('Application', 'CreditDecision') GROUP BY 1, 2"""),
    "activities_per_type": with_orders(
        "SELECT object_type, event_type AS activity, count(*) AS edges FROM rel GROUP BY 1, 2"
    ),
    "events_per_timestamp": with_orders(
        f"SELECT {_TS.format('ts')} AS ts, count(*) AS events FROM ev GROUP BY 1"
    ),
    "object_lifecycles": with_orders(
        f"SELECT object_type, object_id, {_TS.format('min(ts)')} AS first_ts, "
        f"{_TS.format('max(ts)')} AS last_ts, count(*) AS events FROM rel GROUP BY 1, 2"
    ),
    "declare_model_users": "WITH " + declare_ctes("u", _USERS).strip() + _model_sql("u", 0.5),
    "declare_model_applications": _with_more(
        declare_ctes("c", _APPLICATIONS), _model_sql("c", MIN_CONFIDENCE)
    ),
    "declare_conformance": _with_more(
        _CONFORMANCE,
        """SELECT 'DECLARE.' || template AS constraint_id, case_id, a, b,
       'SES-' || substr(case_id, 5) AS session_id FROM broken""",
    ),
    "declare_anchors": _with_more(
        _CONFORMANCE,
        """, cited AS (
  SELECT b.*, f.event_id FROM broken b JOIN e_flat f ON f.case_id = b.case_id AND f.activity IN (b.a, b.b)
), anchors AS (
  SELECT * FROM cited UNION ALL
  SELECT b.*, (SELECT arg_min(s.event_id, s.pos) FROM e_seq s WHERE s.case_id = b.case_id)
  FROM broken b WHERE NOT EXISTS (SELECT 1 FROM e_flat f WHERE f.case_id = b.case_id AND f.activity IN (b.a, b.b))
) SELECT template, a, b, count(DISTINCT case_id) AS cases, count(*) AS citations, min(event_id) AS lowest_event
FROM anchors GROUP BY 1, 2, 3""",
    ),
}
