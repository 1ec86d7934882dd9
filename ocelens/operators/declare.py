"""DECLARE discovery and conformance on a flattened log (case_id, event_id, activity, ts).

Per case and ordered pair of activities that it has, everything the templates need is a
mergeable aggregate: counts, first and last occurrence, adjacency in the case, and adjacency
in the case reduced to the two activities (which decides the alternate family). No trace
is ever gathered, and no case is multiplied by activities it does not have. Cases with the
same sequence of activities agree on every template, so one of them is looked at for all
(``_typical``); events without a case are left out. A case supports a template when it activates it; confidence is the
satisfied share of the activated cases.

    template              activated by   satisfied when
    existence(a)          every case     a occurs
    absence(a)            every case     a does not occur
    exactly_one(a)        a              a occurs once
    init(a)               every case     the case starts with a
    responded_existence   a              b occurs
    coexistence           a or b         both occur
    response              a              the last b is after the last a
    precedence            b              the first a is before the first b
    succession            a or b         response and precedence
    altresponse           a              each a has a b before the next a
    altprecedence         b              each b has an a after the previous b
    altsuccession         a or b         both alternates
    chainresponse         a              each a is directly followed by b
    chainprecedence       b              each b is directly preceded by a
    chainsuccession       a or b         both chains
    noncoexistence        a or b         not both occur
    nonsuccession         a              no b after any a
    nonchainsuccession    a              no b directly after an a
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_neighbours
from ocelens.operators.mining import case_variants
from ocelens.session import materialise

UNARY = ("existence", "absence", "exactly_one", "init")
SYMMETRIC = ("coexistence", "noncoexistence")
ALTERNATE = ("altresponse", "altprecedence", "altsuccession")
BINARY = (
    "responded_existence",
    "coexistence",
    "response",
    "precedence",
    "succession",
    *ALTERNATE,
    "chainresponse",
    "chainprecedence",
    "chainsuccession",
    "noncoexistence",
    "nonsuccession",
    "nonchainsuccession",
)
TEMPLATES = (*UNARY, *BINARY)
#: The activity whose presence in a case activates a template.
ACTIVATED_BY = {
    **dict.fromkeys(("coexistence", "succession", "altsuccession", "chainsuccession", "noncoexistence"), "either"),
    **dict.fromkeys(("precedence", "altprecedence", "chainprecedence"), "b"),
    **dict.fromkeys(
        ("responded_existence", "response", "altresponse", "chainresponse", "nonsuccession", "nonchainsuccession"), "a"
    ),
}
_LETTERS_IN_BLOCK = 1000
#: Templates that a case with one of the two activities satisfies.
NEGATIVE = ("noncoexistence", "nonsuccession", "nonchainsuccession")


def _typical(flat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, weights, members): one case of every variant with its events.

    events are the rows of ``flat`` of these cases; weights (case_id, variant, cases) says for how
    many cases each stands; members (case_id, variant) has all cases. The events of all cases
    are shuffled once, for their variants.
    """
    flat = flat.select("case_id", "event_id", "activity", "ts")
    members = materialise(case_variants(flat).select("case_id", "variant"), "zstd")
    weights = materialise(members.groupBy("variant").agg(F.min("case_id").alias("case_id"), F.count("*").alias("cases")))
    events = materialise(flat.join(weights.select("case_id"), "case_id", "left_semi"), "zstd")
    return events, weights, members


def _weight(ok: Column) -> Column:
    """The number of cases for which it holds."""
    return F.sum(F.when(ok, F.col("cases")).otherwise(0))


def _stats(flat: DataFrame) -> DataFrame:
    """Per case and activity: how often, first and last."""
    at = F.struct("ts", "event_id")
    return flat.groupBy("case_id", "activity").agg(
        F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")
    )


def _met(flat: DataFrame, stats: DataFrame, alternate: bool, only: DataFrame | None = None) -> DataFrame:
    """Per case and ordered pair of activities that it has both of: counts, extremes, adjacencies.

    ``only`` (a, b) keeps to some pairs. An event is paired with activities of its own
    case, so the work does not depend on how many activities there are elsewhere.
    """
    side = lambda s: stats.select(
        "case_id", F.col("activity").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "lo", "hi")]
    )
    both = side("a").join(side("b"), "case_id").where("a <> b")
    if only is not None:
        both = both.join(only, ["a", "b"], "left_semi")
    events = flat.select("case_id", "ts", "event_id", "activity")

    def next_to(rows: DataFrame, group: list[str], name: str) -> DataFrame:
        follows = with_neighbours(rows, group, ["ts", "event_id"], following="then", carry=["activity"])
        pairs = follows.select("case_id", F.col("activity").alias("a"), F.col("then.activity").alias("b"))
        return pairs.where("a <> b").groupBy("case_id", "a", "b").agg(F.count("*").alias(name))

    both = both.join(next_to(events, ["case_id"], "adjacent"), ["case_id", "a", "b"], "left")
    if alternate:
        reduced = events.join(stats.select("case_id", F.col("activity").alias("other")), "case_id").where("other <> activity")
        reduced = reduced.select(
            *events.columns, F.least("activity", "other").alias("p"), F.greatest("activity", "other").alias("q")
        )
        if only is not None:
            wanted = only.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
            reduced = reduced.join(wanted, ["p", "q"], "left_semi").select(*events.columns, "p", "q")
        both = both.join(next_to(reduced, ["case_id", "p", "q"], "paired"), ["case_id", "a", "b"], "left")
    else:
        both = both.withColumn("paired", F.lit(None).cast("long"))
    return both.fillna(0, ["adjacent", "paired"])


def _satisfied() -> dict[str, Column]:
    """For a case with both activities."""
    response, precedence = F.col("hi_b") > F.col("hi_a"), F.col("lo_a") < F.col("lo_b")
    alt_r, alt_p = F.col("paired") == F.col("n_a"), F.col("paired") == F.col("n_b")
    chain_r, chain_p = F.col("adjacent") == F.col("n_a"), F.col("adjacent") == F.col("n_b")
    return {
        "responded_existence": F.lit(True),
        "coexistence": F.lit(True),
        "response": response,
        "precedence": precedence,
        "succession": response & precedence,
        "altresponse": alt_r,
        "altprecedence": alt_p,
        "altsuccession": alt_r & alt_p,
        "chainresponse": chain_r,
        "chainprecedence": chain_p,
        "chainsuccession": chain_r & chain_p,
        "noncoexistence": F.lit(False),
        "nonsuccession": F.col("hi_b") < F.col("lo_a"),
        "nonchainsuccession": F.col("adjacent") == 0,
    }


def _start(stats: DataFrame) -> DataFrame:
    return stats.groupBy("case_id").agg(F.min_by("activity", "lo").alias("start"))


def _counts(rows: DataFrame, counts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per template from columns of (activated, satisfied)."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("template"), active.cast("long").alias("activated"), ok.cast("long").alias("satisfied"))
            for t, (active, ok) in counts.items()
        ]
    )
    return rows.select(F.inline(cells), "a", "b").select("template", "a", "b", "activated", "satisfied")


def _candidate_pairs(letters: DataFrame, least: float) -> DataFrame:
    """(a, has_a, b, has_b): the pairs that can reach ``least`` activated cases.

    A template is activated by one of its letters or by both, so one of them has half of
    these cases at least. A case has few letters, so few letters are that frequent; each
    is dealt to every block of the others, and the pairs of a block are a task of their own.
    """
    blocks = letters.count() // _LETTERS_IN_BLOCK + 1
    block = F.pmod(F.xxhash64("activity"), F.lit(blocks)).cast("long").alias("block")
    frequent = letters.where(F.col("has") * 2 >= least).select(F.col("activity").alias("a"), F.col("has").alias("has_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    others = letters.select(F.col("activity").alias("b"), F.col("has").alias("has_b"), block)
    one_way = frequent.join(others, "block").where("a <> b").select("a", "has_a", "b", "has_b")
    back = one_way.where(F.col("has_b") * 2 < least).select(F.col("b").alias("a"), F.col("has_b").alias("has_a"), F.col("a").alias("b"), F.col("has_a").alias("has_b"))
    return one_way.unionByName(back)


def discover(
    flat: DataFrame,
    *,
    min_support: float = 0.1,
    min_confidence: float = 1.0,
    templates: tuple[str, ...] = TEMPLATES,
) -> DataFrame:
    """The reference model: (template, a, b, activated, satisfied, support, confidence).

    Cases with one activity of a pair decide every template by that alone, so they are
    only counted; facts are looked at where a case has both.
    """
    flat, weights, _ = _typical(flat)
    weights = weights.select("case_id", "cases")
    stats = materialise(_stats(flat))
    cases = weights.agg(F.coalesce(F.sum("cases"), F.lit(0))).first()[0]
    single = stats.join(weights, "case_id").groupBy("activity").agg(F.sum("cases").alias("has"), _weight(F.col("n") == 1).alias("once"))
    starts = _start(stats).join(weights, "case_id").groupBy(F.col("start").alias("activity")).agg(F.sum("cases").alias("first"))
    letters = materialise(single.join(starts, "activity", "left").fillna(0, ["first"]))
    total = F.lit(cases)
    unary = {
        "existence": (total, F.col("has")),
        "absence": (total, total - F.col("has")),
        "exactly_one": (F.col("has"), F.col("once")),
        "init": (total, F.col("first")),
    }
    named = letters.select(F.col("activity").alias("a"), F.lit("").alias("b"), "has", "once", "first")
    parts = [_counts(named, {t: unary[t] for t in UNARY if t in templates})] if set(templates) & set(UNARY) else []
    binary = [t for t in BINARY if t in templates]
    if binary:
        rules = _satisfied()
        met = _met(flat, stats, any(t in ALTERNATE for t in binary)).join(weights, "case_id").groupBy("a", "b").agg(
            F.sum("cases").alias("met"), *[_weight(rules[t]).alias(t) for t in binary]
        )
        pairs = _candidate_pairs(letters, min_support * cases).join(met, ["a", "b"], "left").fillna(0)
        active = {"a": F.col("has_a"), "b": F.col("has_b"), "either": F.col("has_a") + F.col("has_b") - F.col("met")}
        counts = {}
        for t in binary:
            alone = active[ACTIVATED_BY[t]] - F.col("met") if t in NEGATIVE else F.lit(0)
            counts[t] = (active[ACTIVATED_BY[t]], F.col(t) + alone)
        rows = _counts(pairs, counts)
        parts.append(rows.where(~F.col("template").isin(*SYMMETRIC) | (F.col("a") < F.col("b"))))
    counted = reduce(DataFrame.unionByName, parts)
    return (
        counted.withColumn("support", F.col("activated") / F.lit(max(cases, 1)))
        .withColumn("confidence", F.col("satisfied") / F.col("activated"))
        .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    )


def deviations(flat: DataFrame, model: DataFrame) -> DataFrame:
    """(case_id, template, a, b): model constraints a case activates and breaks."""
    kept = materialise(model.select("template", "a", "b").distinct())
    flat, weights, members = _typical(flat)
    stats = materialise(_stats(flat))
    of = lambda *t: kept.where(F.col("template").isin(*t))
    out = ["case_id", "template", "a", "b"]

    # what a case lacks, or does not start with: the model's activities in one row
    wanted = of("existence", "init").agg(
        *[F.collect_set(F.when(F.col("template") == t, F.col("a"))).alias(t) for t in ("existence", "init")]
    )
    cases = stats.groupBy("case_id").agg(
        F.min_by("activity", "lo").alias("start"), F.collect_set("activity").alias("present")
    )
    compared = cases.withColumn("_one", F.lit(1)).join(wanted.withColumn("_one", F.lit(1)), "_one")
    missing = {
        "existence": F.array_except("existence", "present"),
        "init": F.filter("init", lambda x: x != F.col("start")),
    }
    rows = [
        compared.select("case_id", F.lit(t).alias("template"), F.explode(c).alias("a"), F.lit("").alias("b"))
        for t, c in missing.items()
    ]
    counted = stats.withColumnRenamed("activity", "a").join(of("absence", "exactly_one"), "a")
    rows.append(counted.where("template = 'absence' OR n <> 1").select(*out))

    # one activity of the pair is there, the other is not
    positive = [t for t in BINARY if t not in NEGATIVE]
    for here, there in (("a", "b"), ("b", "a")):
        active = [t for t in positive if ACTIVATED_BY[t] in (here, "either")]
        alone = stats.select("case_id", F.col("activity").alias(here)).join(of(*active), here)
        has = stats.select("case_id", F.col("activity").alias(there))
        rows.append(alone.join(has, ["case_id", there], "left_anti").select(*out))

    # both are there
    pairs = materialise(of(*BINARY).select("a", "b").distinct())
    broken = F.filter(
        F.array(*[F.struct(F.lit(t).alias("template"), ok.alias("ok")) for t, ok in _satisfied().items()]),
        lambda v: ~v["ok"],
    )
    met = _met(flat, stats, not of(*ALTERNATE).isEmpty(), pairs)
    both = met.select("case_id", "a", "b", F.explode(broken).alias("_v")).withColumn("template", F.col("_v.template"))
    rows.append(both.join(kept, ["template", "a", "b"], "left_semi").select(*out))
    # written, so that its size is known where it is dealt to all cases of its variants
    broken = materialise(reduce(DataFrame.unionByName, rows).join(weights, "case_id").select("variant", "template", "a", "b"))
    return members.join(broken, "variant").select(*out)


def deviation_anchors(flat: DataFrame, deviating: DataFrame) -> DataFrame:
    """The cited events of each deviation, one row per event in time order keys.

    Every event of the case whose activity is in the pair; the case's first event when
    there is none. Kept long (one row per citation), so no case is gathered.
    """
    at = F.struct("ts", "event_id")
    first = flat.groupBy("case_id").agg(F.min(at).alias("first"))
    letters = deviating.select(
        "case_id", "template", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("activity")
    )
    cited = letters.join(flat, ["case_id", "activity"]).select(
        "case_id", "template", "a", "b", "event_id", "ts"
    )
    key = ["case_id", "template", "a", "b"]
    uncited = (
        deviating.join(cited.select(*key).distinct(), key, "left_anti")
        .join(first, "case_id")
        .select(*key, F.col("first.event_id").alias("event_id"), F.col("first.ts").alias("ts"))
    )
    return cited.unionByName(uncited)


def declare_violations(deviating: DataFrame, sessions: DataFrame) -> DataFrame:
    """Deviations as detections with session credit (citations: ``deviation_anchors``)."""
    return deviating.join(sessions, "case_id", "left").select(
        F.concat(F.lit("DECLARE."), F.col("template")).alias("constraint_id"),
        "case_id",
        "a",
        "b",
        F.coalesce("session_id", F.lit("")).alias("session_id"),
    )
