import pytest

from ocelens.operators.constraints import TEMPLATES, evaluate, in_canonical_order, register_template
from ocelens.operators.rules import DEFAULT_RULES, Rule
from tests.builders import OBJECTS, act, approval, decision, handoff, make_log, read

RULES = {r.constraint_id.split(".")[0]: r for r in DEFAULT_RULES}


def run(spark, rule, events, o2o=(), objects=OBJECTS):
    log = make_log(spark, events, objects, o2o)
    rows = in_canonical_order(TEMPLATES[rule.template](log, rule)).collect()
    return [(list(r.ocel_event_ids), list(r.ocel_object_ids), r.session_id) for r in rows]


@pytest.mark.parametrize(
    "events, expected",
    [
        ([approval("a", 1), decision("d", 5)], []),
        ([decision("d", 5)], [(["d"], ["D1"], "S1")]),
        ([decision("d", 5, outcome="refer")], []),
        ([approval("a", 1, by="H2"), decision("d", 5)], [(["a"], ["H2"], "S1")]),
        # an unauthorised grant does not matter beside an authorised one
        ([approval("a", 1, by="H2"), approval("b", 2), decision("d", 5)], []),
        # the same second is not before, whatever the ids say
        ([approval("z", 5), decision("d", 5)], [(["d", "z"], ["D1"], "S1")]),
        ([approval("a", 5), decision("d", 5)], [(["a", "d"], ["D1"], "S1")]),
        ([approval("a", 1, dec="D2"), decision("d", 5)], [(["a", "d"], ["D1", "D2"], "S1")]),
        # another session's approval of this decision counts and is where a breach is booked
        ([approval("a", 1, session="S2"), decision("d", 5)], []),
        ([approval("a", 1, session="S2", by="H2"), decision("d", 5)], [(["a"], ["H2"], "S2")]),
        ([approval("a", 9), decision("d", 5)], [(["d", "a"], ["D1"], "S1")]),
    ],
)
def test_approval_arms(spark, events, expected):
    assert run(spark, RULES["T1"], events) == expected


def test_coverage_is_per_application_and_timeless(spark):
    rule = Rule("T2.x", "t2_mandatory_data_coverage", "low", {"required_sources": ["credit_bureau", "income_verification"]})
    events = [decision("d1", 5), decision("d2", 5, session="S2", app="A2", dec="D2"), read("r1", 9, "R1"), read("r2", 1, "R2")]
    assert run(spark, rule, events) == [(["d2"], [], "S2")]
    bare = [("d", "make_decision", 5, {"S1": "within", "D1": "produces"}, {"outcome": "grant"})]
    assert run(spark, rule, bare) == [(["d"], [], "S1")]


@pytest.mark.parametrize(
    "events, expected",
    [
        ([act("e1", 1, "G0"), handoff("h", 2, "G0", "G1"), act("e2", 3, "G1")], []),
        ([act("e1", 1, "G0"), act("e2", 3, "G1")], [(["e2"], ["G1"], "S1")]),
        ([handoff("h", 2, "G0", "G2"), act("e2", 3, "G1")], [(["h", "e2"], ["G1"], "S1")]),
        # a handoff in the same minute is too late
        ([handoff("h", 3, "G0", "G1"), act("i", 3, "G1")], [(["h", "i"], ["G1"], "S1")]),
        (
            [handoff("h1", 1, "G0", "G1"), act("e1", 2, "G1"), handoff("h2", 3, "G1", "G0"), handoff("h3", 4, "G0", "G2")],
            [(["h1", "h2"], ["G0", "G1"], "S1")],
        ),
        # a handoff cited as misdirected is not charged again as a cycle
        (
            [handoff("h1", 1, "G0", "G2"), handoff("h2", 2, "G2", "G0"), act("e1", 3, "G1")],
            [(["h2", "e1"], ["G1"], "S1")],
        ),
    ],
)
def test_delegation_arms(spark, events, expected):
    assert run(spark, RULES["T3"], events) == expected


def test_reason_codes_come_from_the_object(spark):
    explain = ("x", "emit_reasoning", 6, {"S1": "within", "D1": "explains"}, {})
    assert run(spark, RULES["T4"], [decision("d", 5, outcome="deny"), explain]) == []
    assert run(spark, RULES["T4"], [decision("d", 5, outcome="deny")]) == [(["d"], ["D1"], "S1")]
    both = ("x", "emit_reasoning", 6, {"S1": "within", "D2": "explains"}, {})
    assert run(spark, RULES["T4"], [decision("d", 5, dec="D2", outcome="refer"), both]) == [(["d"], ["D2"], "S1")]


def test_prohibited_reads_need_an_application(spark):
    loose = ("r3", "retrieve_data", 2, {"S1": "within", "R2": "reads"}, {})
    assert run(spark, RULES["T5"], [read("r1", 1, "R1"), read("r2", 1, "R2"), loose]) == [(["r2"], ["R2"], "S1")]


def test_superseded_policy(spark):
    assert run(spark, RULES["STD"], [decision("d", 5, policy="P0"), decision("e", 5)]) == [(["d"], ["P0"], "S1")]


def test_existence_cites_the_first_touch_even_a_declaration(spark):
    rule = Rule(
        "STD.x", "object_existence", "low",
        {"anchor_object_type": "CreditDecision", "related_object_type": "Application", "o2o_qualifier": "derived_from"},
    )
    events = [decision("d", 5), ("s", "session_start", 1, {"D2": "declares"}, {})]
    assert run(spark, rule, events, [("D1", "A1", "derived_from")]) == [(["s"], ["D2"], "")]
    # an edge to the wrong type does not satisfy
    assert len(run(spark, rule, events, [("D1", "S1", "derived_from")])) == 2


def test_response_and_precedence_ignore_declarations_and_ties(spark):
    params = {"activity_a": "grant_approval", "activity_b": "make_decision", "object_type": "CreditDecision"}
    events = [approval("a", 5), decision("d", 5), ("g", "grant_approval", 1, {"D1": "declares"}, {})]
    for template, cited in (("synchronised_response", "a"), ("synchronised_precedence", "d")):
        assert [v[0] for v in run(spark, Rule("STD.x", template, "low", params), events)] == [[cited]]


@pytest.mark.parametrize("when, expected, hits", [("always", None, ["P0", "P1"]), ("non_empty", None, ["P0"]), ("equals", "", ["P1"])])
def test_absence_predicates(spark, when, expected, hits):
    params = {
        "anchor_event_type": "make_decision", "qualifier": "governed_by", "object_type": "PolicyVersion",
        "attribute": "effective_to", "violating_when": when, "value": expected,
    }
    events = [decision("d", 5, policy="P0"), decision("e", 5)]
    found = run(spark, Rule("STD.x", "object_absence", "low", params), events)
    assert sorted(v[1][0] for v in found) == hits


def test_unknown_and_registered_templates(spark):
    log = make_log(spark, [decision("d", 5)], OBJECTS)
    with pytest.raises(ValueError):
        evaluate(log, [Rule("X.y", "nope", "low")])
    register_template("none", lambda lg, rule: TEMPLATES["t5_prohibited_attribute_access"](lg, RULES["T5"]))
    assert evaluate(log, [Rule("X.y", "none", "low")]).count() == 0


def test_result_does_not_depend_on_partitioning(spark):
    events = [act("e1", 1, "G0"), act("e2", 3, "G1"), decision("d", 5, policy="P0", outcome="deny")]
    log = make_log(spark, events, OBJECTS)
    seen = set()
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str([r.asDict() for r in in_canonical_order(evaluate(log)).collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
