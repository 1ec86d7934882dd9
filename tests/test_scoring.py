import random

import pytest
from pyspark.sql import functions as F

from ocelens.operators import claims, declare, evaluation, sampling

PRED = "prediction_id string, constraint_id string, ocel_event_ids array<string>, session_id string"
TRUTH = "violation_id string, constraint_id string, ocel_event_ids array<string>, session_id string"


def _greedy(preds, truths, match):
    left, tp = list(preds), []
    for t in sorted(truths, key=lambda t: (t[1], sorted(t[2]), t[0])):
        for p in left:
            if match(p, t):
                tp.append((p[0], t[0]))
                left.remove(p)
                break
    return tp


def _random(seed, n):
    rng = random.Random(seed)
    make = lambda name: [
        (f"{name}{i:03d}", rng.choice(["A.x", "B.y"]), rng.sample([f"e{k}" for k in range(6)], rng.randrange(1, 4)), f"s{rng.randrange(3)}")
        for i in range(n)
    ]
    return make("p"), make("t")


@pytest.mark.parametrize("seed, threshold", [(1, 1), (2, 1), (3, 2), (4, 3)])
def test_overlap_matching_equals_the_sequential_greedy(spark, seed, threshold):
    preds, truths = _random(seed, 25)
    expected = _greedy(preds, truths, lambda p, t: p[1].lower() == t[1].lower() and len(set(p[2]) & set(t[2])) >= threshold)
    p = spark.createDataFrame(preds, PRED).withColumnRenamed("prediction_id", "claim_id")
    t = spark.createDataFrame(truths, TRUTH)
    got = {(r.claim_id, r.violation_id) for r in evaluation.overlap_matches(p, t, {}, threshold).collect()}
    assert got == set(expected)
    counts = evaluation.overlap_confusion(p, t, {}, threshold).first()
    assert (counts.tp, counts.fp, counts.fn) == (len(expected), 25 - len(expected), 25 - len(expected))
    queue = {r.claim_id for r in evaluation.adjudication_queue(p, t, {}, threshold).collect()}
    assert queue == {
        x[0] for x in preds if not any(x[1] == y[1] and len(set(x[2]) & set(y[2])) >= threshold for y in truths)
    }


def test_many_truths_on_one_event_take_few_writes(spark, monkeypatch):
    writes = []
    real = evaluation.materialise
    monkeypatch.setattr(evaluation, "materialise", lambda df: writes.append(1) or real(df))
    preds = [(f"p{i:04d}", "A", ["hot", f"own{i}"], "s") for i in range(900)]
    truths = [(f"t{i:04d}", "A", ["hot"], "s") for i in range(1000)]
    p = spark.createDataFrame(preds, PRED).withColumnRenamed("prediction_id", "claim_id")
    got = {(r.claim_id, r.violation_id) for r in evaluation.overlap_matches(p, spark.createDataFrame(truths, TRUTH), {}).collect()}
    assert got == {(f"p{i:04d}", f"t{i:04d}") for i in range(900)}
    assert len(writes) <= 20


def test_a_frequent_event_adds_no_pairs(spark):
    """Sets that share one event everywhere meet only on what else they share."""
    preds = [(f"p{i:03d}", "A", ["hot", f"e{i % 40}", f"x{i}"], "s") for i in range(200)]
    truths = [(f"t{i:03d}", "A", ["hot", f"e{i % 50}"], "s") for i in range(200)]
    p, t = spark.createDataFrame(preds, PRED), spark.createDataFrame(truths, TRUTH)
    c = p.select(F.col("prediction_id").alias("c"), F.col("constraint_id").alias("label"), "ocel_event_ids")
    links = evaluation._linked(c, t.select(F.col("violation_id").alias("t"), F.col("constraint_id").alias("label"), "ocel_event_ids"), 2)
    assert [x.count() for x in links] == [200, 4 * 40]
    got = {(r.claim_id, r.violation_id) for r in evaluation.overlap_matches(p.withColumnRenamed("prediction_id", "claim_id"), t, {}, 2).collect()}
    assert got == set(_greedy(preds, truths, lambda a, b: len(set(a[2]) & set(b[2])) >= 2))


def test_exact_and_session_confusion_equal_the_sequential_greedy(spark):
    preds, truths = _random(9, 40)
    p, t = spark.createDataFrame(preds, PRED), spark.createDataFrame(truths, TRUTH)
    exact = _greedy(preds, truths, lambda a, b: a[1] == b[1] and set(a[2]) == set(b[2]))
    got = evaluation.confusion(p, t).first()
    assert (got.tp, got.fp, got.fn) == (len(exact), 40 - len(exact), 40 - len(exact))
    assert evaluation.exact_matches(p, t).count() == len(exact)
    same = _greedy(preds, truths, lambda a, b: a[3] == b[3] != "")
    assert evaluation.session_confusion(p, t).first().tp == len(same)


def test_a_callers_matcher(spark):
    preds, truths = _random(11, 30)
    p, t = spark.createDataFrame(preds, PRED), spark.createDataFrame(truths, TRUTH)
    assert tuple(evaluation.matched_confusion(p, t).first()) == tuple(evaluation.confusion(p, t).select("tp", "fp", "fn").first())

    def same_number(predicted, truth):
        number = lambda c: F.substring(c, 2, 9)
        return predicted.where("prediction_id < 'p010'").join(truth, number("prediction_id") == number("violation_id"))

    evaluation.register_matcher("same_number", same_number)
    assert tuple(evaluation.matched_confusion(p, t, "same_number").first()) == (10, 20, 20)
    with pytest.raises(ValueError):
        evaluation.register_matcher("same_number", same_number)
    with pytest.raises(Exception, match="an id twice"):
        evaluation.matched_confusion(p, t, lambda a, b: a.join(b, a.constraint_id == b.constraint_id)).collect()


@pytest.mark.parametrize("least", [0, 3, 8])
def test_candidate_pairs_of_letters(spark, least, monkeypatch):
    monkeypatch.setattr(declare, "_LETTERS_IN_BLOCK", 4)
    has = {f"a{k:02d}": k % 7 for k in range(23)}
    letters = spark.createDataFrame(list(has.items()), "activity string, has long")
    got = sorted(map(tuple, declare._candidate_pairs(letters, least).collect()))
    assert got == sorted((a, x, b, y) for a, x in has.items() for b, y in has.items() if a != b and max(x, y) * 2 >= least)


@pytest.mark.parametrize(
    "counts, ratios",
    [((0, 0, 0), (1.0, 1.0, 1.0)), ((0, 0, 2), (0.0, 0.0, 0.0)), ((0, 2, 0), (0.0, 0.0, 0.0)), ((3, 1, 2), (0.75, 0.6, 2 / 3))],
)
def test_ratio_conventions(spark, counts, ratios):
    row = evaluation.with_ratios(spark.createDataFrame([counts], "tp long, fp long, fn long")).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx(ratios)


def test_empty_inputs_still_score(spark):
    p, t = spark.createDataFrame([], PRED), spark.createDataFrame([], TRUTH)
    assert tuple(evaluation.confusion(p, t).first()) == (0, 0, 0)


def test_strict_report_parsing(spark):
    good = '{"violations":[{"constraint_id":"x","event_ids":["a","b"]}]}'
    bad = ["", "[]", "{}", '{"violations":null}', '{"violations":[{}]}', '{"violations":[{"constraint_id":"","event_ids":["a"]}]}',
           '{"violations":[{"constraint_id":"x","event_ids":[]}]}', '{"violations":[{"constraint_id":"x","event_ids":["a"],"q":1}]}',
           '{"violations":[{"constraint_id":"x","event_ids":[1]}]}', '{"violations":[],"extra":0}', '{"violations":[1]}']
    df = spark.createDataFrame([(x,) for x in [good, '{"violations":[]}', *bad]], "raw_text string")
    rows = {r.raw_text: r for r in claims.parse_reports(df).collect()}
    assert not rows[good].schema_failure and rows[good].claims[0].event_ids == ["a", "b"]
    assert rows['{"violations":[]}'].claims == []
    assert all(rows[b].schema_failure and rows[b].claims is None for b in bad)


def test_modal_and_majority(spark):
    runs = [("s", "m", "c", i, text) for i, text in enumerate([
        '{"violations":[{"constraint_id":"Stale Policy","event_ids":["b","a"]}]}',
        '{"violations":[{"constraint_id":"stale policy ","event_ids":["a","b"]},{"constraint_id":"q","event_ids":["z"]}]}',
        "broken", "broken",
        '{"violations":[{"constraint_id":"STD.policy_version_current","event_ids":["a","b"]}]}'])]
    df = claims.parse_reports(spark.createDataFrame(runs, "session_id string, model_id string, condition string, sample_index int, raw_text string"))
    modal = claims.modal_verdicts(df).first()
    assert modal.verdict_key == claims.SCHEMA_FAILURE and modal.runs_agreeing == 2 and modal.claims is None
    votes = claims.majority_vote(df, k=3, synonyms={"stale policy": "STD.policy_version_current"}).collect()
    assert [(v.constraint_id, list(v.ocel_event_ids), v.support) for v in votes] == [("Stale Policy", ["b", "a"], 3)]


def _declare(trace_set, letters):
    """Template verdicts by definition over whole traces."""
    out = {}

    def add(t, a, b, case, ok):
        out[(case, t, a, b)] = ok

    for case, tr in trace_set.items():
        for a in letters:
            add("existence", a, "", case, a in tr)
            add("absence", a, "", case, a not in tr)
            add("init", a, "", case, tr[0] == a)
            if a in tr:
                add("exactly_one", a, "", case, tr.count(a) == 1)
            for b in letters:
                if a == b or (a not in tr and b not in tr):
                    continue
                both = a in tr and b in tr
                red = [x for x in tr if x in (a, b)]
                resp = both and all(b in tr[i + 1 :] for i, x in enumerate(tr) if x == a)
                prec = both and all(a in tr[:i] for i, x in enumerate(tr) if x == b)
                ar = all(i + 1 < len(red) and red[i + 1] == b for i, x in enumerate(red) if x == a) and a in tr
                ap = all(i > 0 and red[i - 1] == a for i, x in enumerate(red) if x == b) and b in tr
                cr = all(i + 1 < len(tr) and tr[i + 1] == b for i, x in enumerate(tr) if x == a) and a in tr
                cp = all(i > 0 and tr[i - 1] == a for i, x in enumerate(tr) if x == b) and b in tr
                if a < b:
                    add("coexistence", a, b, case, both)
                    add("noncoexistence", a, b, case, not both)
                for t, ok in (("succession", resp and prec), ("altsuccession", ar and ap), ("chainsuccession", cr and cp)):
                    add(t, a, b, case, ok)
                if a in tr:
                    add("responded_existence", a, b, case, both)
                    add("response", a, b, case, resp)
                    add("altresponse", a, b, case, ar)
                    add("chainresponse", a, b, case, cr)
                    add("nonsuccession", a, b, case, not any(b in tr[i + 1 :] for i, x in enumerate(tr) if x == a))
                    add("nonchainsuccession", a, b, case, not any(tr[i : i + 2] == [a, b] for i in range(len(tr))))
                if b in tr:
                    add("precedence", a, b, case, prec)
                    add("altprecedence", a, b, case, ap)
                    add("chainprecedence", a, b, case, cp)
    return out


def test_declare_verdicts_match_the_definitions(spark):
    rng = random.Random(11)
    traces = {f"c{i}": [rng.choice("xyz") for _ in range(rng.randrange(1, 7))] for i in range(25)}
    rows = [(c, f"{c}-{i}", a, i) for c, tr in traces.items() for i, a in enumerate(tr)]
    flat = spark.createDataFrame(rows, "case_id string, event_id string, activity string, t int").withColumn(
        "ts", F.timestamp_seconds("t")
    ).drop("t")
    want = _declare(traces, "xyz")
    model = declare.discover(flat, min_support=0, min_confidence=0)
    counts: dict = {}
    for (_, *rule), ok in want.items():
        active, kept = counts.get(tuple(rule), (0, 0))
        counts[tuple(rule)] = (active + 1, kept + ok)
    assert {(r.template, r.a, r.b): (r.activated, r.satisfied) for r in model.collect()} == counts
    broken = sorted(tuple(r) for r in declare.deviations(flat, model).collect())
    assert broken == sorted((case, *rule) for (case, *rule), ok in want.items() if not ok)


def test_declare_looks_at_one_case_of_every_variant(spark, monkeypatch):
    """Cases with the same activities in order agree, so 60 cases of three variants are three to pair."""
    traces = {f"c{i:02}": list(("xyxz", "zzy", "yx")[i % 3]) for i in range(60)}
    rows = [(c, f"{c}-{i}", a, i) for c, tr in traces.items() for i, a in enumerate(tr)]
    flat = spark.createDataFrame(rows, "case_id string, event_id string, activity string, t int").withColumn(
        "ts", F.timestamp_seconds("t")
    ).drop("t")
    seen, met = [], declare._met
    monkeypatch.setattr(declare, "_met", lambda rows, *args: seen.append(rows.count()) or met(rows, *args))
    model = declare.discover(flat, min_support=0, min_confidence=0)
    broken = declare.deviations(flat, model)
    assert seen == [9, 9]
    want = _declare(traces, "xyz")
    assert model.agg(F.sum("activated"), F.sum("satisfied")).first() == (len(want), sum(want.values()))
    assert broken.count() == len(want) - sum(want.values())


def test_declare_takes_any_number_of_activities(spark):
    rows = [(f"c{k % 2}", f"e{k}", f"act{k:03}") for k in range(300)]
    flat = spark.createDataFrame(rows, "case_id string, event_id string, activity string").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    model = declare.discover(flat, templates=("init", "chainresponse"), min_support=0, min_confidence=0)
    assert model.where("template = 'init'").count() == 300
    assert model.where("template = 'chainresponse' AND satisfied = 1").count() == 298


def test_compatible_allocation_is_the_sequential_greedy(spark):
    import hashlib

    names = list("ABCD")
    friends = {"A": ["B", "D"], "B": ["A"], "C": ["D"], "D": ["A", "C"]}
    ids = [f"S{i}" for i in range(60)]
    rank = lambda *p: hashlib.sha256(":".join(map(str, p)).encode()).hexdigest()
    expected = set()
    for sid in ids:
        k = sum(int(rank(3, "k", sid)[:8], 16) / 0xFFFFFFFF >= t for t in sampling.MIXED_THRESHOLDS)
        chosen = []
        for n in sorted(names, key=lambda n: rank(3, "mix", sid, n)):
            if len(chosen) < k and (n != "B" or sid.endswith("1")) and all(n in friends[c] for c in chosen):
                chosen.append(n)
        expected |= {(sid, n) for n in chosen}
    df = spark.createDataFrame([(i,) for i in ids], "session_id string")
    classes = {n: F.col("session_id").endswith("1") if n == "B" else F.lit(True) for n in names}
    got = sampling.allocate_compatible(df, classes, friends, 3)
    assert {tuple(r) for r in got.collect()} == expected
