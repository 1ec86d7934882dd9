"""Near-duplicates of texts and vectors, repeated passages, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import classes_of_rows, covered, near_classes, reachable, shingle_counts, similarity, without_repeats

from ocelens.llm import dart_minhash, embedding_dedup, queries, substring_dedup
from ocelens.llm.components import components

TEXTS = "doc_id long, text string, component_id string, kept int, first int, label int"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """With further columns that carry the names of results and of inner columns."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TEXTS)


def near_copy(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(d, " ".join(near_copy(base, rng, rng.choice([0, 1, 2, 9, 25])))) for d in range(10, 90)]
    chain = list(base[:200])
    for d in range(200, 230):  # each is near its neighbours only
        chain = near_copy(chain, rng, 3)
        rows.append((d, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "few words"), (5, "few words"), (6, "few other"), (7, "a a a a a a a a"), (8, "a a a a a a a")]
    rows += [(300 + k, rows[0][1]) for k in range(20)] + [rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


def test_near_duplicate_classes(spark, near_rows):
    got = sorted(map(tuple, dart_minhash.classes(frame(spark, near_rows)).collect()))
    want = near_classes(near_rows)
    assert got == sorted((d, c, d == c) for (d, _), c in zip(near_rows, want, strict=True))
    stay = dart_minhash.deduplicate(frame(spark, near_rows))
    assert stay.columns == frame(spark, near_rows).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


def test_every_text_of_a_repeated_id_is_classed(spark):
    rng = random.Random(8)
    w, x, y, z = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "wxyz")
    near = lambda words: " ".join(near_copy(words, rng, 1))
    rows = [(3, " ".join(w)), (7, near(w)), (7, " ".join(x)), (7, " ".join(y)), (9, near(x)), (9, " ".join(z)), (9, near(z)), (7, None), (7, ""), (11, "x " * 100_000)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        want = near_classes(rows)
        found = dart_minhash.classes(frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == sorted((d, c) for (d, _), c in zip(rows, want, strict=True))
        left = {(r.doc_id, r.text) for r in dart_minhash.deduplicate(frame(spark, rows)).collect()}
        assert {(3, " ".join(w)), (7, " ".join(x)), (7, " ".join(y)), (7, None), (11, "x " * 100_000)} <= left
        assert sum(d == 9 for d, _ in left) == 1 and len([1 for d, _ in left if d == 7]) == 3 + (("") in {t for d, t in left if d == 7})
    # other columns differ: one row stays, whatever the order
    copies = spark.createDataFrame([(1, "a b c", k) for k in (5, 3, 4)], "doc_id long, text string, other int")
    picked = {dart_minhash.deduplicate(copies.orderBy(F.lit(s) * F.col("other"))).first().other for s in (1, -1)}
    assert len(picked) == 1


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "one two three four five six"), (None, "lonely words that nobody else has got"), (3, "one two three four five six")]
    got = sorted((tuple(r) for r in dart_minhash.classes(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 3, False), (None, None, True), (3, 3, True)], key=repr)
    assert dart_minhash.classes(frame(spark, rows).limit(0)).count() == 0
    assert substring_dedup.repeats(frame(spark, rows).limit(0)).count() == 0


def test_blocks_join_what_stars_leave_apart(spark):
    """Members of one family, each a class of its own."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = [(d, " ".join(near_copy(base, rng, rng.choice([3, 12])))) for d in range(30)]
    signed = dart_minhash.sign(frame(spark, rows), dart_minhash.Sketch())
    members = signed.join(frame(spark, rows).select("doc_id", "text"), "doc_id").selectExpr("1L as family", "doc_id as label", "*")
    found = [tuple(r) for r in dart_minhash._links_in_blocks(members, dart_minhash.Sketch(), rows=7).collect()]
    sets = {d: shingle_counts(t) for d, t in rows}
    true = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    assert {tuple(sorted(l)) for l in found} <= set(true)
    assert reachable(list(sets), found) == reachable(list(sets), true)


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 9, 60), rng.uniform(0.2, 9, 60)
    thrown = dart_minhash.throw(np.concatenate([elements, elements]), np.concatenate([a, b]), [60, 60], 4000)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((thrown[0] == thrown[1]).mean() - truth) < 0.03
    alone = dart_minhash.throw(elements, a, [60], 4000)
    assert (alone[0] == thrown[0]).all()  # whatever else is in the batch


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, k) for k in range(501, 560)] + [(900, 900)]
    want = reachable(sorted({x for l in links for x in l}), links)
    want.pop(900)
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = [(None, "a b"), (None, " ".join(base[0])), (7, None), (8, ""), (9, " ".join(base[0])), (9, " ".join(base[0]))]
    for d in range(10, 50):
        w = []
        for _ in range(rng.randint(1, 6)):
            b = rng.choice(base)
            w += b[rng.randint(0, len(b) - 1) :][: rng.randint(5, 60)]
        rows.append((d, " \n".join(w)))
    rows += [(61, rows[-1][1]), (61, rows[-1][1])]
    rng.shuffle(rows)
    found = substring_dedup.repeats(frame(spark, rows), 10, with_text=True)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == without_repeats(rows, 10)
    for r in found.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_every_text_of_a_repeated_id_is_searched(spark):
    rng = random.Random(5)
    said = [[f"{k}-{rng.randrange(1000)}" for _ in range(30)] for k in range(9)]
    text = lambda *parts: " ".join(" ".join(said[p]) for p in parts)
    # 7 holds a copy, a part and nothing of smaller documents; 9 and 12 repeat one of its texts each; rows of 7 share a passage
    rows = [(3, text(0)), (4, text(1, 2)), (7, text(0)), (7, text(2, 3)), (7, text(4, 5)), (7, text(5, 6)), (7, text(5, 6)), (9, text(4)), (12, text(7, 6)), (12, text(3, 8)), (12, None)]
    rows += [(7, text(6).replace(" ", "  "))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = substring_dedup.repeats(frame(spark, rows), 10, with_text=True)
        got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
        assert got == without_repeats(rows, 10)
    left = sorted(((r.doc_id, r.text) for r in substring_dedup.deduplicate(frame(spark, rows), 10).collect()), key=repr)
    want = []
    for (d, t), gone in zip(rows, covered(rows, 10), strict=True):
        kept = " ".join(w for w, g in zip((t or "").split(), gone, strict=True) if not g)
        want += [(d, kept if any(gone) else t)] if kept or not any(gone) else []
    assert left == sorted(want, key=repr)


def test_queries_on_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op9_repeated_passages"](spark, SF).collect()), key=repr)
    assert got == without_repeats(docs, 50)


def linked(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    usable = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            wide = np.array(v, float) / np.abs(np.array(v, float)).max()
            usable[k] = wide / np.linalg.norm(wide)
    pairs = [(i, j) for i in usable for j in usable if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least]
    least_id = classes_of_rows([d for d, _ in rows], pairs)
    count = dict.fromkeys(range(len(rows)), 0)
    for i, j in pairs:
        count[i] += 1
        count[j] += 1
    return sorted((d, count[k], least_id[k], d == least_id[k]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_links(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 24))
    rows = [(k, [float(np.float32(x)) for x in (base[rng.integers(30)] + rng.standard_normal(24) * rng.choice([0.02, 0.05, 0.5])) * rng.uniform(0.1, 50)]) for k in range(250)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [None] + [1.0] * 23), (304, [float("nan")] * 24), (305, [float("inf")] * 24), (306, [1.0] * 5), (307, [2.0] * 5)]
    rows += [(310 + k, rows[0][1]) for k in range(20)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, id int, weight string")
    got = sorted(map(tuple, embedding_dedup.links(df, embedding_dedup.Projections(block=32)).collect()))
    assert got == linked(rows)
    assert embedding_dedup.links(df.limit(0)).count() == 0


def test_every_vector_of_a_repeated_id_is_linked(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [None, 1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.links(df).collect())) == linked(rows)


def test_calibration():
    how = embedding_dedup.Projections()
    assert 0 < how.least_count < how.lines and how.sorted_window > how.counted_window > how.distance
