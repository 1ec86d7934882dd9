import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ocelens.functions import canonical
from ocelens.functions.attributes import float_text, variant_value
from ocelens.functions.ordering import with_neighbours, with_rank, with_rank_in_group
from ocelens.operators import graph


def test_rank_and_neighbours_match_a_plain_sort_on_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(7)
    ordered = sorted(rows)
    got = {r.i: r for r in with_rank(df, ["g", "t", "i"]).collect()}
    assert [got[r[2]]["rank"] for r in ordered] == list(range(len(rows)))
    starts, position, before = {}, {}, {}
    for k, r in enumerate(ordered):
        starts.setdefault(r[0], k)
        position[r[2]] = k - starts[r[0]]
        before[r[2]] = ordered[k - 1][2] if position[r[2]] else None
    ranked = with_rank_in_group(df, ["g"], ["t", "i"]).collect()
    assert {r.i: r.position for r in ranked} == position
    placed = with_neighbours(df, ["g"], ["t", "i"], previous="p", following="n", carry=["i"]).collect()
    assert {r.i: r.p and r.p.i for r in placed} == before
    assert {r.n.i: r.i for r in placed if r.n} == {k: v for k, v in before.items() if v is not None}


def _reachable(edges):
    out = set()
    for u, v in edges:
        seen, stack = set(), [v]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [b for a, b in edges if a == x]
        if u in seen:
            out.add((u, v))
    return out


def test_cyclic_edges_match_brute_force(spark):
    rng = random.Random(5)
    graphs = {f"g{k}": {(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(rng.randrange(1, 9))} for k in range(30)}
    graphs["big"] = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)}
    graphs["wide"] = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(48)}
    # a tree, chains between cycles, two chains with the same ends, a ladder
    graphs["tree"] = {(f"n{k // 2}", f"n{k}") for k in range(2, 40)}
    graphs["chains"] = {(f"n{k}", f"n{k + 1}") for k in range(20)} | {("n5", "n3"), ("n15", "n11"), ("n0", "n0"), ("n20", "n20")}
    graphs["double"] = {("a", "p"), ("p", "b"), ("a", "q"), ("q", "b"), ("b", "r"), ("r", "a"), ("b", "x"), ("x", "y")}
    graphs["ladder"] = {e for k in range(6) for e in ((f"u{k}", f"u{k + 1}"), (f"v{k}", f"v{k + 1}"), (f"u{k}", f"v{k}"), (f"v{k}", f"u{k + 1}"))}
    graphs["full"] = {(f"n{a}", f"n{b}") for a in range(5) for b in range(5)} | {("n0", "m0")} | {(f"m{a}", f"m{b}") for a in range(4) for b in range(4) if a != b}
    df = spark.createDataFrame([(g, u, v) for g, es in graphs.items() for u, v in es], "g string, u string, v string")
    expected = {(g, u, v) for g, es in graphs.items() for u, v in _reachable(es)}
    assert {tuple(r) for r in graph.cyclic_edges(df.union(df)).select("g", "u", "v").collect()} == expected
    assert graph.cyclic_edges(df.limit(0)).count() == 0


def _counted_writes(monkeypatch, module) -> list:
    writes = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df: writes.append(1) or real(df))
    return writes


@pytest.mark.parametrize("closed", [False, True])
def test_long_paths_and_cycles_take_few_writes(spark, monkeypatch, closed):
    writes = _counted_writes(monkeypatch, graph)
    edges = [("g", k, (k + 1) % 1001 if closed else k + 1) for k in range(1001 if closed else 1000)]
    found = graph.cyclic_edges(spark.createDataFrame(edges, "g string, u int, v int")).count()
    assert found == (1001 if closed else 0)
    assert len(writes) <= 30


def test_nearest_ancestor_over_a_deep_chain_and_a_cycle(spark):
    rows = [("t", "r", None, True)] + [("t", f"c{i}", f"c{i - 1}" if i else "r", i == 3) for i in range(20)]
    rows += [("t", "x", "y", False), ("t", "y", "x", False), ("t", "z", "gone", False)]
    nodes = spark.createDataFrame(rows, "tree string, node string, parent string, marked boolean")
    got = {r.node: r.ancestor for r in graph.nearest_marked_ancestor(nodes).collect()}
    assert got["c2"] == "r" and got["c4"] == got["c19"] == "c3"
    assert got["x"] is got["y"] is got["z"] is None


def test_float_spelling_matches_repr(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.5, 100.0, 1e15, 1e16, 1.25e16, 1e-4, 1.5e-5, 123456789.125, 1e7, 12345678.0, 1e100, 3e-200, -2.5e-7]
    numbers += [round(rng.uniform(-1e9, 1e9), rng.randrange(8)) for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    for r in df.select("i", float_text(F.col("x")).alias("s")).collect():
        assert r.s == repr(numbers[r.i] + 0.0), numbers[r.i]
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double")
    assert bad.select(float_text(F.col("x")).alias("s")).where("s IS NOT NULL").count() == 0


def test_variant_kinds_are_type_strict(spark):
    cases = {"true": ("boolean", "true"), "1": ("integer", "1"), "1.0": ("float", "1.0"), '"1"': ("string", "1"),
             '["a"]': ("string_list", '["a"]'), "[]": ("string_list", "[]"), "null": None, "[1]": None, "[null]": None,
             '["a",null]': None, '{"a":1}': None, "1e2": ("float", "100.0")}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    for r in df.select("j", variant_value(F.parse_json("j")).alias("v")).collect():
        assert (tuple(r.v) if r.v else None) == cases[r.j], r.j


def test_canonical_json_matches_compact_sorted_dumps(spark):
    attrs = {"b": ("string", 'é"/\n '), "a": ("integer", "3"), "c": ("string_list", '["x"]'), "d": ("boolean", "true")}
    df = spark.createDataFrame([(attrs,)], "a map<string,struct<kind:string,text:string>>")
    text = df.select(canonical.json_attrs(F.col("a"))).first()[0]
    plain = {"b": 'é"/\n ', "a": 3, "c": ["x"], "d": True}
    assert text == json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_content_digest_ignores_order_and_partitions_but_not_copies(spark, n):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(n)]
    df = spark.createDataFrame(rows, "row_sha256 string")
    digest = lambda d: canonical.content_digest(d).first()["digest"]
    base = digest(df)
    assert digest(df.orderBy(F.desc("row_sha256")).repartition(9)) == base
    assert digest(df.union(df.limit(1))) != base
    # a run's digest is the same beside any other run
    both = df.selectExpr("'a' AS run", "*").union(spark.range(3000).selectExpr("'b'", "sha2(string(id), 256)"))
    assert {r.run: r.digest for r in canonical.content_digest(both, "run").collect()}["a"] == base


def test_small_graphs_are_decided_in_two_writes(spark, monkeypatch):
    rng = random.Random(8)
    graphs = {f"g{k}": {(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 14))} for k in range(40)}
    rows = [(g, u, v) for g, es in graphs.items() for u, v in es] + [("g0", None, 1), ("g0", 1, None)]
    df = spark.createDataFrame(rows, "g string, u int, v int")
    expected = {(g, u, v) for g, es in graphs.items() for u, v in _reachable(es)}
    writes = _counted_writes(monkeypatch, graph)
    assert {tuple(r) for r in graph.cyclic_edges(df).collect()} == expected
    assert len(writes) == 2
    assert {tuple(r) for r in graph.cyclic_edges(df, small=3).collect()} == expected
