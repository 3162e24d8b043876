"""Graph operators over edge tables against one graph on the driver and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.operators.graphs import CausalGraph, adjustment_sets, closure, cyclic_core, cycles, degrees, front_door_sets, levels, paths_avoiding, reachable, verified_adjustment

EDGE = "src string, dst string"


def acyclic(seed, n=9, share=0.35):
    rng = np.random.default_rng(seed)
    return [(f"v{i}", f"v{j}") for i in range(n) for j in range(i + 1, n) if rng.random() < share]


def any_graph(seed, n=10, share=0.14):
    rng = np.random.default_rng(seed)
    return [(f"v{i}", f"v{j}") for i in range(n) for j in range(n) if rng.random() < share]


def table(spark, pairs):
    """The edges with nulls, a repeat and columns of clashing names beside them."""
    more = [(None, "v1"), ("v1", None), (None, None), *pairs[:1]]
    return spark.createDataFrame([*pairs, *more], EDGE).selectExpr("*", "'x' as node", "1 as level", "2 as seen", "3 as depth").repartition(3)


def nodes_of(pairs):
    return sorted({v for p in pairs for v in p})


def test_levels(spark):
    for seed in range(2):
        pairs = acyclic(seed)
        got = {r.node: r.level for r in levels(table(spark, pairs)).collect()}
        want = dict.fromkeys(nodes_of(pairs), 0)
        for _ in want:
            for a, b in pairs:
                want[b] = max(want[b], want[a] + 1)
        assert got == want
    mixed = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e"), ("f", "f")]
    got = {r.node: r.level for r in levels(spark.createDataFrame(mixed, EDGE)).collect()}
    assert got == {"a": 0, "b": None, "c": None, "d": None, "e": 1, "f": None}
    assert levels(spark.createDataFrame([], EDGE)).count() == 0
    assert {r.node: r.level for r in levels(spark.createDataFrame([("a", "b"), ("b", "a")], EDGE)).collect()} == {"a": None, "b": None}


def pointed_cycles(pairs):
    """What following each core node's smallest core effect ends in."""
    below = {v: CausalGraph(pairs).descendants(v) for v in nodes_of(pairs)}
    loops = {v for v in below if any(a == v and (b == v or v in below[b]) for a, b in pairs)}
    core = {v for v in below if v in loops or (below[v] & loops and any(v in below[u] for u in loops))}
    point = {v: min(b for a, b in pairs if a == v and b in core) for v in core}
    out = set()
    for v in core:
        for _ in core:
            v = point[v]
        ring, at = [v], point[v]
        while at != v:
            ring.append(at)
            at = point[at]
        k = ring.index(min(ring))
        out |= {(min(ring), i, u) for i, u in enumerate(ring[k:] + ring[:k])}
    return core, out


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    pairs = any_graph(seed)
    core, want = pointed_cycles(pairs)
    edges = table(spark, pairs)
    assert {v for r in cyclic_core(edges).collect() for v in (r.src, r.dst)} == core
    got = {(r.cycle, r.position, r.node) for r in cycles(edges).collect()}
    assert got == want
    for c, i, v in got:  # consecutive places are edges, and the way closes
        ring = sorted((p, u) for k, p, u in got if k == c)
        assert (v, ring[(i + 1) % len(ring)][1]) in pairs


def test_long_ring_and_no_ring(spark):
    ring = [(f"{i:03d}", f"{(i + 1) % 37:03d}") for i in range(37)] + [("tail", "005"), ("005", "zz")]
    got = cycles(spark.createDataFrame(ring, EDGE)).collect()
    assert sorted((r.position, r.node, r.cycle) for r in got) == [(i, f"{i:03d}", "000") for i in range(37)]
    assert cycles(table(spark, acyclic(5))).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_paths_avoiding(spark, seed):
    pairs = any_graph(seed, share=0.2)
    names, rng, graph = nodes_of(pairs), np.random.default_rng(seed), CausalGraph(pairs)
    asked = [(q, *rng.choice(names, 2).tolist(), rng.choice(names, rng.integers(0, 4), replace=False).tolist()) for q in range(60)]
    questions = spark.createDataFrame([a[:3] for a in asked] + [(100, "gone", "v1"), (101, None, "v1"), (None, "v1", "v2"), (0, *asked[0][1:3])], "question int, x string, y string")
    avoided = spark.createDataFrame([(a[0], z) for a in asked for z in [*a[3], None]], "question int, node string")
    got = paths_avoiding(table(spark, pairs), questions, avoided).collect()
    assert {r.question: r.connected for r in got} == {q: graph.has_path(x, y, z) for q, x, y, z in asked} | {100: False, 101: False} and len(got) == 62
    free = {r.question: r.connected for r in paths_avoiding(table(spark, pairs), questions).collect()}
    assert free == {q: graph.has_path(x, y) for q, x, y, _ in asked} | {100: False, 101: False}


def test_front_door_sets(spark):
    graphs = {s: acyclic(s, 7, 0.3) for s in range(4)} | {90: [("U", "X"), ("U", "Y"), ("X", "M"), ("M", "Y")], 91: [("X", "A"), ("X", "B"), ("A", "Y"), ("B", "Y"), ("U", "X"), ("U", "Y")], 92: [("X", "Y"), ("X", "M"), ("M", "Y")]}
    pairs = [(f"{s}{a}", f"{s}{b}") for s, edges in graphs.items() for a, b in edges]
    asked = [(f"{s}{x}", f"{s}{y}") for s, edges in graphs.items() for x in nodes_of(edges) for y in nodes_of(edges)]
    questions = spark.createDataFrame([(f"{x}>{y}", x, y) for x, y in asked] + [(None, "90X", "90Y"), ("?", "gone", "90Y"), ("90X>90Y", "90X", "90Y")], "question string, x string, y string")
    got = sorted((r.question, r.node) for r in front_door_sets(table(spark, pairs), questions).collect())
    assert got == sorted((f"{x}>{y}", v) for x, y in asked for v in CausalGraph(pairs).front_door(x, y) or ())
    assert ("90X>90Y", "90M") in got and ("91X>91Y", "91A") in got and ("91X>91Y", "91B") in got


@pytest.mark.parametrize("pairs", [acyclic(1, 7), any_graph(3, 7, 0.2)])
def test_adjustment(spark, pairs):
    graph, names = CausalGraph(pairs), nodes_of(pairs)
    asked = [(f"{x}>{y}", x, y) for x in names for y in names if x != y] + [("?", "gone", "v0")]
    questions = spark.createDataFrame([*asked, asked[0]], "question string, x string, y string")
    got = {r.question: r.verified for r in verified_adjustment(table(spark, pairs), questions).collect()}
    assert got == {q: graph.backdoor(x, y, "verified") is not None for q, x, y in asked}
    sets = sorted((r.question, r.node) for r in adjustment_sets(table(spark, pairs), questions).collect())
    assert sets == sorted((q, v) for q, x, y in asked for v in graph.backdoor(x, x) or ())


def test_degrees(spark):
    pairs = [("a", "b"), ("a", "b"), ("c", "b"), ("b", "d")]
    got = sorted(map(tuple, degrees(spark.createDataFrame([*pairs, (None, "d")], EDGE)).collect()))
    assert got == [("a", 0, 1, None), ("b", 2, 1, None), ("c", 0, 1, None), ("d", 1, 0, "b")]


def test_long_chain_keeps_its_plan_small(spark):
    chain = spark.range(60).select(F.format_string("%04d", "id").alias("src"), F.format_string("%04d", F.col("id") + 1).alias("dst"))
    before = set(scratch._live)
    got = reachable(chain, spark.createDataFrame([("0000",)], "node string"))
    plan = got._jdf.queryExecution().analyzed().collectLeaves().size()
    assert plan <= 16 and len(set(scratch._live) - before) <= 16
    assert got.where("cast(node as int) = depth").count() == 61
    ring = chain.unionByName(spark.createDataFrame([("0060", "0000")], EDGE))
    assert closure(ring, spark.createDataFrame([("0007",)], "node string"), above=True).count() == 61
