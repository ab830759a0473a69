"""Graph operators against brute force on random graphs."""

import itertools
import random

import numpy as np
import pytest

from pathloom.operators import graphs, kernels
from pathloom.sources.files import example_graph


def edges_of(spark, rows, weights=False):
    return spark.createDataFrame(rows, "src string, dst string" + (", weight double" if weights else "")).repartition(3)


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("src", "dst").collect())


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(3)
    return [(f"a{rng.randrange(14)}", f"a{rng.randrange(14)}") for _ in range(16)] + [("b0", "b1"), ("b1", "b2"), ("b2", "b0"), (None, "x")]


def brute_distances(edges):
    nodes = sorted({v for e in edges if None not in e for v in e})
    out = {}
    for s in nodes:
        front, k, seen = {s}, 0, set()
        while front:
            k += 1
            front = {b for a, b in edges if a in front and a != b and None not in (a, b)} - seen
            seen |= front
            out |= {(s, v): k for v in front if (s, v) not in out}
    return out


def test_distances_and_walks(spark, random_graph):
    edges, want = edges_of(spark, random_graph), brute_distances(random_graph)
    assert {(r["src"], r["dst"]): r["d"] for r in graphs.closure(edges).collect()} == want
    start = spark.createDataFrame([("a1",)], "name string")
    got = {r["name"]: r["d"] for r in graphs.reached(edges, start).collect()}
    assert got == {v: d for (s, v), d in want.items() if s == "a1" and v != "a1"} | {"a1": 0}
    back = {r["name"] for r in graphs.reached(edges, start, True).collect()}
    assert back == {s for (s, v) in want if v == "a1"} | {"a1"}


def test_long_chains_and_cycles_are_seen_whole(spark):
    chain = [(f"v{k:02}", f"v{k + 1:02}") for k in range(24)]
    found, left = graphs.levels(edges_of(spark, chain))
    assert {r["name"]: r["level"] for r in found.collect()} == {f"v{k:02}": k for k in range(25)} and left.isEmpty()
    found, left = graphs.levels(edges_of(spark, [*chain, ("v24", "v12")]))
    assert left.count() == 13 and found.count() == 12
    assert graphs.closure(edges_of(spark, [*chain, ("v24", "v00")])).where("src = dst").agg({"d": "max"}).first()[0] == 25


def test_components_and_properties(spark, random_graph):
    edges = edges_of(spark, random_graph)
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in random_graph:
        if None not in (a, b) and a != b:
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    want = {v: top(v) for v in up}
    assert {r["name"]: r["component"] for r in graphs.components(edges).collect()} == want
    rows = graphs.properties(edges).collect()
    assert [r["n_nodes"] for r in rows] == sorted((list(want.values()).count(c) for c in set(want.values())), reverse=True)
    assert not next(r for r in rows if r["component"] == "b0")["is_dag"] and next(r for r in rows if r["component"] == "b0")["n_edges"] == 3
    giant = max(sorted(set(want.values())), key=list(want.values()).count)
    assert {v for e in pairs(graphs.largest(edges.where("src is not null"))) for v in e} <= {v for v in want if want[v] == giant} | {e[0] for e in random_graph if e[0] == e[1]}


def test_spanning_forest_equals_kruskal(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{a}", f"n{b}", rng.random()) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.3]
    want = set(kernels.spanning({(min(a, b), max(a, b)): w for a, b, w in rows}))
    assert {tuple(r[:2]) for r in graphs.spanning_forest(edges_of(spark, rows, True)).collect()} == want
    both = [("x", "y", 1.0), ("y", "x", 3.0), ("y", "z", 1.5), ("x", "z", 1.8)]  # the mean of x, y is 2
    assert pairs(graphs.spanning_forest(edges_of(spark, both, True))) == [("x", "z"), ("y", "z")]


def test_a_graph_becomes_acyclic(spark):
    rows = [("a", "b", 1.0), ("b", "c", 5.0), ("c", "a", 9.0), ("c", "d", 1.0), ("d", "e", 2.0), ("e", "f", 1.0), ("f", "c", 9.0), ("p", "q", 1.0), ("q", "p", 1.0)]
    found = graphs.dag(edges_of(spark, rows, True))
    # b -> c is the strongest of the cycle a, b, c but for its closing edge, which is no candidate; d -> e that of c, d, e, f
    assert pairs(found) == [("a", "b"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "c")] and graphs.levels(found)[1].isEmpty()
    assert len(pairs(graphs.dag(edges_of(spark, rows, True), True))) == 7
    rng = random.Random(8)
    many = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.random()) for _ in range(26)]
    assert graphs.levels(graphs.dag(edges_of(spark, many, True)))[1].isEmpty()


def test_resizing(spark):
    network = edges_of(spark, [("a", "m"), ("m", "b"), ("a", "k"), ("k", "b"), ("b", "c"), ("x", "y")])
    new = edges_of(spark, [("a", "b"), ("a", "c"), ("c", "a"), ("b", "c")])
    assert sorted(map(tuple, graphs.vouched(new, network).collect())) == [("a", "b", 2), ("b", "c", 1)]
    assert pairs(graphs.mediated(new, network)) == [("a", "k"), ("b", "c"), ("k", "b")]
    weighed = spark.createDataFrame([("a", "m", 0.001), ("m", "b", 0.01), ("a", "k", 0.5), ("k", "b", 0.5)], "src string, dst string, pv double")
    assert pairs(graphs.mediated(new, weighed)) == [("a", "m"), ("m", "b")]
    out = {(r["src"], r["dst"]): r["color"] for r in graphs.resized(edges_of(spark, [("b", "c"), ("c", "z")]), new, network).collect()}
    assert out == {("b", "c"): "gray", ("c", "z"): "gray", ("a", "k"): "green", ("k", "b"): "green"}


def test_orientation_goes_on_along_the_tree(spark):
    undirected = spark.createDataFrame([("c", "d"), ("d", "e"), ("p", "q")], "a string, b string")
    found = {(r["src"], r["dst"]): r["kind"] for r in graphs.directed_by(undirected, edges_of(spark, [("a", "c"), ("b", "c")])).collect()}
    assert found == {("a", "c"): "->", ("b", "c"): "->", ("c", "d"): "->", ("d", "e"): "->", ("p", "q"): "--"}


def test_pathways_are_cleaned(spark):
    ring = [("one", f"id:x{k}", f"id:x{k + 1}") for k in range(6)]
    rows = [*ring, ("one", "id:x0", "id:x0"), ("one", "id:x2", "id:x0"), ("one", "id:x0", "id:x2"), ("two", "id:a", "id:b"), ("one", "id:x0", "id:x1")]
    raw = spark.createDataFrame(rows, "pathway string, src string, dst string")
    names = spark.createDataFrame([("id:x6", "id:z")], "id string, name string")
    labels = spark.createDataFrame([("x0", "first")], "name string, label string")
    pathways, network = graphs.load_pathways(raw, names, labels, "id:")
    assert sorted(r["dst"] for r in pathways.collect()) == ["x1", "x2", "x3", "x4", "x5", "z"] and network.count() == 6
    assert [r["src_label"] for r in network.where("src = 'x0'").collect()] == ["first"]


def test_adjacency_and_dot(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c")])
    names = spark.createDataFrame([(v,) for v in "abcd"], "name string")
    cells = graphs.to_adjacency(edges, names)
    assert cells.count() == 16 and pairs(graphs.from_adjacency(cells)) == [("a", "b"), ("b", "c")]
    assert graphs.dot(edges).first()[0] == 'digraph {\n"a" -> "b";\n"b" -> "c";\n}'
    assert graphs.empty(spark).count() == 0 and graphs.components(graphs.empty(spark)).count() == 0 and graphs.closure(graphs.empty(spark)).count() == 0
    assert example_graph(spark).count() == 20


@pytest.mark.parametrize("seed", range(12))
def test_arborescence_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    p = 5
    w = rng.normal(size=(p, p)).round(1 if seed % 2 else 6)
    best = -np.inf
    for root in range(p):
        rest = [v for v in range(p) if v != root]
        for up in itertools.product(range(p), repeat=p - 1):
            to = dict(zip(rest, up, strict=True))
            if any(a == b for a, b in to.items()):
                continue
            ok = True
            for v in rest:
                seen = set()
                while v != root and ok:
                    ok = v not in seen
                    seen.add(v)
                    v = to[v]
            if ok:
                best = max(best, sum(w[a, b] for b, a in to.items()))
    found = kernels.arborescence(w)
    assert len(found) == p - 1 and sum(w[a, b] for a, b in found) == pytest.approx(best)


@pytest.fixture(params=["one task", "rounds"])
def walked(request, monkeypatch):
    """Graphs are walked in one task, or in rounds as larger ones are."""
    if request.param == "rounds":
        monkeypatch.setattr(graphs, "WALK_EDGES", 0)


def test_both_ways_of_walking_agree_with_brute_force(spark, random_graph, walked):
    edges, want = edges_of(spark, random_graph), brute_distances(random_graph)
    start = spark.createDataFrame([("a1",), ("a1",), ("b0",), ("none",), (None,)], "name string")
    for back in (False, True):
        got = {r["name"]: r["d"] for r in graphs.reached(edges, start, back).collect()}
        ends = [(t, s, d) if back else (s, t, d) for (s, t), d in want.items()]
        near = {v: min(d for s, t, d in ends if t == v and s in ("a1", "b0")) for s, v, _ in ends if s in ("a1", "b0")}
        assert got == near | {"a1": 0, "b0": 0, "none": 0, None: 0}
    found, left = graphs.levels(edges)
    behind = {v for (s, v) in want if (s, s) in want}
    assert {r["name"] for r in left.collect()} == behind
    assert {r["name"] for r in found.collect()} == {v for e in random_graph if None not in e and e[0] != e[1] for v in e} - behind


def deep_chain(spark, n=3000):
    return spark.range(n).selectExpr("concat('s', id) src", "concat('s', id + 1) dst").unionByName(spark.range(1, n).selectExpr("'n' src", "concat('s', id) dst"))


def test_levels_of_a_chain_of_thousands_take_few_jobs(spark):
    """a job a step made acyclic_check run for as many jobs as the longest walk has steps."""
    spark.sparkContext.setJobGroup("deep", "deep")
    found, left = graphs.levels(deep_chain(spark))
    assert left.isEmpty() and found.agg({"level": "max"}).first()[0] == 3000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep")) < 40
    found, left = graphs.levels(deep_chain(spark).unionByName(spark.createDataFrame([("s3000", "s2000")], "src string, dst string")))
    assert left.count() == 1001 and found.count() == 2001
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cells_over_more_names_than_a_block(spark):
    """F8: a matrix of many names, made without a shuffle of its cells."""
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(150)}", f"c{rng.randrange(170)}") for _ in range(900)] + [("c3", "c3"), ("c1", "c2"), ("c1", "c2"), (None, "c5")]
    names = [f"c{k}" for k in range(160)] + ["alone", None]
    found = graphs.to_adjacency(edges_of(spark, rows), spark.createDataFrame([(x,) for x in names], "name string"))
    above = found._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    assert "Join" not in above and "Exchange" not in above and dict(found.dtypes) == {"i": "string", "j": "string", "v": "int"}
    got = found.collect()
    assert len(got) == len(names) ** 2 and {(r["i"], r["j"]) for r in got if r["v"]} == {e for e in rows if e[0] != e[1] and None not in e and e[0] in names and e[1] in names}
    assert len({(r["i"], r["j"]) for r in got}) == len(got)


def test_full_graph_of_more_nodes_than_a_block(spark):
    """F9"""
    rows = [(f"c{k}", f"c{k * 7 % 150}") for k in range(150)]
    got = pairs(graphs.full(edges_of(spark, rows)))
    assert got == sorted((f"c{a}", f"c{b}") for a in range(150) for b in range(150) if a != b)


def test_gaps_of_more_nodes_than_a_block(spark):
    """F10"""
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(140)}", f"c{rng.randrange(140)}") for _ in range(2000)]
    nodes, joined = sorted({v for e in rows for v in e}), {frozenset(e) for e in rows}
    found = graphs.gaps(edges_of(spark, rows))
    assert sorted(map(tuple, found.collect())) == [p for p in itertools.combinations(nodes, 2) if frozenset(p) not in joined]
    assert graphs.gaps(edges_of(spark, rows)).columns == ["x", "y"]
