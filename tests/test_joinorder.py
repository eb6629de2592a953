"""Enumerators against exhaustive search, on the usual shapes of query graphs."""

import math
import random

import pytest

from sparrowmill.plans import joinorder as jo
from sparrowmill.plans.cardinality import CartesianProduct, Equality, Injected, Relation, Statistics
from sparrowmill.session import Engine

OPTIMAL = ["DPsize", "DPsizeOpt", "DPsizeSub", "DPsub", "DPsubOpt", "DPccp", "TDbasic", "TDMinCutAGaT", "HeuristicSearch"]
HEURISTIC = ["IKKBZ", "LinearizedDP", "GOO", "TDGOO"]
SHAPES = {
    "chain": lambda n: {(i, i + 1) for i in range(n - 1)},
    "cycle": lambda n: {(i, i + 1) for i in range(n - 1)} | {(0, n - 1)},
    "star": lambda n: {(0, i) for i in range(1, n)},
    "clique": lambda n: {(i, j) for i in range(n) for j in range(i + 1, n)},
}


def graph(shape, n, seed):
    rng = random.Random(seed)
    edges = SHAPES[shape](n)
    rows = [rng.randint(10, 10_000) for _ in range(n)]
    sel = {e: rng.uniform(0.0005, 0.5) for e in edges}

    def sizes(s):
        out = math.prod(rows[i] for i in jo.bits(s))
        for (a, b), f in sel.items():
            if s >> a & 1 and s >> b & 1:
                out *= f
        return max(1.0, out)

    return jo.Graph(n, edges, sizes)


def leaves(tree):
    return [tree] if isinstance(tree, int) else leaves(tree[0]) + leaves(tree[1])


def cost(g, tree):
    if isinstance(tree, int):
        return 0.0, 1 << tree
    (a, x), (b, y) = cost(g, tree[0]), cost(g, tree[1])
    return a + b + g.sizes(x | y), x | y


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", range(3))
def test_enumerators(shape, seed):
    g = graph(shape, 6, seed)
    best, _ = jo.order(g, "DPsub")
    for name in OPTIMAL + HEURISTIC:
        c, tree = jo.order(g, name)
        assert sorted(leaves(tree)) == list(range(6)), name
        assert cost(g, tree)[0] == pytest.approx(c), name
        assert c == pytest.approx(best) if name in OPTIMAL else c >= best * (1 - 1e-9), name
    assert jo.order(g, "PEall")[0] <= best * (1 + 1e-9)
    assert jo.order(g, "LinearizedDP")[0] <= jo.order(g, "IKKBZ")[0] * (1 + 1e-9)


def test_dpccp_visits_each_pair_once():
    g = graph("chain", 6, 0)
    assert jo.dp_ccp(g, 63).pairs == (6**3 - 6) // 6


def test_unconnected_graphs_and_unknown_names():
    g = jo.Graph(4, {(0, 1), (2, 3)}, lambda s: float(10 ** s.bit_count()))
    assert sorted(leaves(jo.order(g, "DPccp")[1])) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        jo.order(g, "nope")


def test_search_variants():
    g = graph("cycle", 6, 7)
    best = jo.heuristic_search(g, 63).best[63][0]
    assert jo.heuristic_search(g, 63, "sum").best[63][0] == pytest.approx(best)
    for vertex, heuristic in [("TopDown", "zero"), ("BottomUp", "scaled_sum"), ("BottomUp", "avg_sel"), ("BottomUp", "product"), ("BottomUp", "GOO"), ("TopDown", "sum")]:
        c = jo.heuristic_search(g, 63, heuristic, vertex=vertex).best[63][0]
        assert c >= best * (1 - 1e-9) and (heuristic != "zero" or c == pytest.approx(best))
    assert jo.heuristic_search(g, 63, beam=2).best[63][0] >= best
    with pytest.raises(ValueError):
        jo.heuristic_search(g, 63, "other")


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", range(3))
def test_lazy_pruned_and_anytime_searches(shape, seed):
    g = graph(shape, 6, seed)
    best, first = jo.order(g, "DPsub")[0], jo.heuristic_search(g, 63, "GOO", weight=3.0).best[63][0]
    for vertex in ("BottomUp", "TopDown"):
        for heuristic in ("zero", "sum"):
            for more in ({"lazy": True}, {"prune": True}, {"lazy": True, "prune": True}, {"anytime": 10**9}, {"anytime": 10**9, "prune": True, "lazy": True, "weight": 5.0}):
                t = jo.heuristic_search(g, 63, heuristic, vertex=vertex, **more)
                assert sorted(leaves(t.best[63][1])) == list(range(6)) and t.best[63][0] == pytest.approx(best), more
    for n in (1, 5, 50, 10**9):
        assert best * (1 - 1e-9) <= jo.heuristic_search(g, 63, "GOO", weight=3.0, anytime=n).best[63][0] <= first * (1 + 1e-9)
    assert jo.heuristic_search(g, 63, "GOO", weight=3.0, anytime=10**9).best[63][0] == pytest.approx(best)
    assert jo.heuristic_search(g, 63, beam=1, prune=True).best[63][0] <= jo.goo(g, 63).best[63][0] * (1 + 1e-9)


def test_lazy_search_computes_fewer_heuristics():
    g, counts = graph("cycle", 7, 1), []
    for lazy in (False, True):
        asked = []
        own = jo.HEURISTICS["sum"]
        jo.HEURISTICS["sum"] = lambda *a: asked.append(1) or own(*a)
        try:
            jo.heuristic_search(g, 127, "sum", lazy=lazy)
        finally:
            jo.HEURISTICS["sum"] = own
        counts.append(len(asked))
    assert counts[1] <= counts[0]


def test_estimators(spark):
    r = [Relation("a", "t", 100), Relation("b", "u", 10)]
    eq = [Equality((0, "k"), (1, "k"))]
    assert CartesianProduct().join(r, [0, 1], eq) == 1000
    with pytest.warns(UserWarning):
        assert Injected({"db": [{"relations": ["a"], "size": 7}]}, "db").join(r, [0, 1], eq) == 70
    assert Injected({"db": [{"relations": ["b", "a"], "size": 3}]}, "db").join(r, [0, 1], eq) == 3
    s = Statistics()
    s.learn("t", spark.range(100).selectExpr("id % 10 as k", "id as v"))
    s.learn("u", spark.range(10).selectExpr("id as k"))
    assert s.join(r, [0, 1], eq) == pytest.approx(100, rel=0.2)
    assert s.scan(Relation("a", "t", 0, [("v", "<", 50)])) == pytest.approx(50, rel=0.2)
    assert s.scan(Relation("a", "t", 0, [("k", "=", 5)])) == pytest.approx(10, rel=0.2)


def test_tools():
    import json

    from sparrowmill.plans import tools
    from sparrowmill.sql.parser import parse

    made = tools.fake_cardinalities(["a", "b", "c"], {(0, 1), (1, 2)}, "db", seed=4)
    assert {frozenset(x["relations"]) for x in made["db"]} == {frozenset(x) for x in ("a", "b", "c", "ab", "bc", "abc")} and made == json.loads(json.dumps(made))
    (q,) = parse("SELECT a.x FROM t AS a, t AS b, u AS c WHERE a.k = b.k AND b.j = c.j AND (c.z > 3 OR c.z = 1);")
    got = list(tools.slices(q))
    assert len(got) == 6 and all(parse(x) for x in got) and sum("c.z" in x for x in got) == 3
    g = graph("chain", 4, 1)
    plans = tools.partial_plans(g)
    assert [len(p) for p in plans] == [4, 3, 2, 1] and sorted(leaves(plans[-1][0])) == [0, 1, 2, 3]
    samples = [(i, 2 * i % 7, i * i % 11) for i in range(20)]
    model = tools.TrainedCost.fit(samples, [1 + 2 * a + 3 * b + 4 * c for a, b, c in samples])
    assert model(1, 1, 1) == pytest.approx(10)
    trained = jo.Graph(4, g.edges, g.sizes, model)
    assert jo.order(trained, "DPccp")[0] == pytest.approx(jo.order(trained, "DPsub")[0])


def test_tdgoo_of_large_cliques():
    """Cuts are tried along a spanning tree, so a clique of 24 relations takes no time."""
    import time

    g = jo.Graph(24, {(i, j) for i in range(24) for j in range(i)}, lambda s: float(10 ** s.bit_count()))
    began = time.perf_counter()
    cost, tree = jo.order(g, "TDGOO")
    assert time.perf_counter() - began < 5 and cost > 0


def test_search_options_and_cost_reach_the_search(spark, sf):
    e = Engine(spark, enumerator="HeuristicSearch", search={"heuristic": "sum", "beam": 2})
    for n in ("region", "nation", "customer"):
        e.register(n, spark.read.parquet(f"{sf}/{n}.parquet"))
    text = "SELECT COUNT(*) AS n FROM region, nation, customer WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey"
    assert e.plan(text).graph.tree
    e.options.search = {"heuristic": "none such"}
    with pytest.raises(ValueError):
        e.plan(text)
    seen = []
    e.options.search, e.options.enumerator, e.options.join_cost = None, "DPccp", lambda left, right, out: seen.append(out) or out
    e.plan(text)
    assert seen
    e.options.search = {"beam": 1}
    with pytest.raises(ValueError):
        e.plan(text)
    e.close()


def test_hints_name_the_smallest_table_under_the_limit(spark, sf):
    e = Engine(spark, join_hint="BROADCAST")
    for n in ("nation", "lineitem"):
        e.register(n, spark.read.parquet(f"{sf}/{n}.parquet"))
    text = "SELECT COUNT(*) AS n FROM nation, lineitem WHERE n_nationkey = l_linenumber"
    assert "BROADCAST(`nation`)" in e.plan(text).sql
    e.options.broadcast_bytes = 10
    assert "BROADCAST" not in e.plan(text).sql
    e.close()
