import numpy as np

from tessarine.operators import graph
from tessarine.plans import catalog


def test_walk_returns_of_the_whole_graph(spark):
    rng = np.random.default_rng(8)
    rows = [(f"x{a}", "r", f"x{b}") for a, b in rng.integers(0, 25, (60, 2))] + [("hot", "r", f"x{k}") for k in range(40)] + [("x1", "s", "hot"), ("x1", "s", "x1")]
    names = sorted({n for h, _, t in rows if h != t for n in (h, t)})
    at = {n: i for i, n in enumerate(names)}
    near = np.zeros((len(names), len(names)))
    for h, _, t in rows:
        if h != t:
            near[at[h], at[t]] = near[at[t], at[h]] = 1
    p = near / near.sum(axis=1, keepdims=True)
    want = {(n, k): np.linalg.matrix_power(p, k)[i, i] for n, i in at.items() for k in (2, 3)}
    got = {(r.node, r.step): r.probability for r in graph.walk_returns_by_triangles(spark.createDataFrame(rows, "h string, r string, t string")).collect()}
    assert got.keys() == {k for k, x in want.items() if x > 0} and all(np.isclose(x, want[k]) for k, x in got.items())
    nodes = {r.node for r in catalog.QUERIES["graph_walk_returns"](spark, "/root/testdata/sf0.001").collect()}
    assert {n[0] for n in nodes} >= set("cosp")


def test_walk_returns_in_rounds_without_wedges_of_relations_that_close_no_triangle(spark, monkeypatch):
    """400 orders of 30 parts each made 174,000 pairs of parts, all of them rows of a shuffle, though no part has an edge to another."""
    rng = np.random.default_rng(3)
    rows = [(f"o{i}", "has", f"p{k}") for i in range(400) for k in rng.choice(900, 30, replace=False)]
    rows += [(f"o{i}", "by", f"c{i % 50}") for i in range(400)] + [(f"c{i}", "near", f"c{(i + 1) % 50}") for i in range(50)] + [(f"c{i}", "in", f"n{i // 2 % 9}") for i in range(50)]
    rows = [x for x in rows for _ in range(2)]
    names = sorted({n for h, _, t in rows for n in (h, t)})
    at = {n: i for i, n in enumerate(names)}
    near = np.zeros((len(names), len(names)))
    for h, _, t in rows:
        near[at[h], at[t]] = near[at[t], at[h]] = 1
    p = near / near.sum(axis=1, keepdims=True)
    q = p @ p
    want = {(n, k): x for n, i in at.items() for k, x in ((2, q[i, i]), (3, q[i] @ p[:, i])) if x > 0}
    assert {n[0] for n, k in want if k == 3} == set("cn")
    triples = spark.createDataFrame(rows, "h string, r string, t string")
    monkeypatch.setattr(graph, "_ROUND_ROWS", 5_000, raising=False)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {(r.node, r.step): r.probability for r in graph.walk_returns_by_triangles(triples).collect()}
    assert got.keys() == want.keys() and all(np.isclose(x, want[k]) for k, x in got.items())
    assert written() - before < 1_500_000
