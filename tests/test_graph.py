"""Ranks by pushes against power iteration; names with many owners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators.graph import entity_context, push_pagerank, resolve_targets, trails


def exact(n, edges, seeds, d=0.85):
    p = np.zeros(n)
    p[seeds] = 1 / len(seeds)
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[b, a] += max(w, 0)
    total = m.sum(0)
    m = np.where(total > 0, m / np.where(total > 0, total, 1), p[:, None])  # what has no edges goes back to the seeds
    r = p.copy()
    for _ in range(400):
        r = (1 - d) * p + d * m @ r
    return r


@pytest.mark.parametrize("error", [1e-3, 1e-5])
def test_within_the_bound(spark, error):
    rng = np.random.default_rng(7)
    n = 60
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n - 8, 250), rng.integers(0, n, 250), rng.integers(1, 4, 250))] + [(0, int(i), 1.0) for i in range(1, n)] + [(3, 3, 1.0)]
    sets = {"a": [1, 2, 3], "b": [59], "hub": [0], "all": list(range(n))}
    e = spark.createDataFrame(edges + edges[:5], "src int, dst int, weight double")
    s = spark.createDataFrame([(k, i) for k, ids in sets.items() for i in ids] + [("a", 1)], "set string, id int")
    ranks, left = push_pagerank(e, s, error=error)
    residual = {r["set"]: r["residual"] for r in left.collect()}
    got = {(r["set"], r["id"]): r["score"] for r in ranks.collect()}
    for k, ids in sets.items():
        want = exact(n, edges + edges[:5], ids)
        for i in range(n):
            assert -1e-9 <= want[i] - got.get((k, i), 0.0) <= residual[k] + 1e-9
        assert residual[k] < n * error + 1e-12 and sum(v for (a, _), v in got.items() if a == k) + residual[k] == pytest.approx(1)


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "src int, dst int, weight double")
    s = spark.createDataFrame([("a", 1), ("a", 2)], "set string, id int")
    ranks, left = push_pagerank(none, s, error=1e-4)
    assert {r["id"]: round(r["score"], 3) for r in ranks.collect()} == {1: 0.5, 2: 0.5} and left.first()["residual"] < 2e-4
    ranks, left = push_pagerank(none, s.where("false"))
    assert ranks.count() == left.count() == 0


def test_names_with_many_owners(spark):
    """A name of many nodes multiplies nothing and is not taken for one of them."""
    nodes = [(f"f{i}.py:get", "get", f"f{i}.py") for i in range(300)] + [("g.py:A.run", "run", "g.py"), ("g.py:B.run", "run", "g.py"), ("h.py:only", "only", "h.py"), ("h.py:only", "only", "h.py")]
    calls = [(f"c{i}.py:main", "get", "CALLS") for i in range(300)] + [("f7.py:main", "x.get", "CALLS"), ("g.py:main", "run", "CALLS"), ("z.py:m", "lib.only", "CALLS"), ("z.py:m", "f9.py:get", "CALLS"), ("z.py:m", "print", "CALLS")]
    n = spark.createDataFrame(nodes, "id string, name string, file_path string")
    found, rest = resolve_targets(spark.createDataFrame(calls, "src string, dst string, relation string"), n)
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == [("f7.py:main", "f7.py:get"), ("z.py:m", "f9.py:get"), ("z.py:m", "h.py:only")]
    owners = {(r["src"], r["dst"]): r["owners"] for r in rest.collect()}
    assert len(owners) == 302 and owners["c5.py:main", "get"] == 300 and owners["g.py:main", "run"] == 2 and owners["z.py:m", "print"] == 0
    assert rest.where(F.col("owners") == 300).count() == 300


def walks(edges, seed, depth):
    """Ends of walks that repeat no edge, in plain Python; every edge has its own number."""
    out, now = [], [(seed, ())]
    for d in range(1, depth + 1):
        now = [(b if a == at else a, (*path, k), r) for at, path, *_ in now for k, (a, b, r) in enumerate(edges) if at in (a, b) and k not in path]
        out += [(d, v, r) for v, _, r in now]
    return out


@pytest.mark.parametrize("limit", [3, 1000])
def test_context_of_parallel_edges_loops_and_hubs(spark, limit):
    edges = [("h", f"n{i:02d}", "R") for i in range(12)] + [("h", "n00", "R"), ("n00", "h", "R"), ("h", "h", "L"), ("n01", "n02", "S"), ("n03", "x", "S"), ("n03", "x", "S"), ("y", "z", "S")]
    e = spark.createDataFrame(edges, "src string, dst string, relation string")
    names = sorted({x for a, b, _ in edges for x in (a, b)} - {"n05"})
    n = spark.createDataFrame([(x, x.upper()) for x in names], "id string, label string")
    for seed, depths in (("h", (1, 2, 3)), ("x", (3,)), ("nosuch", (2,))):
        for depth in depths:
            want = sorted((d, v, r) for d, v, r in walks(edges, seed, depth) if v in names)[:limit]
            got = [(r["distance"], r["connected_id"], r["relationship"]) for r in entity_context(n, e, seed, depth, limit).collect()]
            assert got == want, (seed, depth)
    if limit == 3:
        seeds = spark.createDataFrame([("h",), ("x",)], "seed string")
        assert [t.count() for t in trails(e, seeds, 2)] == [sum(d == k for s in "hx" for d, *_ in walks(edges, s, 2)) for k in (1, 2)]
