import random
import time

import numpy as np

from riskloom.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame([("an", a, b, 1, "static", i) for i, (a, b) in enumerate(edges)], "analysis_id string, source_id string, target_id string, line long, kind string, row_id long")


def groups(spark, edges, local=G.LOCAL_EDGES):
    out = {}
    for r in G.components(frame(spark, edges), local).collect():
        out.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def brute(edges):
    ids = {x for e in edges for x in e}
    reach = {a: {b for x, b in edges if x == a} for a in ids}
    for k in ids:
        for a in ids:
            if k in reach[a]:
                reach[a] |= reach[k]
    comps = {frozenset([a] + [b for b in ids if b in reach[a] and a in reach[b]]) for a in ids}
    return sorted(sorted(c) for c in comps if len(c) > 1)


def test_shapes(spark):
    assert groups(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c")]) == [["a", "b"], ["c", "d", "e"]]
    assert groups(spark, [("a", "a")]) == [] and groups(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == [] and groups(spark, []) == []


def test_random_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        edges = [(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(18)]
        want = brute(edges)
        rng.shuffle(edges)
        assert groups(spark, edges) == want
    assert groups(spark, edges, 5) == want  # by distributed rounds


def test_many_random_graphs_and_long_ones():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30))})
        first, to = np.searchsorted([a for a, _ in edges], np.arange(n + 1)), np.array([b for _, b in edges], int)
        comp = G.strong_components(first, to)
        got = sorted(sorted(np.flatnonzero(comp == c).tolist()) for c in set(comp.tolist()))
        assert [c for c in got if len(c) > 1] == brute(edges)
    ring = np.arange(200_001)
    assert len(set(G.strong_components(ring, (ring[:-1] + 1) % 200_000).tolist())) == 1


def test_ring_of_100(spark):
    began = time.time()
    edges = [(f"n{i}", f"n{(i + 1) % 100}") for i in range(100)]
    assert groups(spark, edges) == [sorted({a for a, _ in edges})]
    assert time.time() - began < 5


def test_groups_of_several_analyses_and_nulls(spark):
    rows = [("x", "a", "b"), ("x", "b", "a"), ("y", "a", "b"), ("y", None, "a"), ("y", "b", None), (None, "a", "b"), (None, "b", "a"), ("x", "a", "b")]
    df = spark.createDataFrame(rows, "analysis_id string, source_id string, target_id string")
    for local in (0, 100):
        assert sorted(map(tuple, G.components(df, local).collect())) == [("x", "a", "a"), ("x", "a", "b")]
        start = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "a"), (None, "a"), ("z", None)], "analysis_id string, id string")
        assert sorted(map(tuple, G.reach(df, start, local).collect())) == [("x", "a"), ("x", "b"), ("y", "b")]


def test_fans_and_reach(spark):
    df = frame(spark, [("a", "b"), ("c", "b"), ("a", "b"), ("b", "d")])
    assert {r.id: (r.fan_in, r.fan_out) for r in G.fans(df).collect()} == {"a": (0, 2), "b": (3, 1), "c": (0, 1), "d": (1, 0)}
    start = spark.createDataFrame([("an", "a")], "analysis_id string, id string")
    chain = frame(spark, [(chr(97 + i), chr(98 + i)) for i in range(9)])
    assert {r.id for r in G.reach(chain, start, 1).collect()} == set("bcdefghij")
    assert {r.id for r in G.reach(df, start).collect()} == {"b", "d"} and G.reach(df.limit(0), start).count() == 0


def test_layers(spark):
    df = frame(spark, [("web/a", "db/x"), ("web/a", "service/s"), ("service/s", "db/x"), ("db/x", "web/a"), ("other", "db/x"), ("web/a", "web/b")])
    bad = {(r.source_id, r.target_id) for r in G.layer_violations(df, {"web": ["service"], "service": ["db"], "db": []}).collect()}
    assert bad == {("web/a", "db/x"), ("db/x", "web/a")}
