import itertools
import random
from collections import Counter

from riskloom.llm.cooccurrence import together


def brute(rows, least, lift):
    baskets = {}
    for g, b, i in rows:
        if g is not None and b is not None:
            baskets.setdefault((g, b), set()).add(i)
    total, n, both = Counter(), Counter(), Counter()
    for (g, _), items in baskets.items():
        items = sorted(items - {None})
        total[g] += 1
        n.update((g, i) for i in items)
        both.update((g, *p) for p in itertools.combinations(items, 2))
    return {(g, a, b, total[g], n[g, a], n[g, b], k) for (g, a, b), k in both.items() if k >= least and k * total[g] >= lift * n[g, a] * n[g, b]}


def got(spark, rows, least, lift, chunk):
    df = spark.createDataFrame([(*r, "z") for r in rows], "grp string, basket string, thing string, n string")
    return {tuple(r)[:7] for r in together(df, "grp", "basket", "thing", least, lift, chunk).collect()}


def test_equals_brute_force_with_large_baskets_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 1)}", f"b{rng.randint(0, 60)}", f"i{int(rng.expovariate(0.1))}") for _ in range(1500)]
    rows += [("g0", "huge", f"i{i}") for i in range(70)] * 2 + [("g1", "huge", f"i{i}") for i in range(45)]
    rows += [(None, "b", "i1"), ("g0", None, "i1"), ("g0", "only-null", None), ("g0", "é", "ü"), ("g0", "é", "z")]
    for least, lift, chunk in ((1, 0, 8), (3, 0, 1000), (2, 1, 16), (4, 2, 5)):
        assert got(spark, rows, least, lift, chunk) == brute(rows, least, lift)


def test_empty(spark):
    assert got(spark, [], 1, 0, 8) == set()
    assert got(spark, [("g", "b", "i")], 1, 0, 8) == set()
