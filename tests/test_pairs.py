import random
from collections import Counter

import pytest

from riskloom.operators.pairs import pair_counts


@pytest.mark.parametrize("chunk", [3, 8, 128])
def test_large_baskets_equal_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows = [("g", "big", f"i{i}", "x") for i in range(60)] + [(rng.choice(["g", "h", None]), rng.choice(["b1", "b2", None]), rng.choice([*(f"i{i}" for i in range(12)), None]), "x") for _ in range(200)]
    baskets = {}
    for g, b, i, _ in rows:
        if g and b and i:
            baskets.setdefault((g, b), set()).add(i)
    want = Counter((g, x, y) for (g, _), items in baskets.items() for x in items for y in items if x < y)
    got = pair_counts(spark.createDataFrame(rows + rows[:30], "analysis string, commit string, file string, n_ab string"), "analysis", "commit", "file", chunk=chunk).collect()
    assert {(r.g, *sorted((r.i1, r.i2))): r.n_ab for r in got} == dict(want) and len(got) == len(want)
