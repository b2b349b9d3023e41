import random
from collections import Counter

from riskloom.operators.hot_keys import eager_join_aggregate, heavy_keys, key_shares


def test_eager_aggregate_equals_joined_rows(spark):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), "z") for _ in range(400)]
    right = [(rng.choice(["a", "b", "c", None]), 7) for _ in range(50)]
    l, r = spark.createDataFrame(left, "k string, f string, v long, n string"), spark.createDataFrame(right, "k string, n long")
    n, s, m = Counter(), {}, {}
    for k, f, v, _ in left:
        for k2, _ in right:
            if k is not None and k == k2:
                n[f] += 1
                if v is not None:
                    s[f] = s.get(f, 0) + v
                    m[f] = max(m.get(f, v), v)
    got = {x.f: x for x in eager_join_aggregate(l, r, ["k"], ["f"], ["v"], ["v"]).collect()}
    assert {f: x.joined_rows for f, x in got.items()} == dict(n) and all(got[f].sum_v == s[f] and got[f].max_v == m[f] for f in s)
    assert eager_join_aggregate(l.limit(0), r, ["k"], ["f"], ["v"]).count() == 0
    only_nulls = spark.createDataFrame([("a", "x", None)], "k string, f string, v long")
    assert eager_join_aggregate(only_nulls, r, ["k"], ["f"], ["v"]).first().sum_v is None


def test_shares_and_threshold_ties(spark):
    rows = [("hot",)] * 50 + [("edge",)] * 3 + [("below",)] * 2 + [(None,)] * 45
    df = spark.createDataFrame(rows, "total string")
    other = spark.createDataFrame([("hot",), ("hot",), ("else",), (None,)], "total string")
    joins = {"t": (df, other, ["total"], "total")}
    assert {r.key_value for r in heavy_keys(joins, 3).collect()} == {"hot", "edge"}
    shares = key_shares(joins).collect()
    assert sum(r.n for r in shares) == 100 and {r.key_value: r.joined_rows for r in shares} == {"hot": 100, "edge": 0, "below": 0, None: 0}
    assert heavy_keys({"t": (df.limit(0), other, ["total"], "total")}).count() == 0
    clash = spark.createDataFrame([("a", "b", "c")] * 4, "rows string, joined_rows string, n string")
    assert [tuple(r)[:4] for r in key_shares({"t": (clash, clash, ["rows", "n"], "joined_rows")}).collect()] == [("t", "b", 4, 16)]
