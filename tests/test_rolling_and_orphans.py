import datetime as dt
import random

from riskloom.operators.commit_refs import resolve
from riskloom.operators.orphans import orphan_rows
from riskloom.operators.rolling import trailing_totals
from riskloom.runtime import join_measured


def test_trailing_totals_equal_brute_force(spark):
    rng = random.Random(2)
    d0 = dt.date(2024, 2, 20)
    rows = [(rng.choice("ab"), d0 + dt.timedelta(days=rng.choice([0, 1, 2, 9, 40, 41, 75])), rng.choice([1, 5, -2, None])) for _ in range(60)] + [(None, d0, 1), ("a", None, 1), ("one", d0, 3)]
    got = {(r.e, r.day): r for r in trailing_totals(spark.createDataFrame([(*r, 0) for r in rows], "e string, d date, v long, value long"), "e", "d", "v").collect()}
    for e in ("a", "b", "one"):
        days = [d for x, d, _ in rows if x == e and d]
        n = (max(days) - min(days)).days + 1
        assert sum(k[0] == e for k in got) == n
        for i in range(n):
            day = min(days) + dt.timedelta(days=i)
            for p in (7, 30):
                want = sum(v or 0 for x, d, v in rows if x == e and d and 0 <= (day - d).days < p)
                assert got[e, day][f"s{p}"] == want and abs(got[e, day][f"avg{p}"] - want / p) < 1e-12
    assert trailing_totals(spark.createDataFrame([], "e string, d date, v long"), "e", "d", "v").count() == 0


def test_short_hashes(spark):
    c = spark.createDataFrame([("g", "abcdef0123456789"), ("g", "abcdef0199999999"), ("g", "ffffffff"), ("g", "ffffffff00"), ("h", "abcdef0123456789")], "analysis_id string, hash string")
    refs = ["abcdef01", "abcdef012", "ffffffff", "ffffffff0", "abcdef0", "nothere99", "", None]
    out = {r.ref: r.hash for r in resolve(spark.createDataFrame([("g", r, 1) for r in refs], "analysis_id string, ref string, x long"), c).collect()}
    assert out["abcdef01"] == "abcdef01" and out["abcdef012"] == "abcdef0123456789" and out["ffffffff"] == "ffffffff" and out["ffffffff0"] == "ffffffff00"
    assert out["abcdef0"] == "abcdef0" and out["nothere99"] == "nothere99" and out[None] is None and len(out) == len(refs)


def test_orphans_equal_brute_force(spark):
    rng = random.Random(9)
    at = lambda: dt.datetime(2024, rng.randint(1, 5), rng.randint(1, 28), rng.randint(0, 23))
    parents = [(rng.choice(["t", "u"]), f"k{rng.randint(0, 60)}", at()) for _ in range(90)]
    refs = [(i, rng.choice(["t", "u"]), rng.choice([f"k{rng.randint(0, 90)}", "hot", "hot", None]), at(), "x") for i in range(900)]
    first = {}
    for t, k, a in parents:
        first[t, k] = min(a, first.get((t, k), a))
    want = {(i, "missing" if (t, k) not in first else "late") for i, t, k, a, _ in refs if k is not None and ((t, k) not in first or first[t, k] > a)}
    r = spark.createDataFrame(refs, "row_id long, bucket string, id string, loaded_at timestamp_ntz, first_at string")
    p = spark.createDataFrame(parents, "bucket string, id string, loaded_at timestamp_ntz")
    got = orphan_rows(r, p, ["bucket", "id"], "loaded_at", join_measured).select("row_id", "state").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert orphan_rows(r.limit(0), p, ["bucket", "id"], "loaded_at", join_measured).count() == 0
    assert orphan_rows(r, p.limit(0), ["bucket", "id"], "loaded_at", join_measured).count() == sum(k is not None for _, _, k, _, _ in refs)
