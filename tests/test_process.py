import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.operators import process as P

DAY = 86_400_000
SCHEMA = "analysis_id string, hash string, file_path string, author string, ts long, added long, deleted long, message string, n_files long, now long"


def changes(spark, rows):
    """rows of (hash, file, author, day, lines, message)."""
    n, now = {}, max((r[3] for r in rows), default=0) * DAY
    for r in rows:
        n[r[0]] = n.get(r[0], 0) + 1
    return spark.createDataFrame([("an", h, f, a, d * DAY, l, 0, m, n[h], now) for h, f, a, d, l, m in rows], SCHEMA)


def entropy(spark, lines, **kw):
    rows = [(f"c{i}", "f.py", "a", 0, l, "") for i, l in enumerate(lines)]
    got = P.change_entropy(changes(spark, rows), **kw).collect()
    return got[0].entropy if got else None


def test_entropy_values(spark):
    assert entropy(spark, [5, 5]) == pytest.approx(1.0) and entropy(spark, [7]) == 0.0 and entropy(spark, [0]) is None
    for n in (3, 4):
        assert entropy(spark, [2] * n) == pytest.approx(math.log2(n))
    old = changes(spark, [("c1", "f.py", "a", 0, 5, ""), ("c2", "f.py", "a", 190, 5, "")])
    assert P.change_entropy(old, 90).first().entropy == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=12))
def test_entropy_is_bounded(spark, lines):
    h = entropy(spark, lines)
    p = [x / sum(lines) for x in lines]
    assert 0 <= h <= math.log2(len(lines)) + 1e-9 and h == pytest.approx(-sum(x * math.log2(x) for x in p), abs=1e-9)


def test_features(spark):
    rows = [("c1", "f.py", "alice", 0, 80, "fix null"), ("c2", "f.py", "bob", 30, 10, "add"), ("c3", "f.py", "carol", 40, 10, None), ("c3", "g.py", "carol", 40, 0, None)]
    got = {r.file_path: r for r in P.jit_features(changes(spark, rows)).collect()}
    f = got["f.py"]
    assert (f.revisions, f.distinct_committers, f.lines_added, f.bug_fix_commits, f.recent_commits) == (3, 3, 100, 1, 2)
    assert f.owner_contribution == pytest.approx(0.8) and f.avg_files_per_commit == pytest.approx(4 / 3) and f.age_days == 40
    assert P.jit_features(changes(spark, rows), age_mode="last").where("file_path = 'f.py'").first().age_days == 0
    assert got["g.py"].entropy == 0 and got["g.py"].owner_contribution == 0
    minor = changes(spark, [(f"c{i}", "f.py", a, 0, n, "") for i, (a, n) in enumerate([("a", 90), ("b", 4), ("c", 4), ("d", 1)])])
    assert P.jit_features(minor).first().minor_contributors == 3
    assert P.jit_features(minor.limit(0)).count() == 0


def test_co_changes(spark):
    rows = [("1", "a", "x", 0, 1, ""), ("1", "b", "x", 0, 1, ""), ("2", "b", "x", 0, 1, ""), ("2", "a", "x", 0, 1, ""), ("3", "a", "x", 0, 1, ""), ("3", "c", "x", 0, 1, ""), ("4", "z", "x", 0, 1, "")]
    pairs = P.co_changes(changes(spark, rows))
    assert {(r.file_a, r.file_b): r.n for r in pairs.collect()} == {("a", "b"): 2, ("a", "c"): 1}
    assert [(r.with_file, r.place) for r in P.co_changes_by_file(pairs).where("file_path = 'a'").orderBy("place").collect()] == [("b", 1), ("c", 2)]


def test_average_lines(spark):
    rows = [("1", "a", "x", 0, 7, ""), ("1", "b", "x", 0, 2, "")]
    assert {r.added for r in P.average_lines(changes(spark, rows)).collect()} == {4}
    assert random
