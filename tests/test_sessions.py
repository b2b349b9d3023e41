import random

import pandas as pd
import pytest

from riskloom.operators.sessions import _scanner, sessionize


def brute(rows, gap):
    by = {}
    for k, ts, e in rows:
        if k is not None and ts is not None:
            by.setdefault(k, []).append((ts, e))
    out = set()
    for k, events in by.items():
        events.sort(key=lambda x: (x[0], x[1] or ""))
        cur, seen = [], set()
        for ts, e in events:
            if cur and ts - cur[-1][0] > gap:
                out.add((k, cur[0][0], cur[-1][0], cur[-1][0] - cur[0][0], len(cur)))
                cur = []
            if e is None or (ts, e) not in seen:
                cur.append((ts, e))
                seen.add((ts, e))
        out.add((k, cur[0][0], cur[-1][0], cur[-1][0] - cur[0][0], len(cur)))
    return out


def made(seed, n=800):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", "ü", None]), rng.choice([None] + [rng.randint(-3000, 3000)] * 20), rng.choice([None, "e1", "e2"])) for _ in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_scan_is_independent_of_batches(size):
    rows = sorted((k, t, e) for k, t, e in made(3) if k is not None and t is not None and e is not None)
    pdf = pd.DataFrame(rows, columns=["k", "ts", "event"])
    batches = (pdf.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(pdf), size))
    out = pd.concat(list(_scanner(10)(batches)))
    assert {(r.k, r.start_ms, r.end_ms, r.end_ms - r.start_ms, r.n_events) for r in out.itertuples()} == brute(rows, 10)
    assert list(out.edge).count(True) == 2


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_equals_brute_force_over_partition_bounds(spark, parts):
    rows = made(7)
    df = spark.createDataFrame([(*r, "x") for r in rows], "who string, ts long, event string, k string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in sessionize(df, "who", "ts", "event", 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows, 10)


def test_plan_settings_do_not_change_the_result(spark):
    rows = made(11, 3000)
    df = spark.createDataFrame(rows, "who string, ts long, event string")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {tuple(r) for r in sessionize(df, "who", "ts", "event", 10).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(rows, 10)


def test_gap_is_inclusive_and_empty(spark):
    df = spark.createDataFrame([("a", 0, "1"), ("a", 10, "2"), ("a", 21, "3")], "who string, ts long, event string")
    assert sorted(tuple(r)[1:3] for r in sessionize(df, "who", "ts", "event", 10).collect()) == [(0, 10), (21, 21)]
    assert sessionize(df.limit(0), "who", "ts", "event", 10).count() == 0
