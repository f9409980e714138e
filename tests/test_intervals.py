"""Periods and gaps against a plain sweep, and their edge cases."""

import random

import pytest

from foliospark.operators.intervals import interval_gaps, interval_periods

SCHEMA = "k string, s bigint, e bigint, lo bigint, hi bigint, gap_start string, _carry int"


def sweep(rows, bounded):
    by = {}
    for k, s, e, lo, hi, *_ in rows:
        if s is None or e is None or e <= s:
            continue
        if bounded:
            if lo is None or hi is None:
                continue
            s, e = max(s, lo), min(e, hi)
            if e <= s:
                continue
        by.setdefault(k, []).append((s, e, lo, hi))
    periods, gaps = set(), set()
    for k, own in by.items():
        own.sort()
        merged = []
        for s, e, *_ in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        periods |= {(k, a, b) for a, b in merged}
        gaps |= {(k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
        if bounded:
            lo, hi = own[0][2], own[0][3]
            if merged[0][0] > lo:
                gaps.add((k, lo, merged[0][0]))
            if merged[-1][1] < hi:
                gaps.add((k, merged[-1][1], hi))
    return periods, gaps


def cases(seed, n, bounded):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    out = []
    for _ in range(n):
        k = r.choice(keys)
        s = r.choice([None, r.randint(-20, 220)]) if r.random() < 0.05 else r.randint(-20, 220)
        e = None if r.random() < 0.03 or s is None else s + r.choice([-3, 0, 1, 1, 2, 5, 30])
        out.append((k, s, e, 0 if bounded else None, 200 if bounded else None, "x", 1))
    return out + out[: n // 10]


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_against_sweep(spark, bounded, buckets):
    for seed in (1, 2):
        rows = cases(seed, 60, bounded)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        bounds = ("lo", "hi") if bounded else (None, None)
        periods, gaps = sweep(rows, bounded)
        assert {tuple(r) for r in interval_periods(df, ["k"], "s", "e", *bounds, buckets=buckets).collect()} == periods
        found = [tuple(r) for r in interval_gaps(df, ["k"], "s", "e", *bounds, buckets=buckets).collect()]
        assert len(found) == len(set(found)) and set(found) == gaps


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert interval_gaps(empty, ["k"], "s", "e", "lo", "hi").count() == 0
    assert interval_periods(empty, ["k"], "s", "e").count() == 0
    # Touching intervals leave no gap, a microsecond does.
    df = spark.createDataFrame([("a", 0, 5, 0, 10, "", 0), ("a", 5, 7, 0, 10, "", 0), ("a", 8, 10, 0, 10, "", 0)], SCHEMA)
    assert [tuple(r) for r in interval_gaps(df, ["k"], "s", "e", "lo", "hi").collect()] == [("a", 7, 8)]
    # Null bounds, or nothing left inside them: no rows.
    df = spark.createDataFrame([("a", 0, 5, None, 10, "", 0), ("b", 0, 5, 20, 30, "", 0)], SCHEMA)
    assert interval_gaps(df, ["k"], "s", "e", "lo", "hi").count() == 0


def test_plan_has_no_product(spark):
    df = spark.createDataFrame(cases(3, 30, True), SCHEMA)
    plan = interval_gaps(df, ["k"], "s", "e", "lo", "hi")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
