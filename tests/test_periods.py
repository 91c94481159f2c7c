from __future__ import annotations

import random

from cadenza.operators.periods import periods_and_gaps

SCHEMA = "k string, start double, end double, kind string, __b int"


def brute(rows, join=250, longest=900_000):
    by = {}
    for k, s, e, *_ in rows:
        if s is None or e is None or s != s or e != e or float("inf") in (s, e):
            continue
        by.setdefault(k or "", []).append((round(min(s, e) * 1000), round(max(s, e) * 1000)))
    out = set()
    for k, iv in by.items():
        iv.sort()
        periods = []
        for s, e in iv:
            if periods and s <= periods[-1][1] + join:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(k, "period", s, e) for s, e in periods}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if b[0] - a[1] <= longest}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in periods_and_gaps(df, ["k"], **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_edges(spark):
    rows = [
        ("a", 1.0, 2.0, "x", 1), ("a", 2.25, 3.0, "x", 1), ("a", 3.251, 4.0, "x", 1),  # 250 ms joins, 251 does not
        ("a", 6.0, 5.0, "x", 1), ("a", 5.2, 5.2, "x", 1),  # reversed, nested of no length
        ("a", None, 9.0, "x", 1), ("a", 9.0, float("nan"), "x", 1), ("a", 1.0, float("inf"), "x", 1),
        ("a", 1.0, 2.0, "x", 1),  # repeated
        (None, 7.0, 7.0, None, None),
        ("b", 0.0, 1.0, "x", 1), ("b", 901.0, 902.0, "x", 1), ("b", 1802.001, 1803.0, "x", 1),  # 900 s listed, 900.001 not
    ]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_stretches_join(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), s := round(r.uniform(0, 400), 3), round(s + r.choice([0, 0.1, 1, 90]), 3), "", 0) for _ in range(300)]
    for stretch in (1_000, 20_000, 3_600_000):
        assert run(spark, rows, stretch_ms=stretch) == brute(rows)
