import math
import random

from tidegrid.operators.grid_fill import regular_grid

SCHEMA = "stay BIGINT, item BIGINT, at DOUBLE, v DOUBLE, p DOUBLE, slot STRING, a STRING, n STRING"


def run(spark, data, **kw):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    return {(r.stay, r.item, r.slot): r for r in regular_grid(df, "stay", "item", "at", "v", "p", **kw).collect()}


def test_cases_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.randint(1, 2), rng.randint(1, 2), float(rng.randint(-3000, 90000)), rng.choice([1.0, 2.0, None, float("nan")]), 60.0) for _ in range(400)]
    have = {}
    for s, i, t, v, p in data:
        if v is not None and v == v:
            have.setdefault((s, i), set()).add(math.floor(t / p))
    want = set()
    for (s, i), slots in have.items():
        o = sorted(slots)
        for a, b in zip(o, o[1:]):
            if b - a > 1 and (b - a) * 60 <= 1800:
                want |= {(s, i, k) for k in range(a + 1, b)}
    got = run(spark, data, max_gap_s=1800.0, block_slots=7)
    assert {k for k, r in got.items() if r.filled} == want
    assert {k for k, r in got.items() if not r.filled} == {(s, i, k) for (s, i), x in have.items() for k in x}


def test_fill_follows_season_and_meets_endpoints(spark):
    f = lambda k: 80 + 10 * math.sin(2 * math.pi * (k + 0.5) / 24) + 0.1 * k
    gone = {30, 31, 32, 33, 34, 60, 61}
    got = run(spark, [(1, 1, k * 3600.0 + 5, f(k), 3600.0) for k in range(96) if k not in gone])
    assert max(abs(got[1, 1, k].value - f(k)) for k in gone) < 1.0
    assert all(got[1, 1, k].n_readings == 0 for k in gone)


def test_nulls_repeats_empty(spark):
    got = run(spark, [(1, 1, 0.0, 4.0, 60.0), (1, 1, 0.0, 4.0, 60.0), (1, 1, 30.0, 10.0, 60.0), (None, 1, 0.0, 1.0, 60.0), (1, None, 0.0, 1.0, 60.0), (1, 1, None, 1.0, 60.0), (1, 1, 1.0, None, 60.0), (1, 1, 1.0, 1.0, 0.0), (1, 1, 1.0, 1.0, None), (2, 1, 120.0, 3.0, 60.0), (2, 1, 0.0, 1.0, 60.0)])
    assert {k: (r.value, r.n_readings, r.filled) for k, r in got.items() if k[0] == 1} == {(1, 1, 0): (6.0, 3, False)}
    assert 1.0 < got[2, 1, 1].value < 3.0 and got[2, 1, 1].filled
    assert run(spark, []) == {}
