import random
import time

import numpy as np

from tidegrid.operators.intervals import merge_runs, periods_and_pauses

SCHEMA = "stay BIGINT, a DOUBLE, z DOUBLE, _e STRING, s STRING, _block BIGINT"


def make(spark, data):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in data], SCHEMA)


def brute(data):
    periods, pauses = set(), set()
    for stay in {r[0] for r in data if r[0] is not None}:
        cur = None
        for a, z in sorted((a, z) for s, a, z in data if s == stay and a is not None and z is not None and z > a):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], z)
            else:
                if cur:
                    periods.add((stay, *cur))
                    pauses.add((stay, cur[1], a))
                cur = [a, z]
        if cur:
            periods.add((stay, *cur))
    return periods, pauses


def test_random_against_one_pass(spark):
    for seed in range(4):
        rng = random.Random(seed)
        data = [(rng.randint(1, 3), float(a := rng.randint(0, 400)), float(a + rng.choice([0, 1, 2, 5, 30, 150, -3]))) for _ in range(rng.choice([5, 40, 120]))]
        p, g = periods_and_pauses(make(spark, data), "stay", "a", "z", block_s=17.0)
        got = ([tuple(r) for r in p.collect()], [tuple(r) for r in g.collect()])
        want = brute(data)
        assert set(got[0]) == want[0] and len(got[0]) == len(want[0])
        assert set(got[1]) == want[1] and len(got[1]) == len(want[1])


def test_touching_nested_nulls_repeats(spark):
    n = float("nan")
    data = [(1, 0.0, 10.0), (1, 10.0, 12.0), (1, 13.0, 14.0), (1, 2.0, 3.0), (1, 0.0, 10.0), (None, 0.0, 5.0), (1, None, 9.0), (1, 5.0, None), (1, 9.0, 4.0), (2, 1.0, 1.0), (1, n, 3.0)]
    p, g = periods_and_pauses(make(spark, data), "stay", "a", "z")
    assert {tuple(r) for r in p.collect()} == {(1, 0.0, 12.0), (1, 13.0, 14.0)}
    assert [tuple(r) for r in g.collect()] == [(1, 12.0, 13.0)]


def test_empty(spark):
    p, g = periods_and_pauses(make(spark, []), "stay", "a", "z")
    assert p.count() == 0 and g.count() == 0


def test_merge_of_sorted_runs():
    rng = np.random.default_rng(1)
    g, s, z, rows = [], [], [], []
    for k, runs in enumerate(((0, 5), (40, 7, 1), (3,))):
        for n in runs:
            a = np.sort(rng.choice(500, n, replace=False)).astype(float) * 10
            e = a + rng.integers(1, 30, n)
            g, s, z = [*g, *[k] * n], [*s, *a], [*z, *e]
            rows += [(k, float(x), float(y)) for x, y in zip(a, e)]
    got = merge_runs(np.array(g), np.array(s), np.array(z))
    assert list(zip(*(x.tolist() for x in got))) == sorted(brute(rows)[0])
    none = np.zeros(0)
    assert [len(x) for x in merge_runs(none.astype(int), none, none)] == [0, 0, 0]


def test_many_intervals_of_one_entity_in_one_block(spark):
    df = spark.range(100_000).selectExpr("1L AS stay", "CAST(id * 0.8 AS DOUBLE) AS a", "CAST(id * 0.8 + 0.5 AS DOUBLE) AS z")
    t = time.time()
    p, g = periods_and_pauses(df, "stay", "a", "z")
    assert p.count() == 100_000 and g.count() == 99_999
    assert time.time() - t < 60


def test_text_entity(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 3.0, 4.0), ("b", 0.0, 1.0)], "who STRING, a DOUBLE, z DOUBLE")
    assert [tuple(r) for r in periods_and_pauses(df, "who", "a", "z")[1].collect()] == [("a", 1.0, 3.0)]
