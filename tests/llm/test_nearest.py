import random

from tidegrid.llm.nearest import nearest_in_time

LS, RS = "stay BIGINT, aid BIGINT, at DOUBLE, _cell STRING", "stay BIGINT, cid BIGINT, ct DOUBLE, _cell STRING"


def run(spark, left, right, tol):
    lf = spark.createDataFrame([(*r, "x") for r in left], LS)
    rt = spark.createDataFrame([(*r, "y") for r in right], RS)
    return sorted((r.aid, r.cid, r.distance) for r in nearest_in_time(lf, rt, "stay", "aid", "at", "cid", "ct", tol).collect())


def brute(left, right, tol):
    out = []
    for s, a, t in left:
        c = [(abs(t - u), u, i) for s2, i, u in right if s is not None and s == s2 and t is not None and u is not None and i is not None and abs(t - u) <= tol]
        if c:
            d, _, i = min(c)
            out.append((a, i, d))
    return sorted(out)


def test_random(spark):
    for seed in range(4):
        rng = random.Random(seed)
        left = [(rng.choice([1, 1, 2, None]), i, float(rng.randint(-50, 300))) for i in range(80)]
        right = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, float(rng.randint(-50, 300))])) for i in range(50)]
        for tol in (3.0, 25.0, 1000.0):
            assert run(spark, left, right, tol) == brute(left, right, tol)


def test_ties_and_edges(spark):
    right = [(1, 9, 0.0), (1, 4, 0.0), (1, 5, 20.0)]
    assert run(spark, [(1, 1, 10.0), (1, 2, 30.0), (1, 3, 30.5), (1, 4, 0.0)], right, 10.0) == [(1, 4, 10.0), (2, 5, 10.0), (4, 4, 0.0)]


def test_empty_and_nan(spark):
    assert run(spark, [], [(1, 1, 1.0)], 5.0) == [] and run(spark, [(1, 1, 1.0)], [], 5.0) == []
    assert run(spark, [(1, 1, float("nan"))], [(1, 1, 1.0)], 5.0) == []


def test_dense_entity(spark):
    """Thousands of times within one tolerance, and lone ones far away."""
    rng = random.Random(7)
    left = [(1, i, rng.uniform(0, 3000)) for i in range(60)] + [(1, 99, 1e6), (1, 98, 1e6 + 900.0)]
    right = [(1, i, rng.uniform(0, 3000)) for i in range(4000)] + [(1, 9000, 1e6 + 999.0)]
    assert run(spark, left, right, 1000.0) == brute(left, right, 1000.0)
