import random
import statistics

from tidegrid.operators import impute
from tidegrid.operators.impute import mean_matching

SCHEMA = "rid BIGINT, entity BIGINT, grp BIGINT, t DOUBLE, period DOUBLE, y DOUBLE, cell STRING, d STRING, e STRING"


def run(spark, data):
    return {r.rid: r for r in mean_matching(spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)).collect()}


def test_every_missing_row_gets_a_real_donor_near_the_truth(spark):
    rng = random.Random(3)
    data, truth, rid = [], {}, 0
    for e in range(30):
        level = rng.uniform(60, 140)
        for k in range(40):
            rid += 1
            y = round(level + rng.gauss(0, 3))
            if rng.random() < 0.1:
                truth[rid] = y
                y = None
            data.append((rid, e, 1, k * 60.0, 60.0, None if y is None else float(y)))
    got = run(spark, data)
    by = {r[0]: r[5] for r in data}
    assert got.keys() == truth.keys()
    assert all(by[g.donor_rid] == g.fill for g in got.values())
    miss = statistics.mean(abs(got[r].fill - y) for r, y in truth.items())
    whole = statistics.mean(v for v in by.values() if v is not None)
    assert miss < 0.35 * statistics.mean(abs(whole - y) for y in truth.values())


def test_no_entity_no_donor_one_donor_constant(spark):
    got = run(spark, [(1, None, 1, 0.0, 60.0, None), (2, 5, 1, 0.0, 60.0, 7.0), (3, 5, 2, 0.0, 60.0, None), (4, 6, 3, None, None, None), (5, 6, 3, 1.0, 60.0, 2.0), (6, 7, 3, 2.0, 60.0, 2.0), (7, 5, None, 0.0, 60.0, None)])
    assert got[1].fill == 7.0 and got[1].donor_rid == 2
    assert got[3].fill is None and got[3].donor_rid is None
    assert got[4].fill == 2.0
    assert set(got) - {7} == {1, 3, 4}


def test_empty_and_complete(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1, 1, 0.0, 60.0, 3.0)]) == {}


def test_brute_force_range_search(spark):
    """Without predictors every prediction is the group's mean: any observed row of the group may give."""
    got = run(spark, [(k, None, k % 2, 0.0, 60.0, float(k) if k < 20 else None) for k in range(30)])
    assert len(got) == 10 and all(g.donor_rid % 2 == g.grp and g.fill == g.donor_rid for g in got.values())


def test_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    data = [(k, rng.randint(0, 20), rng.randint(1, 3), rng.randint(0, 40) * 60.0, 60.0, None if rng.random() < 0.2 else float(rng.randint(50, 90))) for k in range(600)]
    data += [(1000 + k, None, 4, None, None, None if k == 7 else 1.0) for k in range(40)]
    whole = {k: (r.fill, r.donor_rid) for k, r in run(spark, data).items()}
    monkeypatch.setattr(impute, "PIECE", 9)
    assert {k: (r.fill, r.donor_rid) for k, r in run(spark, data).items()} == whole and all(f is not None for f, _ in whole.values())


def test_one_faulty_reading_does_not_blur_the_donors(spark):
    """Each level has donors of its own prediction; a single impossible reading elsewhere must not make them interchangeable."""
    data, want = [(0, 999, 1, 0.0, 60.0, 99999.0)], {}
    for e in range(40):
        for k in range(12):
            rid = len(data)
            gap = k == 5
            if gap:
                want[rid] = 36.0 + e / 10
            data.append((rid, e, 1, k * 60.0, 60.0, None if gap else 36.0 + e / 10))
    got = run(spark, data)
    assert got.keys() == want.keys() and all(abs(got[r].fill - y) < 0.051 for r, y in want.items())
    assert len({g.donor_rid for g in got.values()}) >= 35


def test_neighbours_across_the_ends_of_blocks(spark):
    """The reading one period earlier lies in the block before; the entity's level tells it from the others."""
    data, want = [], {}
    for e in range(30):
        for k in (22, 23, 24):
            rid = len(data)
            if k == 24:
                want[rid] = 50.0 + e
            data.append((rid, e, 1, k * 60.0, 60.0, None if k == 24 else 50.0 + e))
    got = run(spark, data)
    assert got.keys() == want.keys() and all(abs(got[r].fill - y) <= 1.0 for r, y in want.items())
