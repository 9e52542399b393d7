import random

import numpy as np
from test_spikes import run

from tidegrid.functions.pursuit import low_rank
from tidegrid.operators import spikes


def shifts(rng, e, days, size=60, noise=2.0):
    """Hourly readings of two shifts by turns, each day at random: narrow peaks at other hours, some of them downwards."""
    hours = ({2: 1, 7: 1, 12: -1, 16: 1, 21: 1}, {4: 1, 9: -1, 14: 1, 18: 1, 23: -1})
    which = [k % 2 for k in range(days)]
    rng.shuffle(which)
    return [[0, e * 10_000 + k, e, 1, k * 3600.0 + 60, float(round(80 + rng.gauss(0, noise) + size * hours[which[k // 24]].get(k % 24, 0))), 1.0, 3600.0] for k in range(24 * days)]


def test_days_of_two_kinds_are_normal_and_spikes_in_them_are_not(spark):
    """No time of day stands out on more than half of the days: only components with a score per day explain the peaks."""
    rng, data, want = random.Random(11), [], set()
    for e in range(8):
        s = shifts(rng, e, 20)
        for k in (5 * 24 + 5, 13 * 24 + 19):  # a peak that neither kind has
            s[k][5] += 60
            want.add(s[k][1])
        k = next(k for k in range(9 * 24, 10 * 24) if s[k][5] > 120)  # a peak that is missing
        s[k][5] -= 60
        want.add(s[k][1])
        data += s
    assert {k for k, r in run(spark, data).items() if r.spike} == want


def test_half_of_the_days_is_no_centre(spark):
    """Spikes at one time on two of four days leave the other two days' readings alone and are found."""
    rng, data, want = random.Random(14), [], set()
    for e in range(8):
        s = [[0, e * 1000 + k, e, 1, k * 3600.0 + 60, float(round(80 + rng.gauss(0, 2))), 1.0, 3600.0] for k in range(96)]
        for k in (24 + 10, 72 + 10):
            s[k][5] += 40
            want.add(s[k][1])
        data += s
    assert {k for k, r in run(spark, data).items() if r.spike} == want


def test_few_common_times(spark):
    """Four days that have only four times in common, two of them in a spike of three readings: the day's level is that of the whole day."""
    rng, data, want = random.Random(15), [], set()
    for e in range(8):
        at = [d * 24 + h for d in range(4) for h in ([2 + d, 7, 9, 11, 13, 15 + d, 20 + d] if d != 2 else [*range(1, 24)])]
        s = [[0, e * 1000 + k, e, 1, k * 3600.0 + 60, float(round(20 + rng.gauss(0, 1.5))), 1.0, 3600.0] for k in at]
        for r in s:
            if r[1] % 1000 in (59, 60, 61):
                r[5] += 45
                want.add(r[1])
        data += s
    assert {k for k, r in run(spark, data).items() if r.spike} == want


def test_cuts_change_no_component(spark, monkeypatch):
    rng = random.Random(12)
    data = [r for e in range(6) for r in shifts(rng, e, 12 + e)]
    for r in rng.sample(data, 20):
        r[5] += 90
    data = rng.sample(data, len(data) * 9 // 10)  # hours without a reading
    found = lambda: {k for k, r in run(spark, data).items() if r.spike}
    whole = found()
    assert 10 <= len(whole) <= 40
    monkeypatch.setattr(spikes, "PIECE", 30)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert found() == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def matrix(rng, rows, cols, rank, share):
    m = rng.standard_normal((rows, cols)) + sum(6 * np.outer(rng.standard_normal(rows), rng.standard_normal(cols)) for _ in range(rank))
    m[rng.random(m.shape) < 0.03] += 50
    return m, rng.random(m.shape) < share


def fit(parts):
    row, col, of_row, of_col, m = [], [], [], [], []
    for k, (a, there) in enumerate(parts):
        r, c = np.nonzero(there)
        row.append(r + len(of_row)), col.append(c + len(of_col)), m.append(a[there])
        of_row += [k] * a.shape[0]
        of_col += [k] * a.shape[1]
    return low_rank(*(np.concatenate(x) for x in (row, col)), np.array(of_row), np.array(of_col), np.concatenate(m), np.ones(len(parts)))


def test_low_rank_part_is_that_of_the_convex_problem():
    rng = np.random.default_rng(3)
    parts = [matrix(rng, *x) for x in ((30, 24, 2, 1.0), (60, 12, 3, 0.8), (20, 48, 1, 0.7), (25, 25, 0, 0.9))]
    got, at = fit(parts), 0
    for m, there in parts:
        n, (rows, cols) = there.sum(), m.shape
        mu = np.sqrt(n / rows) + np.sqrt(n / cols)
        bound, low, centre = mu / np.sqrt(max(rows, cols)), np.zeros(m.shape), np.zeros(cols)
        for _ in range(4000):
            u, s, w = np.linalg.svd(low + there * np.clip(m - centre - low, -bound, bound), full_matrices=False)
            s = np.maximum(s - mu, 0)
            low = (u * s) @ w
            if s[0] > 0:
                centre += (there * np.clip(m - centre - low, -bound, bound)).sum(0) / there.sum(0)
        want = centre + (u * np.sqrt(s * s + 2 * s * mu)) @ w
        assert np.abs(got[at : at + n] - want[there]).max() < 0.5
        assert np.array_equal(fit([(m, there)]), got[at : at + n]) or np.allclose(fit([(m, there)]), got[at : at + n], atol=1e-6)
        at += n
    assert not got[-n:].any()  # scatter and sparse cells alone have no low-rank part


def test_rank_has_no_limit():
    rng = np.random.default_rng(4)
    m = 20 * rng.standard_normal((60, 12)) @ rng.standard_normal((12, 40)) + rng.standard_normal((60, 40))
    got = fit([(m, np.ones(m.shape, bool))]).reshape(m.shape)
    s = np.linalg.svd(got, compute_uv=False)  # the columns' centres are one more
    assert 12 <= (s > 5).sum() <= 13 and np.abs(got - m).mean() < 2


def test_impossible_values_do_not_spoil_a_fit(spark):
    rng = random.Random(13)
    s = shifts(rng, 1, 20)
    s[100][5], s[200][5], s[300][5] = float("inf"), 1e300, -1e9
    got = run(spark, s)
    assert {k for k, r in got.items() if r.spike} >= {s[300][1]} and len([k for k, r in got.items() if r.spike]) <= 3
