import random

from tidegrid.operators import spikes

SCHEMA = "src INT, rid BIGINT, e BIGINT, i BIGINT, t DOUBLE, v DOUBLE, step DOUBLE, period DOUBLE, chunk STRING, own STRING"


def run(spark, data, **kw):
    return {r.rid: r for r in spikes.flag_readings(spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA), **kw).collect()}


def series(rng, e, n, level, i=1, noise=3.0):
    return [[0, e * 10_000 + k, e, i, k * 3600.0 + rng.uniform(0, 900), float(round(level + rng.gauss(0, noise))), 1.0, 3600.0] for k in range(n)]


def test_planted_cases_and_nothing_else(spark):
    rng, data, want = random.Random(2), [], set()
    for e in range(40):
        s = series(rng, e, rng.choice([12, 30, 90]), rng.uniform(60, 150))
        k = rng.randrange(1, len(s) - 4)
        for j in range(rng.randint(1, 3)):
            s[k + j][5] += rng.choice([-1, 1]) * 60 if e % 2 else 60
            want.add(s[k + j][1])
        data += s
    shift = series(rng, 90, 60, 80)
    for r in shift[30:]:
        r[5] += 50
    drift = series(rng, 91, 60, 80)
    for k, r in enumerate(drift):
        r[5] += k
    long = series(rng, 92, 60, 80)
    for r in long[20:26]:
        r[5] += 60
    got = run(spark, data + shift + drift + long)
    assert {k for k, r in got.items() if r.spike} == want


def test_stuck_runs_count_readings_and_flag_rows(spark):
    rng = random.Random(4)
    s = series(rng, 1, 40, 100)
    for r in s[10:20]:
        r[5] = 101.0
    s[9][5], s[20][5] = 95.0, 96.0
    short = series(rng, 2, 40, 100)
    for r in short[10:19]:
        r[5] = 101.0
    short[9][5], short[19][5] = 95.0, 96.0
    again = [[0, 5, 2, 1, short[12][4], 101.0, 1.0, 3600.0]]  # the same reading once more
    twice = [[0, 6, 1, 1, s[12][4], 101.0, 1.0, 3600.0]]
    got = run(spark, s + short + again + twice)
    assert {k for k, r in got.items() if r.stuck} == {r[1] for r in s[10:20]} | {6}


def test_short_null_empty(spark):
    rng = random.Random(6)
    s = series(rng, 1, 8, 100)
    s[4][5] = 900.0
    bad = [[0, 70, None, 1, 0.0, 1.0, 1.0, 1.0], [0, 71, 1, None, 0.0, 1.0, 1.0, 1.0], [0, 72, 1, 1, None, 1.0, 1.0, 1.0], [0, 73, 1, 1, 0.0, None, 1.0, 1.0], [0, 74, 1, 1, 0.0, float("nan"), None, None]]
    got = run(spark, s + bad)
    assert not any(r.spike or r.stuck for r in got.values()) and set(got) <= {s[4][1]}
    assert run(spark, []) == {}


def test_cuts_change_nothing(spark, monkeypatch):
    """However the rows are cut into partitions and pieces, flags are the same: few readings a piece, runs and spikes on the cuts."""
    rng = random.Random(8)
    data = []
    for e in range(6):
        s = series(rng, e, 150, 100)
        for k in (2, 47, 48, 95, 120, 147):
            s[k][5] += 70
        for r in s[60:75]:
            r[5] = 99.0
        data += s
    data += [[0, 99_000 + k, *r[2:]] for k, r in enumerate(data[50:80])]  # repeated rows
    flags = lambda: {k: (r.spike, r.stuck) for k, r in run(spark, data).items()}
    whole = flags()
    assert sum(a for a, _ in whole.values()) >= 36 and sum(b for _, b in whole.values()) >= 90
    for piece, parts in ((7, "3"), (40, "16")):
        monkeypatch.setattr(spikes, "PIECE", piece)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert flags() == whole
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sparse_sources(spark):
    """One reading in sixty periods: level, scatter, length and runs are those of the whole source."""
    rng, data, spike, stuck = random.Random(3), [], set(), set()
    for e in range(30):
        s = [[0, e * 1000 + k, e, 1, k * 60 * 3600.0, float(round(100 + rng.gauss(0, 3))), 1.0, 3600.0] for k in range(60)]
        s[20][5] += 80
        spike.add(s[20][1])
        for r in s[40:52]:
            r[5] = 101.0
        s[39][5], s[52][5] = 95.0, 107.0
        stuck |= {r[1] for r in s[40:52]}
        data += s
    got = run(spark, data)
    assert {k for k, r in got.items() if r.spike} == spike and {k for k, r in got.items() if r.stuck} == stuck


def rhythm(rng, e, days, noise=2.0):
    """Hourly readings with the same sharp peak at every noon."""
    return [[0, e * 10_000 + k, e, 1, k * 3600.0 + 60, float(round(80 + rng.gauss(0, noise) + (60 if k % 24 == 12 else 0))), 1.0, 3600.0] for k in range(24 * days)]


def test_daily_rhythm_is_normal_and_spikes_in_it_are_not(spark, monkeypatch):
    rng, data, want = random.Random(5), [], set()
    for e in range(10):
        s = rhythm(rng, e, 12)
        s[5 * 24 + 12][5] -= 60  # a day whose peak is missing
        s[7 * 24 + 3][5] += 60  # a peak at another time
        want |= {s[5 * 24 + 12][1], s[7 * 24 + 3][1]}
        data += s
    assert {k for k, r in run(spark, data).items() if r.spike} == want
    # without the low-rank part the daily peaks are what stands out
    none = spark.createDataFrame([], "src INT, e BIGINT, i BIGINT, day BIGINT, slot BIGINT, p DOUBLE")
    monkeypatch.setattr(spikes, "daily_profile", lambda r: none)
    assert len({k for k, r in run(spark, data).items() if r.spike} - want) == 110


def test_profile_of_few_days_or_shifting_level(spark):
    """Three days are too few for a profile; a slow drift of the level keeps the profile."""
    rng = random.Random(6)
    short, drift = rhythm(rng, 1, 3), rhythm(rng, 2, 10)
    for k, r in enumerate(drift):
        r[5] += k * 0.5
    got = {k for k, r in run(spark, short + drift).items() if r.spike}
    assert got == {r[1] for k, r in enumerate(short) if k % 24 == 12}


def test_range(spark):
    rng = random.Random(9)
    s = [r for e in range(5) for r in series(rng, e, 8, 100)]
    s[3][5] = 9999.0
    got = run(spark, s)
    assert {k for k, r in got.items() if r.out_of_range} == {s[3][1]}
