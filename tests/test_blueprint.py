"""Micro-fixtures with expectations worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import carry, clean, cohort, evaluate, flags, grid, knn, onset

H = 3600.0


def values(spark, schema, rows, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in cols.items()]).collect()]


@pytest.mark.parametrize(
    ("abx", "cultures", "want"),
    [([100], [80, 130], 80), ([10], [40], None), ([10, 50], [40], 40), ([10], [10], 10), ([100], [28], 28), ([100], [27.9], None), ([10], [34], 10), ([10], [34.1], None), ([50], [60, 40], 40), ([], [1], None), ([1], [], None)],
)
def test_onset(spark, abx, cultures, want):
    a = spark.createDataFrame([(1, i, float(t) * H) for i, t in enumerate(abx)], "stay BIGINT, aid BIGINT, t DOUBLE")
    c = spark.createDataFrame([(1, i, float(t) * H) for i, t in enumerate(cultures)], "stay BIGINT, cid BIGINT, t DOUBLE")
    got = [r.onset_time / H for r in onset.first_anchor(a, c, "stay", "aid", "t", "cid", "t").collect()]
    assert got == ([] if want is None else [pytest.approx(want)])


def test_hold_with_time_to_live(spark):
    rows = [(1, 0.0, 5.0), (1, H, None), (1, 2 * H, None), (1, 2 * H + 1, None), (1, 3 * H, 7.0), (1, 4 * H, None), (2, 0.0, None), (None, 1.0, None)]
    got = carry.hold_values(spark.createDataFrame(rows, "stay BIGINT, t DOUBLE, v DOUBLE"), "stay", "t", {"v": 2 * H})
    assert sorted((r.stay or 0, r.t, r.v) for r in got.collect()) == sorted([(1, 0.0, 5.0), (1, H, 5.0), (1, 2 * H, 5.0), (1, 2 * H + 1, None), (1, 3 * H, 7.0), (1, 4 * H, 7.0), (2, 0.0, None), (0, 1.0, None)])


def test_grid_and_boundaries(spark):
    ev = spark.createDataFrame([(1, 77 * H, 80.0, 100 * H), (1, 80 * H, 100.0, 100 * H), (1, 84 * H, None, 100 * H), (2, 77 * H, 1.0, 100 * H), (3, 77 * H, 1.0, 100 * H), (3, 81 * H, 2.0, 100 * H)], "stay BIGINT, t DOUBLE, hr DOUBLE, a DOUBLE")
    b = grid.grid_bounds(ev, "stay", "t", "a", 24 * H, 72 * H, 4 * H)
    assert sorted((r.stay, r.first / H, r.n) for r in b.collect()) == [(1, 77, 2), (3, 77, 1)]
    assert sorted((r.stay, r.timestep, r.timestamp / H) for r in grid.grid_cells(b, "stay", 4 * H).collect()) == [(1, 1, 77), (1, 2, 81), (3, 1, 77)]
    assert sorted((r.stay, r.timestep, r.hr) for r in grid.cell_means(ev, b, "stay", "t", ["hr"], 4 * H).collect()) == [(1, 1, 90.0), (1, 2, None), (3, 1, 1.0)]


def test_overlap(spark):
    b = spark.createDataFrame([(1, 0.0, 3)], "stay BIGINT, first DOUBLE, n BIGINT")
    f = spark.createDataFrame([(1, -H, 0.0, 100.0), (1, 4 * H, 5 * H, 70.0), (1, 3 * H, 4 * H, 50.0), (1, -3 * H, -H, 9.0), (2, 0.0, H, 1.0)], "stay BIGINT, s DOUBLE, e DOUBLE, x DOUBLE")
    step = {r.timestep: r.s for r in grid.overlapped_cells(f, b, "stay", "s", "e", 4 * H, False).groupBy("timestep").agg(F.sum("x").alias("s")).collect()}
    assert step == {1: 150.0, 2: 120.0}
    closed = {r.timestep: r.s for r in grid.overlapped_cells(f, b, "stay", "s", "e", 4 * H, True).groupBy("timestep").agg(F.max("x").alias("s")).collect()}
    assert closed == {1: 100.0, 2: 70.0}
    total = {r.timestep: r.total for r in grid.running_before(f, b, "stay", "e", "x", 4 * H).collect()}
    assert total == {1: 109.0, 2: 229.0, 3: 229.0}


def test_flags(spark):
    df = spark.createDataFrame([(1, 1, 500.0, 60.0, 3.0, 1), (1, 2, 900.0, 70.0, 3.0, 2), (1, 3, 700.0, 64.0, 2.5, 0), (1, 4, 0.0, 60.0, 1.0, 3)], "stay BIGINT, k INT, f DOUBLE, map DOUBLE, la DOUBLE, sofa INT")
    r = df.withColumn("roll", flags.rolling_sum("stay", "k", "f", 3))
    got = flags.first_event(r, "stay", "k", (F.col("roll") >= 2000) & (F.col("map") < 65) & (F.col("la") > 2), "flag").orderBy("k").collect()
    assert [(x.roll, x.flag) for x in got] == [(500, 0), (1400, 0), (2100, 1), (1600, 2)]
    assert [x.flag for x in flags.first_event(df, "stay", "k", F.col("sofa") >= 2, "flag").orderBy("k").collect()] == [0, 1, 2, 2]


def test_cleaning_rules(spark):
    assert values(spark, "x DOUBLE", [(0.5,), (1.0,), (0.1,), (21.0,), (101.0,)], y=clean.fraction_to_percent(F.col("x"))) == [(50.0,), (None,), (None,), (21.0,), (None,)]
    assert values(spark, "x DOUBLE", [(151.0,), (120.0,), (99.0,), (None,)], y=clean.clamp(F.col("x"), 150.0, 100.0)) == [(None,), (100.0,), (99.0,), (None,)]
    assert values(spark, "x DOUBLE", [(3.0,), (3.5,), (16.0,), (None,)], y=clean.by_threshold(F.col("x"), [(15, 70), (1, 24), (3, 32), (4, 36)])) == [(32,), (36,), (None,), (None,)]
    assert values(spark, "x DOUBLE", [(72.0,), (65.0,), (64.0,), (None,)], y=clean.ordinal_score(F.col("x"), [(70, 0), (65, 1)], 2)) == [(0,), (1,), (2,), (0,)]
    t = clean.mutual_linear(clean.move_misplaced(spark.createDataFrame([(98.6, None), (37.0, None)], "c DOUBLE, f DOUBLE"), "c", "f", 90.0), "c", "f", 1.8, 32.0).collect()
    assert [(round(r.c, 6), round(r.f, 6)) for r in t] == [(37.0, 98.6), (37.0, 98.6)]
    b = clean.out_of_bounds_to_null(spark.createDataFrame([(5.0,), (251.0,), (float("nan"),), (None,)], "x DOUBLE"), {"x": (None, 250.0)}).collect()
    assert [r.x for r in b] == [5.0, None, None, None]
    assert values(spark, "x DOUBLE", [(0.0125,), (-0.0125,)], y=clean.half_up(F.col("x"))) == [(0.013,), (-0.013,)]


def test_visits_and_keys(spark):
    d = 86400.0
    v = spark.createDataFrame([(1, "A", 0.0, 5 * d), (1, "B", 20 * d, 25 * d), (1, "C", 60 * d, 61 * d), (2, "D", 0.0, d), (2, "E", 31 * d, 32 * d)], "s BIGINT, v STRING, a DOUBLE, z DOUBLE")
    assert {r.v: r.re_admission for r in cohort.readmissions(v, "s", "a", "z", 30 * d).collect()} == {"A": 0, "B": 1, "C": 0, "D": 0, "E": 1}
    iv = spark.createDataFrame([(1, "S1", 0.0, 24 * H, 1), (1, "S2", 60 * H, 100 * H, 2), (2, "S3", 0.0, H, 1)], "s BIGINT, k STRING, a DOUBLE, z DOUBLE, o INT")
    rec = spark.createDataFrame([(1, 1, 30 * H), (2, 1, 200 * H), (3, 2, 1000 * H), (4, 9, 0.0)], "r BIGINT, s BIGINT, t DOUBLE")
    assert {x.r: x.k for x in cohort.resolve_keys(rec, iv, "r", "s", "t", "k", "a", "z", "o", 48 * H).collect()} == {1: "S2", 2: None, 3: "S3", 4: None}
    codes = spark.createDataFrame([(1, "I219"), (1, "E10"), (2, None)], "h BIGINT, c STRING")
    got = cohort.prefix_flags(codes, "h", "c", {"mi": [(None, 3, "I21", "I22")], "dm": [(None, 3, "E10", "E10")]}, spark.createDataFrame([(1,), (2,), (3,)], "h BIGINT"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_rules_of_two_code_systems(spark):
    codes = spark.createDataFrame([(1, "410", 9), (2, "410", 10), (3, "I21", 10), (4, "I21", None), (5, None, 9)], "h BIGINT, c STRING, v INT")
    rules = {"mi": [("9", 3, "410", "410"), ("10", 3, "I21", "I22")], "any": [(None, 1, "I", "I")]}
    got = cohort.prefix_flags(codes, "h", "c", rules, codes, "v")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, 0, 0)]


def test_notes_fan_out(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "x")], "stay BIGINT, step INT, note STRING")
    stays = spark.createDataFrame([(1, 10, 100), (1, 10, 100), (2, 20, 200), (3, 30, 300)], "stay BIGINT, s BIGINT, h BIGINT")
    notes = spark.createDataFrame([(10, 100, "a"), (10, 100, "b"), (10, 100, "b"), (10, 999, "c"), (30, 300, "d"), (None, 100, "e"), (20, 200, None)], "s BIGINT, h BIGINT, note STRING")
    got = cohort.attach_notes(rows, stays, notes, "stay", ["s", "h"], "note")
    assert sorted((r.stay, r.step, r.note or "") for r in got.collect()) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "b"), (2, 1, "")]


def test_early_exclusion(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 50.0, 0), (2, 1, 0.0, 1), (2, 2, 500.0, 1), (3, 1, 0.0, 0), (4, 1, 0.0, None)], "s BIGINT, k INT, t DOUBLE, x INT")
    assert {r.s for r in cohort.exclude_early(df, "s", "k", "t", F.col("x") == 1, 100.0).collect()} == {2, 3, 4}


def test_exact_median_and_running_totals(spark):
    for values_ in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None, float("nan")], [float(k % 7) for k in range(101)], []):
        df = spark.createDataFrame([(v,) for v in values_], "x DOUBLE")
        known = sorted(v for v in values_ if v is not None and v == v)
        want = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
        assert evaluate.exact_median(df, "x").first().median == want
    per = spark.createDataFrame([(k, k * k) for k in range(50)], "k INT, n INT")
    assert {r.k: r.r_n for r in evaluate.running_totals(per, "k", ["n"], descending=True).collect()} == {k: sum(j * j for j in range(k, 50)) for k in range(50)}


def test_distinct_times_of_streams(spark):
    a, b = spark.createDataFrame([(1, 5.0), (1, 5.0), (None, 1.0)], "s BIGINT, t DOUBLE"), spark.createDataFrame([(1, 5), (2, 7), (2, None)], "s BIGINT, u BIGINT")
    assert sorted(tuple(r) for r in grid.distinct_times("s", (a, "t"), (b, "u")).collect()) == [(1, 5.0), (2, 7.0)]


def test_exclusions_and_missing(spark):
    df = spark.createDataFrame([(1, 5.0, None), (1, 20.0, 1.0), (2, 5.0, None), (3, 1.0, 2.0)], "s BIGINT, x DOUBLE, y DOUBLE")
    kept = cohort.require_any(cohort.exclude_any(df, "s", F.col("x") > 10), "s", F.col("x") > 2)
    assert [r.s for r in kept.collect()] == [2]
    assert {r.column_name: r.missing for r in cohort.missing_profile(df, ["x", "y"]).collect()} == {"x": 0.0, "y": 0.5}
    assert cohort.drop_sparse(df, ["x", "y"], 0.5).columns == ["s", "x"]


def test_interpolation(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])], "s BIGINT, k INT, v DOUBLE")
    assert [r.v for r in carry.interpolate_rows(df, "s", "k", ["v"]).orderBy("k").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]


@pytest.mark.parametrize(("n", "want"), [(11, 0), (12, 1), (13, 2)])
def test_sliding_windows(spark, n, want):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(n)], "s BIGINT, k INT, v DOUBLE")
    got = flags.sliding_windows(df, "s", "k", ["v"], (F.col("v") >= 11).cast("int"), 6, 6).orderBy("k").collect()
    assert len(got) == want and all(len(r.x) == 6 and r.y == 1 for r in got)


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p DOUBLE, y INT")
    m = evaluate.ranking_metrics(df, "p", "y").first()
    assert m.auroc == pytest.approx(0.875) and m.average_precision == pytest.approx(5 / 6, abs=1e-4) and m.accuracy == pytest.approx(0.75)
    assert evaluate.ranking_metrics(df.withColumn("p", F.lit(0.3)), "p", "y").first().auroc == pytest.approx(0.5)
    b = evaluate.best_f1(df, "p", "y").first()
    assert b.threshold == 0.8 and b.sensitivity == 1.0 and b.ppv == pytest.approx(2 / 3)
    r = evaluate.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y DOUBLE, p DOUBLE"), "y", "p").first()
    assert (r.mse, r.mae, r.r2) == (0.5, 0.5, 0.5) and r.rmse == pytest.approx(math.sqrt(0.5))
    s = evaluate.standardise(spark.createDataFrame([(1.0, 1), (3.0, 1), (5.0, 0)], "x DOUBLE, tr INT"), ["x"], F.col("tr") == 1)
    assert sorted(r.x for r in s.collect()) == [-1.0, 1.0, 3.0]


def test_knn_takes_the_nearest_row_with_the_value(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 5.0, 50.0), (3, 1.1, None), (4, None, None)], "k BIGINT, a DOUBLE, b DOUBLE")
    got = {r.k: (r.a, r.b) for r in knn.nearest_neighbour_fill(df, ["k"], ["a", "b"]).collect()}
    assert got[3] == (1.1, 10.0) and got[4] == (None, None) or all(v is None or math.isnan(v) for v in got[4])


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(2000).select(evaluate.hash_split(F.col("id")).alias("t"))
    n = df.where("t").count()
    assert 1500 < n < 1700 and n == df.where("t").count()


def test_imputation_plan(spark):
    from tidegrid.plans.imputation import feature_columns, fill_missing

    rows = [(1, k, float(k), None if k % 3 == 0 else float(10 * k), 1.0 if k == 0 else None, None if k == 20 else float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "stay_id BIGINT, timestep INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = {r.timestep: r for r in fill_missing(df, "stay_id", "timestep", ["a", "b", "c", "d"]).collect()}
    assert "c" not in got[1].asDict() and got[20].d == 20.0
    assert all(abs(got[k].b - 10 * k) <= 10 for k in range(40))
    assert feature_columns(df, "a", treatments=("b",), with_treatments=False) == ["c", "d"]
