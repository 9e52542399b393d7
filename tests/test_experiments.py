"""Tasks, models and result rows on small trajectories with a known signal."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import models
from tidegrid.plans.experiments import Task, run_grid, windows


@pytest.fixture(scope="module")
def traj(spark):
    rng, rows = random.Random(1), []
    for e in range(60):
        up = e % 2
        for k in range(1, 9):
            rows.append((e, k, float(up) + rng.gauss(0, 0.1), rng.random(), up, 10.0 * up + 5.0))
    return spark.createDataFrame(rows, "stay BIGINT, step BIGINT, signal DOUBLE, dose DOUBLE, up INT, days DOUBLE")


def test_windows_by_kind(traj):
    assert windows(traj, Task("temporal", F.col("up")), ["signal"], "stay", "step", 3, 2).count() == 60 * 4
    assert windows(traj, Task("static", "days", numeric=True), ["signal"], "stay", "step", 3, None).count() == 60
    with pytest.raises(ValueError, match="horizon"):
        windows(traj, Task("temporal", F.col("up")), ["signal"], "stay", "step", 3, None)
    with pytest.raises(ValueError, match="unknown"):
        windows(traj, Task("other", "days"), ["signal"], "stay", "step", 3, 1)


def test_one_result_row_per_combination(traj):
    tasks = {"up": Task("static", F.col("up")), "days": Task("static", "days", numeric=True)}
    rows = run_grid(traj, tasks, "stay", "step", horizon=2, treatments=("dose",), never=("up", "days")).collect()
    assert sorted((r.task, r.model_type, r.include_treatments) for r in rows) == sorted([("up", "logistic", t) for t in (True, False)] + [("days", m, t) for m in ("ridge", "lasso") for t in (True, False)])
    for r in rows:
        if r.task == "up":
            assert r.val_auroc > 0.99 and r.train_auroc > 0.99 and r.val_rmse is None and r.val_baseline_accuracy < 0.9
        elif r.model_type == "ridge":
            assert r.val_rmse < 0.5 * r.val_baseline_rmse


@pytest.mark.parametrize("penalty", ["ridge", "lasso", "elasticnet", "none"])
def test_linear_models(traj, penalty):
    w = windows(traj, Task("static", "days", numeric=True), ["signal"], "stay", "step", 2, None)
    got = models.scores(models.linear(w, penalty, 0.1), w, classification=False)
    assert got.agg(F.avg(F.abs(F.col("score") - F.col("y")))).first()[0] < 1.5
