"""Tasks over trajectories, dispatched by name, and the grid of tasks x models x treatments with one result row each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, flags, models
from ..session import materialise
from .imputation import feature_columns


@dataclass(frozen=True)
class Task:
    """kind: 'temporal' (sliding windows, does `target` hold within the horizon after them) or 'static' (the first rows of an entity, the
    target of its last row). numeric: regression, else a class of 0 and 1."""

    kind: str
    target: Column | str
    numeric: bool = False


def windows(traj: DataFrame, task: Task, features: Sequence[str], entity: str, order: str, window: int, horizon: int | None) -> DataFrame:
    """Windows (entity, x, y, features) of a task; a temporal task needs a horizon."""
    if task.kind == "temporal":
        if not horizon:
            raise ValueError("a temporal task needs a horizon")
        w = flags.sliding_windows(traj, entity, order, list(features), task.target, window, horizon)
    elif task.kind == "static":
        w = flags.head_windows(traj.withColumn("_target", task.target if isinstance(task.target, Column) else F.col(task.target)), entity, order, list(features), "_target", window)
    else:
        raise ValueError(f"unknown kind of task: {task.kind}")
    return models.flatten_windows(w.where("y IS NOT NULL"))


def _metrics(df: DataFrame, numeric: bool) -> dict[str, float | None]:
    return (evaluate.regression_metrics(df, "y", "score") if numeric else evaluate.ranking_metrics(df, "score", "y")).first().asDict()


def _baseline(train: DataFrame, part: DataFrame, numeric: bool) -> dict[str, float | None]:
    """What predicting the training mean (or, for classes, the most frequent class) gives."""
    base = evaluate.baselines(train, "y").first()
    if numeric:
        return evaluate.regression_metrics(part.withColumn("score", F.lit(float(base.mean_target or 0.0))), "y", "score").first().asDict()
    hit = F.avg((F.col("y") == F.lit(base.majority)).cast("double"))
    return {"accuracy": part.agg(hit.alias("a")).first().a}


def run_grid(
    traj: DataFrame, tasks: dict[str, Task], entity: str, order: str, window: int = 3, horizon: int = 6, treatments: Sequence[str] = (), never: Sequence[str] = (),
    models_of: Callable[[Task], Sequence[str]] = lambda t: ("ridge", "lasso") if t.numeric else ("logistic",), seed: int = 42,
) -> DataFrame:
    """One result row per task, model and use of treatments: the parameters, then train_, val_ and baseline metrics.

    Features are all numeric columns but the keys, `never` and, without treatments, the treatment columns. Entities are split by hash of the
    key and seed, so every row of an entity falls on one side. Windows are built once per task and use of treatments."""
    traj = materialise(traj, "trajectories")
    numeric = [f.name for f in traj.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]
    out: list[dict] = []
    for name, task in tasks.items():
        h = horizon if task.kind == "temporal" else None
        for treated in (True, False):
            cols = [c for c in feature_columns(traj, "", (entity, order, *never), tuple(treatments), treated) if c in numeric]
            w = materialise(windows(traj, task, cols, entity, order, window, h).select(entity, "features", F.col("y").cast("double").alias("y"), evaluate.hash_split(F.col(entity), seed=seed).alias("train")), "windows")
            train, val = w.where("train"), w.where("NOT train")
            base = {f"{part}_baseline_{k}": v for part, df in (("train", train), ("val", val)) for k, v in _baseline(train, df, task.numeric).items()}
            for model_type in models_of(task):
                m = models.linear(train, model_type) if task.numeric else models.logistic(train)
                got = {f"{part}_{k}": v for part, df in (("train", train), ("val", val)) for k, v in _metrics(models.scores(m, df, classification=not task.numeric), task.numeric).items()}
                out.append({"task": name, "model_type": model_type, "include_treatments": treated, "prediction_horizon": h, **got, **base})
    keys = ["task", "model_type", "include_treatments", "prediction_horizon", *dict.fromkeys(k for r in out for k in list(r)[4:])]
    schema = ", ".join(["task STRING", "model_type STRING", "include_treatments BOOLEAN", "prediction_horizon INT", *[f"{k} DOUBLE" for k in keys[4:]]])
    return traj.sparkSession.createDataFrame([tuple(None if r.get(k) is None else float(r[k]) if k in keys[4:] else r[k] for k in keys) for r in out], schema)
