"""Rolling sums, first-event flags with censoring, and look-ahead windows over gridded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(entity: str, order: str, col: str, rows: int) -> Column:
    """Sum of the last `rows` rows, NULLs skipped."""
    return F.sum(col).over(Window.partitionBy(entity).orderBy(order).rowsBetween(1 - rows, 0))


def first_event(df: DataFrame, entity: str, order: str, cond: Column, name: str) -> DataFrame:
    """0 before the first row that meets the condition, 1 there, 2 afterwards; an unknown condition is not met."""
    ok = F.coalesce(cond, F.lit(False))
    past = F.max(ok).over(Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.when(past, 2).when(ok, 1).otherwise(0))


def sliding_windows(df: DataFrame, entity: str, order: str, features: list[str], target: Column, window: int, horizon: int) -> DataFrame:
    """(entity, order of the first row, x, y): each complete window of rows with the target over the `horizon` rows after it.

    x: array of feature arrays; y: 1 if the target's maximum is above 0."""
    w = Window.partitionBy(entity).orderBy(order)
    ahead = w.rowsBetween(window, window + horizon - 1)
    return (
        df.select(
            entity, order, F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w.rowsBetween(0, window - 1)).alias("x"),
            F.max(target).over(ahead).alias("_m"), F.count(F.lit(1)).over(w.rowsBetween(0, window + horizon - 1)).alias("_n"),
        )
        .where(F.col("_n") == window + horizon)
        .select(entity, order, "x", F.coalesce(F.col("_m") > 0, F.lit(False)).cast("int").alias("y"))
    )


def head_windows(df: DataFrame, entity: str, order: str, features: list[str], target: str, window: int) -> DataFrame:
    """(entity, x, y): the first `window` rows of entities that have so many, with the target of the last row of all."""
    f = F.struct(F.col(order).alias("o"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    g = df.groupBy(entity).agg(F.array_sort(F.collect_list(f)).alias("_r"), F.max_by(target, order).alias("y"), F.count("*").alias("_n"))
    return g.where(F.col("_n") >= window).select(entity, F.transform(F.slice("_r", 1, window), lambda s: s["v"]).alias("x"), "y")
