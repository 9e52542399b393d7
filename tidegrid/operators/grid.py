"""Fixed-step grids anchored per entity, and what streams contribute to their cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around_anchor(events: DataFrame, anchors: DataFrame, entity: str, time: str, anchor: str, before_s: float, after_s: float) -> DataFrame:
    """Events of anchored entities with time in [anchor - before, anchor + after)."""
    return events.join(anchors, entity).where((F.col(time) >= F.col(anchor) - before_s) & (F.col(time) < F.col(anchor) + after_s))


def grid_bounds(events: DataFrame, entity: str, time: str, anchor: str, before_s: float, after_s: float, step_s: float) -> DataFrame:
    """(entity, first, n): n steps from first, the span of the events cut to the window around the anchor. Entities of n = 0 are left out."""
    b = events.groupBy(entity).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.min(anchor).alias("a"))
    first, last = F.greatest("lo", F.col("a") - before_s), F.least("hi", F.col("a") + after_s)
    return b.select(entity, first.alias("first"), F.ceil((last - first) / step_s).cast("bigint").alias("n")).where("n >= 1")


def grid_cells(bounds: DataFrame, entity: str, step_s: float) -> DataFrame:
    """(entity, timestep 1..n, timestamp = start of the step)."""
    return bounds.select(entity, "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).select(
        entity, (F.col("k") + 1).alias("timestep"), (F.col("first") + F.col("k") * step_s).alias("timestamp")
    )


def cell_means(events: DataFrame, bounds: DataFrame, entity: str, time: str, columns: list[str], step_s: float) -> DataFrame:
    """Mean of each column per grid cell (entity, timestep); the cell of an event follows by arithmetic, not by a range join."""
    k = F.floor((F.col(time) - F.col("first")) / step_s)
    return (
        events.join(bounds, entity)
        .withColumn("timestep", k + 1)
        .where("timestep >= 1 AND timestep <= n")
        .groupBy(entity, "timestep")
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def overlapped_cells(intervals: DataFrame, bounds: DataFrame, entity: str, start: str, end: str, step_s: float, closed_start: bool) -> DataFrame:
    """Each interval once for every cell [s, s + step) it overlaps: start < cell end (or <= with closed_start) and end >= cell start.

    The range of cells is computed, so a theta join becomes an explode."""
    x, y = (F.col(start) - F.col("first")) / step_s, (F.col(end) - F.col("first")) / step_s
    lo = F.greatest(F.ceil(x) - 1 if closed_start else F.floor(x), F.lit(0).cast("bigint"))
    hi = F.least(F.floor(y), F.col("n") - 1)
    return intervals.join(bounds, entity).withColumns({"_lo": lo, "_hi": hi}).where("_hi >= _lo").withColumn("timestep", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi") + 1))).drop("_lo", "_hi", "first", "n")


def running_before(points: DataFrame, bounds: DataFrame, entity: str, time: str, amount: str, step_s: float) -> DataFrame:
    """(entity, timestep, total): the sum of all amounts of the entity at times before the cell's end, for every cell of the grid.

    Amounts are reduced to cells first; the running sum then goes over the few cells of the grid."""
    k = F.greatest(F.floor((F.col(time) - F.col("first")) / step_s), F.lit(0).cast("bigint"))
    per = points.join(bounds, entity).withColumn("timestep", k + 1).where("timestep <= n").groupBy(entity, "timestep").agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(entity).orderBy("timestep").rowsBetween(Window.unboundedPreceding, 0)
    return grid_cells(bounds, entity, step_s).join(per, [entity, "timestep"], "left").select(entity, "timestep", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("total"))


def distinct_times(entity: str, *streams: tuple[DataFrame, str]) -> DataFrame:
    """The distinct times (entity, t) at which any stream has a record: reduced in each stream before they meet. NULL entities and times are left out."""
    parts = [df.select(entity, F.col(time).cast("double").alias("t")).dropna().distinct() for df, time in streams]
    return reduce(DataFrame.unionByName, parts).distinct()
