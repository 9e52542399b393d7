"""Irregular readings onto a regular grid, gaps filled by harmonic regression with trend and bridged residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import predict3, ridge3
from ..session import bucketed

DAY = 86400.0


def _features(slot: Column) -> list[Column]:
    """Days, and the daily harmonic. The equations are centred, so the trend needs no origin of its own."""
    mid = (slot.cast("double") + 0.5) * F.col("period")
    phase = F.pmod(mid, F.lit(DAY)) * (2 * math.pi / DAY)
    return [mid / DAY, F.cos(phase), F.sin(phase)]


def _predict(slot: Column) -> Column:
    return predict3(_features(slot))


def regular_grid(
    readings: DataFrame, entity: str, item: str, time: str, value: str, period: str, max_gap_s: float = 8_640_000.0, ridge: float = 4.0, block_slots: int = 512
) -> DataFrame:
    """One value per entity, item and period: the mean of the readings of the slot, or a filled one.

    slot = floor(time / period). An empty slot between two slots with a reading at most max_gap_s apart is filled: the series' trend and
    daily harmonic, fitted by distributed normal equations, plus the residual bridged linearly between the two endpoints. Slots before the
    first, after the last and inside longer gaps are not part of the grid.
    Neighbours are found inside blocks of slots and between the ends of consecutive blocks, so no task holds a whole series.

    Rows with NULL entity, item, time, value or period, NaN or a period <= 0 do not count. Repeated rows and equal times are averaged.
    An empty table gives an empty result. Other columns are ignored.
    Result: entity, item, slot, value, n_readings (0 if filled), filled BOOLEAN.
    """
    num = F.col(value).cast("double")
    rows = readings.select(F.col(entity).alias("e"), F.col(item).alias("i"), F.col(period).cast("double").alias("period"), F.col(time).cast("double").alias("t"), num.alias("v"))
    rows = rows.dropna().where("NOT isnan(v) AND NOT isnan(t) AND period > 0").select("e", "i", "period", F.floor(F.col("t") / F.col("period")).alias("slot"), "v")
    rows = rows.withColumn("block", F.floor(F.col("slot") / block_slots))
    # readings of a slot are reduced before they travel, so a dense source costs no more than its slots
    slots = rows.groupBy("e", "i", "block", "period", "slot").agg(F.avg("v").alias("y"), F.count("*").alias("n"))
    cells = bucketed(slots, "cells", "e", "i", "block")
    end = F.struct("slot", "y")
    inside = Window.partitionBy("e", "i", "block").orderBy("slot")
    within = cells.select("e", "i", "period", end.alias("p"), F.lead(end).over(inside).alias("q"))
    ends = cells.groupBy("e", "i", "block", "period").agg(F.min(end).alias("first"), F.max(end).alias("last"))
    across = ends.select("e", "i", "period", F.col("last").alias("p"), F.lead("first").over(Window.partitionBy("e", "i").orderBy("block")).alias("q"))
    apart = F.col("q.slot") - F.col("p.slot")
    gaps = within.unionByName(across).where((apart > 1) & (apart * F.col("period") <= max_gap_s))
    # covariances are taken where the cells lie and merge per series, so a busy series sends one row a task
    rows_x = cells.select("e", "i", "y", *[c.alias(f"x{k}") for k, c in enumerate(_features(F.col("slot")))])
    model = ridge3(rows_x, ["e", "i"], ("x0", "x1", "x2"), "y", ridge).drop("n")
    g = gaps.join(model, ["e", "i"]).select("*", (F.col("p.y") - _predict(F.col("p.slot"))).alias("ra"), (F.col("q.y") - _predict(F.col("q.slot"))).alias("rb"))
    g = g.select("*", F.explode(F.sequence(F.col("p.slot") + 1, F.col("q.slot") - 1)).alias("slot"))
    share = (F.col("slot") - F.col("p.slot")) / apart
    filled = g.select("e", "i", "slot", (_predict(F.col("slot")) + F.col("ra") + (F.col("rb") - F.col("ra")) * share).alias("y"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("filled"))
    both = cells.select("e", "i", "slot", "y", "n", F.lit(False).alias("filled")).unionByName(filled)
    return both.select(F.col("e").alias(entity), F.col("i").alias(item), "slot", F.col("y").alias("value"), F.col("n").alias("n_readings"), "filled")
