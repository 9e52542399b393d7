"""Neighbours along time: the marks before and after a row, and the event closest to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marks_around(rows: DataFrame, keys: list[str], cell: str, order: list[str], mark: str, span: int) -> DataFrame:
    """Adds `before` and `after`: the last and the next non-NULL `mark` of other rows of the keys, in the given order.

    cell: whole number that never falls along the order. Neighbours are found inside a cell, and beyond it among the ends of cells: the
    first and last mark of a cell travel to the spans of `span` cells around it. So windows hold the rows of one cell or the ends of 3 x span
    cells, whatever the entity's size; marks at least span cells away may stay unseen. Marks must sort in the given order.
    """
    # what follows is what precedes in the reverse order: a running value, where a frame to the end would be read anew for each row
    back = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({"before": F.last(mark, True).over(back([*keys, cell], order)), "after": F.last(mark, True).over(back([*keys, cell], [F.desc(c) for c in order]))})
    ends = rows.groupBy(*keys, cell).agg(F.min(mark).alias("_first"), F.max(mark).alias("_last"))
    own = F.floor(F.col(cell) / span)
    spread = ends.withColumn("_span", F.explode(F.sequence(own - 1, own + 1)))
    beyond = spread.select(
        *keys, cell, "_span", F.last("_last", True).over(back([*keys, "_span"], [cell])).alias("_b"), F.last("_first", True).over(back([*keys, "_span"], [F.desc(cell)])).alias("_a")
    ).where(F.col("_span") == own)
    joined = inside.join(beyond.drop("_span"), [*keys, cell], "left")
    return joined.withColumns({"before": F.coalesce("before", "_b"), "after": F.coalesce("after", "_a")}).drop("_a", "_b")


def number(c: str) -> Column:
    """The column as DOUBLE, NaN as NULL."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def closest_event(left: DataFrame, right: DataFrame, entity: str, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: float) -> DataFrame:
    """Each left row with the right row of its entity closest in time, at most `tolerance` seconds away: the nearer one of the last event
    before (or at the same time) and the next one after.

    Ties: of equal distances the earlier right time, then the smaller right id. Rows with a NULL (or NaN) entity, id or time pair with
    nothing; left rows without partner are left out; repeated left ids give one row per distinct time; empty tables give an empty result.
    Result: entity, left_id, right_id, left_time, right_time, distance.
    """
    r = right.select(F.col(entity).alias("e"), number(right_time).alias("t"), F.col(right_id).alias("id")).dropna().groupBy("e", "t").agg(F.min("id").alias("id"))
    lf = left.select(F.col(entity).alias("e"), number(left_time).alias("t"), F.col(left_id).alias("lid")).dropna().distinct()
    both = r.select("e", "t", F.struct("t", "id").alias("m")).unionByName(lf, allowMissingColumns=True)
    splits = 64
    both = both.withColumns({"c": F.floor(F.col("t") / (tolerance / splits)), "point": F.col("m").isNull()})
    seen = marks_around(both, ["e"], "c", ["t", "point", "lid"], "m", splits + 1).where("point")
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    got = seen.withColumn("g", F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))).withColumn("distance", F.abs(F.col("t") - F.col("g.t")))
    return got.where(F.col("distance") <= tolerance).select(F.col("e").alias(entity), F.col("lid").alias(left_id), F.col("g.id").alias(right_id), F.col("t").alias("left_time"), F.col("g.t").alias("right_time"), "distance")
