"""Nearest-in-time pairing by midpoint intervals and a partitioned interval index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closest import marks_around, number

BASE = 16.0  # ratio of the widths of neighbouring levels
SPLITS = 64  # cells of one tolerance in which neighbours are found


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: float
) -> DataFrame:
    """Each left row with the right row of its entity that lies nearest in time, at most `tolerance` seconds away.

    Each right time owns the interval between the midpoints to its neighbours, cut at the tolerance. Neighbours farther than twice the
    tolerance never bound an interval; nearer ones are found inside cells of a 64th of the tolerance and, beyond them, among the ends of
    cells, so that no window holds more than a cell's times or the ends of the cells of six tolerances.
    The intervals of an entity are disjoint; an index keeps each at the level of its width (powers of BASE), where it covers at most three
    cells of that width. A cell so holds few intervals however dense an entity is, and a left row, which looks into one cell per level,
    meets few of them; entity, level and cell spread a busy entity over all tasks.

    Ties: of equal distances the earlier right time, then the smaller right id. Equal times count (distance 0).
    Rows with a NULL (or NaN) entity, id or time pair with nothing; left rows without partner are left out. Repeated left ids give one row
    per distinct time. Empty tables give an empty result; other columns are ignored.
    Result: left_id, right_id, left_time, right_time, distance.
    """
    reach = 2.0 * tolerance
    r = right.select(F.col(entity).alias("_e"), number(right_time).alias("_t"), F.col(right_id).alias("_rid")).dropna().groupBy("_e", "_t").agg(F.min("_rid").alias("_rid"))
    own = marks_around(r.withColumns({"_m": F.col("_t"), "_c": F.floor(F.col("_t") / (tolerance / SPLITS))}), ["_e"], "_c", ["_t"], "_m", 2 * SPLITS + 1)
    lo, hi = (F.col("before") + F.col("_t")) / 2, (F.col("_t") + F.col("after")) / 2
    span = own.select(
        "_e", F.col("_t").alias("_rt"), "_rid", lo.alias("_lo"), hi.alias("_hi"), F.greatest(F.col("_t") - tolerance, lo).alias("_a"), F.least(F.col("_t") + tolerance, hi).alias("_z"),
    )
    sizes = [1.0]
    while sizes[-1] < reach:
        sizes.append(sizes[-1] * BASE)
    level = F.coalesce(*[F.when(F.col("_z") - F.col("_a") <= x, F.lit(k)) for k, x in enumerate(sizes)], F.lit(len(sizes) - 1))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("_level") + 1)
    intervals = span.withColumn("_level", level).select("_e", "_rt", "_rid", "_lo", "_hi", "_level", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_z") / size))).alias("_cell"))
    lf = left.select(F.col(entity).alias("_e"), number(left_time).alias("_lt"), F.col(left_id).alias("_lid")).dropna().distinct()
    lf = lf.withColumn("_level", F.explode(F.array(*map(F.lit, range(len(sizes)))))).withColumn("_cell", F.floor(F.col("_lt") / size))
    hit = (
        (F.abs(F.col("_lt") - F.col("_rt")) <= tolerance)
        & (F.col("_lo").isNull() | (F.col("_lt") > F.col("_lo")))
        & (F.col("_hi").isNull() | (F.col("_lt") <= F.col("_hi")))
    )
    return lf.join(intervals, ["_e", "_level", "_cell"]).where(hit).select(
        F.col("_lid").alias(left_id), F.col("_rid").alias(right_id), F.col("_lt").alias("left_time"), F.col("_rt").alias("right_time"),
        F.abs(F.col("_lt") - F.col("_rt")).alias("distance"),
    )
