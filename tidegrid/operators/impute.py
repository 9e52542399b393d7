"""Filling missing values from similar records: predictive mean matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import pieces, starts
from ..functions.linear import predict3, ridge3
from ..session import broadcast_if_small, materialise, width
from .closest import marks_around

DONOR = "at: DOUBLE, rid: BIGINT, y: DOUBLE"
PIECE = 200_000  # rows a task works on at a time


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group and prediction: for each missing one the last donor before it and the next one after it; of groups that
    may go on in other pieces also the first and last donor (edge)."""
    task, nth = TaskContext.get().partitionId(), 0
    for c, opened, goes_on in pieces(batches, ("grp",), ("grp", "at", "h"), PIECE):
        n = len(c["at"])
        first = starts(c["grp"])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], n) - 1
        g = np.cumsum(first) - 1
        idx = np.arange(n)
        don = ~np.isnan(c["y"])
        lo = np.maximum.accumulate(np.where(don, idx, -1))
        lo = np.where(lo >= begin[g], lo, -1)
        hi = np.minimum.accumulate(np.where(don, idx, n)[::-1])[::-1]
        hi = np.where(hi <= end[g], hi, -1)
        ask = np.flatnonzero(~don)
        cut = [k for k, is_cut in ((0, opened), (len(begin) - 1, goes_on)) if is_cut]
        at = begin[sorted(set(cut))]
        last = end[sorted(set(cut))]
        rows = np.concatenate([ask, at])
        low, high = np.concatenate([lo[ask], hi[at]]), np.concatenate([hi[ask], lo[last]])

        def donor(k: np.ndarray, c: dict[str, np.ndarray] = c) -> pa.Array:
            parts = [pa.array(c["at"][k]), pa.array(c["rid"][k], pa.int64()), pa.array(c["y"][k])]
            return pa.StructArray.from_arrays(parts, names=["at", "rid", "y"], mask=pa.array(k < 0))

        yield pa.RecordBatch.from_arrays(
            [pa.array(c["grp"][rows]), pa.array(np.full(len(rows), (task << 32) + nth)), pa.array(np.arange(len(rows)) >= len(ask)), pa.array(c["rid"][rows], pa.int64()), pa.array(c["at"][rows]), donor(low), donor(high)],
            names=["grp", "piece", "edge", "rid", "at", "lo", "hi"],
        )
        nth += 1


def mean_matching(rows: DataFrame, ridge: float = 10.0, block_periods: int = 24, reach_blocks: int = 16) -> DataFrame:
    """Every missing y filled with the observed y of a donor of the same group whose prediction lies nearest.

    rows: rid (unique), entity, grp, t (seconds), period (usual seconds between readings of the group), y DOUBLE (NULL: missing).
    Predictors of a reading: the observed reading before it, the one after it (up to reach_blocks blocks of block_periods periods away, whether
    or not a block ends between) and the mean of the others in its block, else of those two; all of its entity and group, never itself.
    One ridge regression per group on all observed rows; rows without any predictor, as those without entity, take the group's mean.
    Donors are searched by their own predictions: all rows lie in one order of group, prediction and hash of the id, cut by ranges; a missing
    row finds the donors next to it in that order, in its piece or at the borders of the others; the nearer one gives, of equal ones the
    lower. Among donors of exactly its own prediction the hash decides, so they take turns however many there are.

    Result: one row per row with NULL y: rid, grp, fill DOUBLE, donor_rid. A group without observed rows gives NULL for both.
    NaN must be NULL already. Rows without group are left out. Repeated rows are rows of their own. Without missing rows or in an empty table the result is empty.
    """
    block = F.floor(F.col("t") / (F.col("period") * block_periods))
    lone = F.col("entity").isNull() | F.col("t").isNull() | F.col("period").isNull()
    base = rows.select("rid", "grp", F.when(~lone, F.col("entity")).alias("e"), F.when(lone, F.col("rid")).otherwise(block).alias("b"), "t", "y")
    part = Window.partitionBy("e", "grp", "b")
    others = F.try_divide(F.sum("y").over(part) - F.coalesce("y", F.lit(0.0)), F.count("y").over(part) - F.col("y").isNotNull().cast("int"))
    marked = base.withColumn("s", F.when(F.col("y").isNotNull(), F.struct("t", "rid", "y"))).withColumn("o", others)
    w = marks_around(marked, ["e", "grp"], "b", ["t", "rid"], "s", reach_blocks).select("rid", "grp", "y", F.col("before.y").alias("p"), F.col("after.y").alias("q"), "o")
    w = w.withColumn("m", F.coalesce("o", (F.col("p") + F.col("q")) / 2, "p", "q"))
    known = materialise(w.select("rid", "grp", "y", F.coalesce("p", "q", "m").alias("x0"), F.coalesce("q", "p", "m").alias("x1"), F.col("m").alias("x2")), "predictors")
    seen = known.where("y IS NOT NULL")
    model = ridge3(seen.where("x2 IS NOT NULL"), ["grp"], ("x0", "x1", "x2"), "y", ridge).drop("n", "a")
    scale = seen.groupBy("grp").agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("sd")).join(model, "grp", "left")
    for c in ("m0", "m1", "m2", "b0", "b1", "b2"):
        scale = scale.withColumn(c, F.coalesce(c, F.lit(0.0)))
    pred = F.when(F.col("x2").isNull(), F.col("a")).otherwise(predict3([F.col("x0"), F.col("x1"), F.col("x2")]))
    # written once: sums in another order must not move a prediction between its uses
    scale = materialise(scale, "models")
    rated = known.join(broadcast_if_small(scale, 10_000), "grp", "left").select("rid", "grp", "y", F.coalesce(F.nanvl(pred, F.lit(0.0)), F.lit(0.0)).alias("at"))
    order = ["grp", "at", "h"]
    line = rated.where("grp IS NOT NULL").withColumn("h", F.xxhash64("rid")).repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)
    kind = rows.schema["grp"].dataType.simpleString()
    near = materialise(line.select(*order, "rid", "y").mapInArrow(_neighbours, f"grp {kind}, piece BIGINT, edge BOOLEAN, rid BIGINT, at DOUBLE, lo STRUCT<{DONOR}>, hi STRUCT<{DONOR}>"), "neighbours")
    # a group that goes on in other pieces: the last donor before this one and the first after it
    pieces_ = Window.partitionBy("grp").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("grp").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    edges = near.where("edge").select("grp", "piece", F.last("hi", True).over(pieces_).alias("below"), F.last("lo", True).over(later).alias("above"))
    asked = near.where("NOT edge").join(edges, ["grp", "piece"], "left").select("rid", "grp", "at", F.coalesce("lo", "below").alias("lo"), F.coalesce("hi", "above").alias("hi"))
    take_hi = F.col("lo").isNull() | ((F.col("hi.at") - F.col("at")) < (F.col("at") - F.col("lo.at")))
    got = F.when(take_hi, F.col("hi")).otherwise(F.col("lo"))
    return asked.select("rid", "grp", got["y"].alias("fill"), got["rid"].alias("donor_rid"))
