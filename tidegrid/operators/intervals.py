"""Overlapping intervals to continuous periods and the pauses between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import columns, starts, whole_groups
from ..session import materialise, width

LISTS = "_e STRING, _block BIGINT, _node INT, _s ARRAY<DOUBLE>, _z ARRAY<DOUBLE>"


def merge_runs(g: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals (group, start, end) of all groups at once; touching ones join.

    g is numbered and consecutive; each group is one run sorted by start, or several one after the other. The stable sort finds the runs and
    merges them, which is linear for two; what is in order already costs one comparison an interval. Then one pass over running ends."""
    order = np.lexsort((s, g))
    g, s, z = g[order], s[order], z[order]
    reach = pd.Series(z).groupby(g, sort=False).cummax().to_numpy()
    new = np.ones(len(s), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return g[at], s[at], reach[np.append(at[1:], len(s)) - 1] if len(at) else reach


def _batch(c: dict[str, np.ndarray], first: np.ndarray, g: np.ndarray, s: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    """One list per group; first: where the groups begin in c."""
    g, s, z = merge_runs(g, s, z)
    offsets = pa.array(np.searchsorted(g, np.arange(len(first) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (s, z)]
    return pa.RecordBatch.from_arrays([pa.array(c["_e"][first], pa.string()), pa.array(c["_block"][first], pa.int64()), pa.array(c["_node"][first], pa.int32()), *lists], names=["_e", "_block", "_node", "_s", "_z"])


def _leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of sorted rows; a node whose rows come in several batches gives several lists."""
    for batch in batches:
        if batch.num_rows:
            c = columns([batch])
            new = starts(c["_e"], c["_block"], c["_node"])
            yield _batch(c, np.flatnonzero(new), np.cumsum(new) - 1, c["s"], c["z"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list per node from its lists."""
    for c in whole_groups(batches, ("_e", "_block", "_node")):
        new = starts(c["_e"], c["_block"], c["_node"])
        g = np.repeat(np.cumsum(new) - 1, [len(x) for x in c["_s"]])
        yield _batch(c, np.flatnonzero(new), g, np.concatenate(c["_s"]), np.concatenate(c["_z"]))


def disjoint_lists(df: DataFrame, entity: str, start: str, end: str, block_s: float = 86400.0, salts: int = 8, fan_in: int = 4) -> DataFrame:
    """The mergeable aggregate: per entity and block of start times, one sorted list of disjoint intervals.

    Equal starts collapse first (map-side); partial lists are built per salt from sorted rows in one pass and combined by merging
    sorted runs, fan_in salts at a time, until one is left per block. A list never outgrows its block of time, however many rows an entity has.
    Result: _e (the entity as text), _block, _s, _z (starts and ends).
    """
    n = width(df.sparkSession)
    keys = ["_e", "_block", "_node"]
    rows = (
        df.select(F.col(entity).cast("string").alias("_e"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("z"))
        .where("_e IS NOT NULL AND s IS NOT NULL AND z IS NOT NULL AND NOT isnan(s) AND NOT isnan(z) AND z > s")
        .groupBy("_e", "s")
        .agg(F.max("z").alias("z"))
        .select("_e", F.floor(F.col("s") / block_s).alias("_block"), F.pmod(F.xxhash64("s"), F.lit(salts)).cast("int").alias("_node"), "s", "z")
    )
    lists = rows.repartition(n, *keys).sortWithinPartitions(*keys, "s").mapInArrow(_leaves, LISTS)
    while True:  # a node may have several lists even with one salt
        salts = -(-salts // fan_in)
        lists = lists.withColumn("_node", F.floor(F.col("_node") / fan_in).cast("int")).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_merge, LISTS)
        if salts == 1:
            return lists.drop("_node")


def periods_and_pauses(df: DataFrame, entity: str, start: str, end: str, block_s: float = 86400.0) -> tuple[DataFrame, DataFrame]:
    """(periods, pauses): continuous periods (entity, start, end) and the pauses between them (entity, gap_start, gap_end).

    Only rows with entity, both times and end > start count; touching intervals are one period. Lists of blocks need of earlier ones
    only how far those reach, so above the blocks that number is combined instead of the lists: windows hold one number per block of an
    entity, and the outcome is the same as that of merging whole lists. Repeated rows change nothing; empty tables give empty results;
    an entity with one period has no pause. The entity keeps its name and type in the results; other columns are ignored.
    """
    kind = df.schema[entity].dataType
    lists = materialise(disjoint_lists(df, entity, start, end, block_s), "lists")
    by_block = Window.partitionBy("_e").orderBy("_block")
    reach = lists.select("_e", "_block", F.max(F.element_at("_z", -1)).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"))
    # what begins after everything before it has ended opens a period; the rest prolongs the one that reaches into the block
    n = F.when(F.col("_reach").isNull(), 0).otherwise(F.size(F.filter("_s", lambda s: s <= F.col("_reach"))))
    split = lists.join(reach, ["_e", "_block"]).withColumn("_n", n).select(
        "_e", "_block", F.slice("_s", F.col("_n") + 1, F.size("_s")).alias("_s"), F.slice("_z", F.col("_n") + 1, F.size("_s")).alias("_z"),
        F.when(F.col("_reach").isNotNull(), F.greatest("_reach", F.when(F.col("_n") > 0, F.try_element_at("_z", F.greatest(F.col("_n"), F.lit(1)))))).alias("_cover"),
    )
    opened = split.where(F.size("_s") > 0)
    first = F.col("_cover").isNull()
    ends = F.slice("_z", F.lit(1), F.size("_z") - 1)
    gap_a = F.when(first, ends).otherwise(F.concat(F.array("_cover"), ends))
    gap_b = F.when(first, F.slice("_s", F.lit(2), F.size("_s"))).otherwise(F.col("_s"))
    back = F.col("_e").cast(kind).alias(entity)
    pauses = opened.select("_e", F.explode(F.arrays_zip(gap_a.alias("a"), gap_b.alias("b"))).alias("_g")).select(back, F.col("_g.a").alias("gap_start"), F.col("_g.b").alias("gap_end"))
    # a block's last open interval ends where the next block that opens one says its cover ends, else at the entity's last reach
    total = F.max(F.element_at("_z", -1)).over(Window.partitionBy("_e"))
    last = lists.select("_e", "_block", total.alias("_total"))
    close = opened.select("_e", "_block", F.lead("_cover").over(by_block).alias("_next"))
    finish = F.concat(ends, F.array(F.coalesce("_next", "_total")))
    periods = opened.join(close, ["_e", "_block"]).join(last, ["_e", "_block"]).select("_e", F.explode(F.arrays_zip(F.col("_s").alias("a"), finish.alias("b"))).alias("_p"))
    return periods.select(back, F.col("_p.a").alias("period_start"), F.col("_p.b").alias("period_end")), pauses
