"""Attribute-value rows into one wide row per entity and time."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table; kind: 'double' or 'string'."""

    name: str
    kind: str


def narrow_tables(readings: DataFrame, entity: str, time: str, name: str = "narrow") -> DataFrame:
    """Write the cells of `readings` (entity, time, attribute, num, txt, stored, rid) as one typed narrow table per attribute.

    Cells are reduced before the shuffle: the value stored last wins (then the larger rid); n_values tells how many different usable
    values compete (2 stands for more). The tables are partitions of one bucketed table, hashed by (entity, time), so that every join
    between them is co-partitioned and a single busy entity spreads over all buckets. Returns the bucketed table.
    """
    usable = F.col("num").isNotNull() & ~F.isnan("num")
    cells = readings.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col("attribute").isNotNull()).select(
        F.col(entity).alias("e"), F.col(time).cast("bigint").alias("t"), "attribute",
        F.when(usable, F.col("num")).alias("num"), "txt", F.struct(F.coalesce(F.col("stored"), F.lit(float("-inf"))).alias("a"), F.col("rid").alias("b")).alias("o"),
    )
    agg = cells.groupBy("e", "t", "attribute").agg(
        F.max(F.when(F.col("num").isNotNull() | F.col("txt").isNotNull(), F.struct("o", "num", "txt"))).alias("v"),
        (F.when(F.min("num") < F.max("num"), 2).when(F.min("num").isNotNull(), 1).otherwise(0)).cast("int").alias("n_values"),
    )
    return bucketed(agg.select("e", "t", F.col("v.num").alias("num"), F.col("v.txt").alias("txt"), "n_values", "attribute"), name, "e", "t", partition_by="attribute")


def wide_table(readings: DataFrame, attributes: list[Attribute], entity: str, time: str, fan_in: int = 5) -> DataFrame:
    """One row per entity and whole second with one typed column per attribute, and `conflicts`: attributes with competing values.

    readings: columns entity, time, attribute, num, txt, stored (epoch seconds of storing), rid (breaks ties).
    Narrow tables are joined in a balanced tree: each node is a multiway outer join of at most fan_in children over the union of their
    keys; all tables are hashed by (entity, time), so the tree adds no shuffle of its own. Inner nodes are written in the same buckets,
    which keeps few sorts at a time in a task's memory.

    Rows without entity, time or attribute have no cell; attributes not asked for are left out; NaN is no value, yet its row's key stays
    in the result; a missing attribute gives a NULL column; an empty table gives an empty result with all columns.
    Repeated rows change nothing. Other columns of `readings` are ignored.
    """
    names = [a.name for a in attributes]
    stored = narrow_tables(readings.where(F.col("attribute").isin(names)), entity, time)

    def keys(group: list[str]) -> DataFrame:
        return stored.where(F.col("attribute").isin(group)).select("e", "t").distinct()

    def leaf(i: int, a: Attribute) -> tuple[DataFrame, list[str]]:
        value = F.col("num" if a.kind == "double" else "txt")
        return stored.where(F.col("attribute") == a.name).select("e", "t", value.alias(f"v{i}"), F.col("n_values").alias(f"n{i}")), [a.name]

    def join(children: list[tuple[DataFrame, list[str]]], inner: bool) -> tuple[DataFrame, list[str]]:
        if len(children) == 1:
            return children[0]
        covered = [n for _, ns in children for n in ns]
        node = keys(covered)
        for child, _ in children:
            node = node.join(child.hint("merge"), ["e", "t"], "left")
        return (bucketed(node, "node", "e", "t", hashed=True) if inner else node), covered

    level = [leaf(i, a) for i, a in enumerate(attributes)]
    while len(level) > 1:
        parts = -(-len(level) // fan_in)
        size = -(-len(level) // parts)  # balanced: children differ by one at most
        groups = [level[k : k + size] for k in range(0, len(level), size)]
        with ThreadPoolExecutor(max_workers=4) as pool:  # nodes of a level are independent jobs
            level = list(pool.map(lambda g: join(g, parts > 1), groups))
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 1, F.lit(a.name)) for i, a in enumerate(attributes)]))
    return level[0][0].select(
        F.col("e").alias(entity), F.col("t").alias(time), *[F.col(f"v{i}").alias(a.name) for i, a in enumerate(attributes)], conflicts.alias("conflicts")
    )
