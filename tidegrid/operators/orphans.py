"""References to records that do not exist, direct and inherited."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

OUT = ["src_table", "ref_col", "rec_id", "parent_table", "kind", "depth", "seen_at"]


@dataclass(frozen=True)
class Node:
    """A table of the graph. key: what children refer to; rec: identifies its rows; seen: epoch seconds when a row was stored;
    live_from, live_to: epoch seconds between which a row exists for its children (live_to NULL: still there)."""

    df: DataFrame
    rec: str
    seen: Column
    key: str | None = None
    live_from: Column | None = None
    live_to: Column | None = None


@dataclass(frozen=True)
class Edge:
    """child.ref refers to parent's key."""

    child: str
    ref: str
    parent: str


@dataclass
class Graph:
    nodes: dict[str, Node]
    edges: list[Edge] = field(default_factory=list)


def _rows(graph: Graph, name: str) -> DataFrame:
    """The distinct rows of a table as far as the graph is concerned: rec_id, seen_at, what they are to their children (own, lo, hi), their
    references (ref0, ref1, ...) and `row`, a 128-bit hash of all that."""
    node = graph.nodes[name]
    none = F.lit(None).cast("double")
    refs = sorted({e.ref for e in graph.edges if e.child == name})
    own = F.col(node.key).cast("string") if node.key else F.lit(None).cast("string")
    lo, hi = (none if x is None else x.cast("double") for x in (node.live_from, node.live_to))
    d = node.df.select(F.col(node.rec).cast("bigint").alias("rec_id"), node.seen.cast("double").alias("seen_at"), own.alias("own"), lo.alias("lo"), hi.alias("hi"), *[F.col(r).cast("string").alias(f"ref{k}") for k, r in enumerate(refs)]).distinct()
    return d.withColumn("row", F.struct(F.xxhash64(*d.columns, F.lit(1)).alias("a"), F.xxhash64(*d.columns, F.lit(2)).alias("b")))


def _alive() -> Column:
    """The parent's version existed when the child was stored. A child without that time matches no version;
    a version without a start is one that was always there."""
    return (F.col("c.k") == F.col("p.own")) & (F.coalesce(F.col("p.lo"), F.lit(float("-inf"))) <= F.col("c.seen_at")) & (F.coalesce(F.col("p.hi"), F.lit(float("inf"))) > F.col("c.seen_at"))


def orphan_cascade(graph: Graph) -> DataFrame:
    """Orphan references over a graph of tables.

    direct: the key is not NULL and no version of the parent existed when the record was stored.
    inherited: versions existed, but each of them is a record which is itself an orphan, directly or by inheritance. One sound version
    is enough to stand on. Rounds semi-join the children with the versions orphaned in the round before and keep those without a sound
    version; they end when a round finds none, however deep the graph or the hierarchy inside a table is.

    One row per record, storing time and reference: src_table, ref_col, rec_id, parent_table, kind, depth (0 direct, n: found in round n),
    seen_at (epoch seconds). Repeated rows count once; of rows of a record stored at the same time with different keys the orphan of
    least depth is reported. NULL keys are no references. A record without storing time matches no version and is a direct orphan.
    Empty tables give no rows; an empty parent makes every reference an orphan. Records in a cycle of references that all stand are no
    orphans. Other columns are ignored, whatever their names.
    """
    rows = {n: materialise(_rows(graph, n), f"rows-{n}") for n in graph.nodes}
    place = lambda e: sorted({x.ref for x in graph.edges if x.child == e.child}).index(e.ref)

    def children(e: Edge) -> DataFrame:
        return rows[e.child].select("rec_id", "seen_at", "row", F.col(f"ref{place(e)}").alias("k")).where("k IS NOT NULL")

    def versions(name: str, orphans: DataFrame | None = None, how: str = "left_anti") -> DataFrame:
        """Versions of the table's rows; with orphans only those of the others (left_anti), or of the orphans (left_semi)."""
        v = rows[name].where("own IS NOT NULL")
        if orphans is not None:
            v = v.join(orphans.where(F.col("src_table") == name).select("row"), "row", how)
        return v.select("own", "lo", "hi").distinct()  # repeated versions collapse before the join with the children

    def result(df: DataFrame, e: Edge, depth: int) -> DataFrame:
        return df.select(F.lit(e.child).alias("src_table"), F.lit(e.ref).alias("ref_col"), "rec_id", F.lit(e.parent).alias("parent_table"), F.lit("inherited" if depth else "direct").alias("kind"), F.lit(depth).alias("depth"), "seen_at", "row")

    step = [result(children(e).alias("c").join(versions(e.parent).alias("p"), _alive(), "left_anti"), e, 0) for e in graph.edges]
    if not step:
        raise ValueError("the graph has no references")
    found = fresh = materialise(reduce(DataFrame.unionByName, step), "orphans-0")
    inner = [e for e in graph.edges if any(x.child == e.parent for x in graph.edges)]
    depth = 0
    while inner and not fresh.isEmpty():
        depth += 1
        step = []
        for e in inner:
            known = found.where((F.col("src_table") == e.child) & (F.col("ref_col") == e.ref)).select("row")
            c = children(e).join(known, "row", "left_anti").alias("c")
            touched = c.join(versions(e.parent, fresh, "left_semi").alias("p"), _alive(), "left_semi").alias("c")
            step.append(result(touched.join(versions(e.parent, found).alias("p"), _alive(), "left_anti"), e, depth))
        fresh = materialise(reduce(DataFrame.unionByName, step), f"orphans-{depth}")
        found = found.unionByName(fresh)
    best = found.groupBy("src_table", "ref_col", "rec_id", "parent_table", "seen_at").agg(F.min("depth").alias("depth"))
    return best.withColumn("kind", F.when(F.col("depth") > 0, "inherited").otherwise("direct")).select(*OUT)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and month of storing (NULL where the time is unknown)."""
    month = F.date_format(F.timestamp_seconds("seen_at"), "yyyy-MM")
    return orphans.groupBy("src_table", "ref_col", "kind", month.alias("month")).agg(F.count("*").alias("n"))
