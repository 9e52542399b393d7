"""Carrying values along time: sample and hold with time to live, interpolation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hold_values(df: DataFrame, entity: str, time: str, hold_s: Mapping[str, float], tie: str | None = None, blocks: int = 4) -> DataFrame:
    """Fill NULLs of each column with the last value observed at most hold_s seconds before; held values do not renew the clock.

    Entities are cut into blocks of time of `blocks` times the longest hold; rows near a block's end are repeated as context of the next,
    so a busy entity spreads over tasks and nothing is carried farther than its hold. Rows without entity or time stay as they are.
    """
    longest = max(hold_s.values())
    size = longest * blocks
    own = F.floor(F.col(time) / size)
    spread = df.withColumn("_own", own).withColumn("_b", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array_distinct(F.array("_own", F.floor((F.col(time) + longest) / size))))))
    w = Window.partitionBy(entity, "_b").orderBy(time, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c, h in hold_s.items():
        at = F.last(F.when(F.col(c).isNotNull(), F.col(time)), True).over(w)
        held = F.when(F.col(time) - at <= h, F.last(c, True).over(w))
        out[c] = F.when(F.col(entity).isNull(), F.col(c)).otherwise(F.coalesce(c, held))
    return spread.select("*", *[v.alias(f"_f_{c}") for c, v in out.items()]).where("_b IS NULL OR _b = _own").select(*[F.col(f"_f_{c}").alias(c) if c in out else F.col(c) for c in df.columns])


def interpolate_rows(df: DataFrame, entity: str, order: str, columns: list[str]) -> DataFrame:
    """Fill interior gaps of each column linearly by row number within the entity; leading and trailing gaps stay.

    Meant for gridded rows, of which an entity has few."""
    w = Window.partitionBy(entity).orderBy(order)
    num = df.withColumn("_n", F.row_number().over(w))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(entity).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(c).alias("v"))) for c in columns}
    step = num.select("*", *[F.last(x, True).over(back).alias(f"_p_{c}") for c, x in known.items()], *[F.last(x, True).over(ahead).alias(f"_q_{c}") for c, x in known.items()])

    def line(c: str) -> F.Column:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        return F.coalesce(F.col(c), F.when(p.isNotNull() & q.isNotNull(), p["v"] + (q["v"] - p["v"]) * (F.col("_n") - p["n"]) / (q["n"] - p["n"])))

    return step.select(*[line(c).alias(c) if c in columns else F.col(c) for c in df.columns])
