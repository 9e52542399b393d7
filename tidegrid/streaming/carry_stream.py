"""Streaming twins: windowed means with late data, and sample-and-hold as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_means(events: DataFrame, entity: str, concept: str, time: str, value: str, step: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Mean per entity, concept and tumbling window; rows later than the watermark are left out."""
    return (
        events.withWatermark(time, late)
        .groupBy(entity, concept, F.window(time, step))
        .agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
        .select(entity, concept, F.col("window.start").cast("double").alias("window_start"), "mean_value", "n")
    )


def hold_stream(events: DataFrame, entity: str, time: str, value: str, hold_s: float, late: str = "1 day") -> DataFrame:
    """Each row with its value, or the entity's last value if that was observed 0 to hold_s seconds before.

    time: epoch seconds. The state of an entity is its latest value; it ends with the watermark once nothing can take that value any more, so
    state follows the entities that are active. Rows of a micro-batch are put in order together. A row that comes late (within `late`, else
    Spark may leave it out) takes a value from before it in its own batch, never one from its future, and does not set the clock back;
    what the state no longer remembers gives NULL. NULL and NaN are no values; rows without entity or time are left out.
    Result: e, t, held.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, last = state.get if state.exists else (float("-inf"), float("nan"))
        pdf = pd.concat(list(frames)).sort_values("t", kind="stable")
        known = pdf["v"].notna()
        seen_at, seen = pdf["t"].where(known).ffill().fillna(float("-inf")), pdf["v"].ffill()
        old = (at <= pdf["t"]) & (at > seen_at)  # the state is newer than anything in the batch before the row
        seen_at, seen = seen_at.mask(old, at), seen.mask(old, last)
        yield pd.DataFrame({"e": key[0], "t": pdf["t"], "held": seen.where(pdf["t"] - seen_at <= hold_s)})
        if known.any() and (new := pdf[known].iloc[-1])["t"] >= at:
            at, last = float(new["t"]), float(new["v"])
        if at > float("-inf"):
            state.update((at, last))
            state.setTimeoutTimestamp(max(int((at + hold_s) * 1000), state.getCurrentWatermarkMs()) + 1)

    v = F.col(value).cast("double")
    src = events.select(F.col(entity).alias("e"), F.col(time).cast("double").alias("t"), F.when(~F.isnan(v), v).alias("v")).where("e IS NOT NULL AND t IS NOT NULL")
    src = src.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return src.groupBy("e").applyInPandasWithState(step, "e BIGINT, t DOUBLE, held DOUBLE", "at DOUBLE, last DOUBLE", "append", GroupStateTimeout.EventTimeTimeout)
