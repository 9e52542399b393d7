"""Anchor of an entity: the first treatment that a sample lies near enough to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closest import closest_event

HOUR = 3600.0


def first_anchor(treatments: DataFrame, samples: DataFrame, entity: str, t_id: str, t_time: str, s_id: str, s_time: str, after_h: float = 24.0, before_h: float = 72.0) -> DataFrame:
    """(entity, onset_time): of the treatments in order of time, the first whose nearest sample qualifies.

    The nearest sample (ties: the earlier, then the smaller id) qualifies if the treatment comes first by at most after_h hours, which
    gives the treatment's time, or else the sample comes first by at most before_h hours, which gives the sample's. Nearest neighbours
    beyond both limits never qualify, so pairs are searched within them only.
    """
    near = closest_event(treatments, samples, entity, t_id, t_time, s_id, s_time, HOUR * max(after_h, before_h))
    lead = F.col("right_time") - F.col("left_time")
    at = F.when((lead >= 0) & (lead <= after_h * HOUR), F.col("left_time")).when((lead <= 0) & (-lead <= before_h * HOUR), F.col("right_time"))
    pairs = near.select(entity, t_id, "left_time", at.alias("onset_time")).where("onset_time IS NOT NULL")
    return pairs.groupBy(entity).agg(F.min(F.struct("left_time", t_id, "onset_time")).alias("f")).select(entity, "f.onset_time")
