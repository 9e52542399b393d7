"""What to do about missing values of gridded rows, decided by one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import carry, cohort, knn
from ..session import materialise


def fill_missing(df: DataFrame, entity: str, order: str, columns: list[str], drop_at: float = 0.8, interpolate_below: float = 0.05, chunk_rows: int = 9999) -> DataFrame:
    """Drop columns that miss drop_at or more; interpolate those that miss less than interpolate_below; nearest-neighbour fill for the rest.

    Interpolation runs within an entity. Columns that miss nothing take part in the distances only."""
    df = materialise(df, "gridded")
    missing = {r.column_name: r.missing or 0.0 for r in cohort.missing_profile(df, columns).collect()}
    kept = [c for c in columns if missing[c] < drop_at]
    df = df.drop(*[c for c in columns if c not in kept])
    few = [c for c in kept if 0 < missing[c] < interpolate_below]
    if few:
        df = carry.interpolate_rows(df, entity, order, few)
    return knn.nearest_neighbour_fill(df, [entity, order], kept, chunk_rows) if any(missing[c] >= interpolate_below for c in kept) else df


def feature_columns(df: DataFrame, target: str, never: tuple[str, ...] = ("stay_id", "timestep", "target"), treatments: tuple[str, ...] = (), with_treatments: bool = True) -> list[str]:
    """Columns that may predict the target: all but keys, the target and, without treatments, the treatment columns."""
    out = {target, *never} | (set() if with_treatments else set(treatments))
    return [c for c in df.columns if c not in out]
