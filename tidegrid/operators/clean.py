"""Row-wise cleaning rules as generated expressions: one select, no loops over rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def out_of_bounds_to_null(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """NULL where a column lies below its lower or above its upper bound; NULL and NaN become NULL."""

    def rule(c: str, lo: float | None, hi: float | None) -> Column:
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        if lo is not None:
            ok &= F.col(c) >= lo
        if hi is not None:
            ok &= F.col(c) <= hi
        return F.when(ok, F.col(c))

    return df.withColumns({c: rule(c, lo, hi) for c, (lo, hi) in bounds.items()})


def clamp(col: Column, impossible: float, top: float) -> Column:
    """Above `impossible`: NULL; above `top`: top."""
    return F.when(col > impossible, F.lit(None)).when(col > top, F.lit(top)).otherwise(col)


def move_misplaced(df: DataFrame, source: str, target: str, above: float) -> DataFrame:
    """Values of source above the limit belong to target: moved where target is empty, dropped from source in any case."""
    wrong = F.col(source) > above
    return df.withColumns({target: F.when(wrong & F.col(target).isNull(), F.col(source)).otherwise(F.col(target)), source: F.when(~wrong, F.col(source))})


def fraction_to_percent(col: Column, top: float = 100.0, least: float = 20.0) -> Column:
    """Above top: NULL; below 1: a fraction, times 100; then below least: NULL."""
    pct = F.when(col > top, F.lit(None)).when(col < 1, col * 100).otherwise(col)
    return F.when(pct >= least, pct)


def first_match(rules: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Ordered CASE: the first rule that holds gives the value."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        return F.lit(None) if otherwise is None else otherwise
    return out if otherwise is None else out.otherwise(otherwise)


def by_threshold(col: Column, steps: Sequence[tuple[float, float]], strict: bool = False) -> Column:
    """Value of the smallest threshold that the column does not exceed; above all of them NULL."""
    return first_match([((col < t) if strict else (col <= t), F.lit(v)) for t, v in sorted(steps)])


def ordinal_score(col: Column, falling: Sequence[tuple[float, int]], last: int, missing: int = 0) -> Column:
    """Score of the first limit (tried in the given order) that the column reaches; below all of them `last`, NULL gives `missing`."""
    return F.when(col.isNull(), F.lit(missing)).otherwise(first_match([(col >= t, F.lit(s)) for t, s in falling], F.lit(last)))


def mutual_linear(df: DataFrame, a: str, b: str, slope: float, offset: float) -> DataFrame:
    """Fill b = a * slope + offset where b is missing, then a from b where a is; each step sees what the one before filled."""
    df = df.withColumn(b, F.coalesce(F.col(b), F.col(a) * slope + offset))
    return df.withColumn(a, F.coalesce(F.col(a), (F.col(b) - offset) / slope))


def half_up(col: Column, places: int = 3) -> Column:
    """Decimal rounding, half away from zero."""
    return F.round(col.cast("decimal(38,10)"), places).cast("double")
