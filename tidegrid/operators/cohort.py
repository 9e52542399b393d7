"""Entities and their records: ordinals, first records, repeated visits, key resolution, rule flags, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ord") -> DataFrame:
    """Number of a row within its group, in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in the given order; reduced before the shuffle."""
    rest = [c for c in df.columns if c not in by and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*by).agg(F.min(packed).alias("_f")).select(*by, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])


def readmissions(df: DataFrame, subject: str, start: str, end: str, within_s: float) -> DataFrame:
    """Adds re_admission: 1 if the entity's previous distinct end lies at most within_s before the start, else 0.

    The previous end is that of the visit with the next smaller end, so overlapping visits count as well."""
    ends = df.select(subject, end).dropna().distinct()
    prev = ends.withColumn("_prev", F.lag(end).over(Window.partitionBy(subject).orderBy(end)))
    near = F.coalesce(F.col(start) - F.col("_prev") <= within_s, F.lit(False))
    return df.join(prev, [subject, end], "left").withColumn("re_admission", near.cast("int")).drop("_prev")


def resolve_keys(records: DataFrame, intervals: DataFrame, rec: str, link: str, time: str, key: str, start: str, end: str, order: str, pad_s: float) -> DataFrame:
    """The interval's key for each record (rec, key): same link, time within [start - pad, end + pad], or the link's only interval.

    Of several matches the last in `order` wins. Open ends (NULL) never hold a time. Records without match keep a NULL key."""
    n = Window.partitionBy(link)
    iv = intervals.select(link, F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), F.count("*").over(n).alias("_n"))
    hit = F.col(time).between(F.col("_s") - pad_s, F.col("_e") + pad_s) | (F.col("_n") == 1)
    return records.select(rec, link, time).join(iv, link, "left").groupBy(rec).agg(F.max_by(F.when(hit, F.col("_k")), F.when(hit, F.col("_o"))).alias(key))


def prefix_flags(codes: DataFrame, entity: str, code: str, rules: dict[str, Sequence[tuple[str | None, int, str, str]]], entities: DataFrame, version: str | None = None) -> DataFrame:
    """One 0/1 column per rule: does the entity have a code whose first k characters lie between lo and hi?

    rules: name -> (version, k, lo, hi); lo = hi for one prefix. The same code may mean different things in two code systems: a rule counts
    only for rows whose `version` column equals its version (None: for all rows). Codes split so into one column per version, which the
    rules of that version read. Entities without codes get 0; NULL codes and versions match no rule of a version."""
    named = sorted({v for triples in rules.values() for v, *_ in triples if v is not None})
    split = {v: F.when(F.col(version) == v, F.col(code)) for v in named} | {None: F.col(code)}
    flags = []
    for name, triples in rules.items():
        hit = F.lit(False)
        for v, k, lo, hi in triples:
            hit |= F.substring(split[v], 1, k).between(lo, hi)
        flags.append(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias(name))
    found = codes.groupBy(entity).agg(*flags)
    return entities.select(entity).distinct().join(found, entity, "left").fillna(0, list(rules))


def attach_notes(rows: DataFrame, stays: DataFrame, notes: DataFrame, entity: str, link: Sequence[str], note: str) -> DataFrame:
    """Rows with the ids of the notes of their entity: one row per note (fan-out), one with NULL where there is none.

    notes belong to stays by the link columns; only those of stays that occur in `rows` take part, which a semi-join settles first. NULL
    links match nothing; repeated stays or notes count once. A clashing column `note` of rows is replaced."""
    here = stays.select(entity, *link).distinct().join(rows.select(entity).distinct(), entity, "left_semi")
    kept = notes.select(*link, note).where(F.col(note).isNotNull()).distinct().join(here, list(link)).select(entity, note).distinct()
    return rows.drop(note).join(kept, entity, "left")


def exclude_early(df: DataFrame, entity: str, order: str, time: str, cond: Column, span_s: float) -> DataFrame:
    """Drop entities whose first row (in `order`) meets the condition and whose rows span at most span_s seconds. An unknown condition is not met."""
    first = df.groupBy(entity).agg(F.min_by(F.coalesce(cond, F.lit(False)), order).alias("_c"), (F.max(time) - F.min(time)).alias("_d"))
    return df.join(first.where(F.col("_c") & (F.col("_d") <= span_s)).select(entity), entity, "left_anti")


def exclude_any(df: DataFrame, entity: str, cond: Column) -> DataFrame:
    """Drop all rows of entities of which any row meets the condition."""
    return df.join(df.where(cond).select(entity).distinct(), entity, "left_anti")


def require_any(df: DataFrame, entity: str, cond: Column) -> DataFrame:
    """Keep only entities of which some row meets the condition."""
    return df.join(df.where(cond).select(entity).distinct(), entity, "left_semi")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULL per column (column_name, missing), the largest first."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "missing").orderBy(F.desc("missing"), "column_name")


def drop_sparse(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Without the columns of which the threshold's share or more is NULL; needs one aggregate."""
    gone = [r.column_name for r in missing_profile(df, columns).where(F.col("missing") >= threshold).collect()]
    return df.drop(*gone)
