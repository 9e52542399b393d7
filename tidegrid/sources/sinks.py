"""Sinks: delimited text, parquet in buckets of an entity, JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """Delimited text with header; with `order` the files, read one after the other, are in that order (a range-partitioned sort)."""
    (df.orderBy(*order) if order else df).write.mode(mode).csv(path, sep=sep, header=True)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """A table bucketed by the entity, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Metric rows, appended after each experiment."""
    df.write.mode("append").csv(path, header=True)
