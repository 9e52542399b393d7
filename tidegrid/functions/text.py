"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(col: Column) -> Column:
    """Runs of white space to one blank, none outside."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def document_json(**fields: Column) -> Column:
    """One JSON object per row."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
