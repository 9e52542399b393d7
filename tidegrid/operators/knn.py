"""Nearest-neighbour filling of gridded rows, in chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def fill_block(x: np.ndarray, rows: int = 256) -> np.ndarray:
    """Each NaN from the row that is nearest by mean squared difference over the columns both have, and has the column."""
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    out = x.copy()
    for a in range(0, len(x), rows):
        part = slice(a, a + rows)
        both = seen[part].astype(float) @ seen.T
        d = (z[part] ** 2) @ seen.T - 2 * z[part] @ z.T + seen[part].astype(float) @ (z.T**2)
        d = np.where(both > 0, d / np.maximum(both, 1), np.inf)
        for j in range(x.shape[1]):
            need = np.flatnonzero(~seen[part, j])
            if len(need) and seen[:, j].any():
                dj = np.where(seen[:, j], d[need], np.inf)
                best = dj.argmin(1)
                ok = np.isfinite(dj[np.arange(len(need)), best])
                out[a + need[ok], j] = x[best[ok], j]
    return out


def nearest_neighbour_fill(df: DataFrame, key: list[str], columns: list[str], chunk_rows: int = 9999) -> DataFrame:
    """Fill NULLs of the columns from the nearest row of the same chunk; distances on columns scaled by their deviation.

    Chunks are drawn by hash of the key and hold about chunk_rows rows, as many as the blueprint's: up to that size there is one chunk and
    the neighbour is the nearest of all rows; above, it is the nearest of about chunk_rows rows drawn at random. A row that shares no observed column
    with a row that has the value keeps its NULL. Equal distances take the row with the smaller key."""
    df = materialise(df, "rows")  # counted, scaled and filled from one computation
    s = df.agg(F.count("*").alias("_n"), *[F.stddev_pop(c).alias(c) for c in columns]).first()
    chunks = max(1, -(-s["_n"] // chunk_rows))
    scale = np.array([float(s[c]) if s[c] else 1.0 for c in columns])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        pdf[columns] = fill_block(pdf[columns].to_numpy(float) / scale) * scale
        return pdf.drop(columns="_chunk")

    cast = df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in df.columns])
    return cast.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks))).groupBy("_chunk").applyInPandas(fill, cast.schema)
