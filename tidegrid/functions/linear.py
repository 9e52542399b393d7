"""Least squares as Spark aggregates: normal equations from mergeable means and covariances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _det(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def ridge3(df: DataFrame, keys: list[str], x: tuple[str, str, str], y: str, ridge: float) -> DataFrame:
    """y on three columns per group: keys, n, a (mean of y), m0..m2 (means of x), b0..b2.

    The equations are centred; covariances merge without loss, so a group of any size is reduced before the shuffle. The ridge falls with
    the number of rows and is relative to each column's variance; singular systems give b = 0, the group's mean.
    """
    at = [(i, j) for i in range(3) for j in range(i, 3)]
    m = df.groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("a"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in at], *[F.covar_pop(c, y).alias(f"y{i}") for i, c in enumerate(x)],
    )
    c = [[F.col(f"c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    for i in range(3):
        c[i][i] = c[i][i] * (1 + F.lit(ridge) / F.col("n")) + F.lit(1e-9)
    rhs, d = [F.col(f"y{i}") for i in range(3)], _det(c)
    b = [F.coalesce(F.try_divide(_det([[rhs[r] if k == j else c[r][k] for k in range(3)] for r in range(3)]), d), F.lit(0.0)) for j in range(3)]
    return m.select(*keys, "n", "a", "m0", "m1", "m2", *[v.alias(f"b{j}") for j, v in enumerate(b)])


def predict3(x: list[Column]) -> Column:
    """Prediction from a joined ridge3 model; NULL inputs count as the mean."""
    return F.col("a") + sum((F.col(f"b{j}") * F.coalesce(v - F.col(f"m{j}"), F.lit(0.0)) for j, v in enumerate(x)), F.lit(0.0))
