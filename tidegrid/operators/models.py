"""Linear models on flattened windows, with the regularisation scaled as in the usual single-machine formulations."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_windows(df: DataFrame, x: str = "x") -> DataFrame:
    """Adds `features`, the vector of a window's flattened values; missing values are 0."""
    flat = F.transform(F.flatten(x), lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))
    return df.withColumn("features", array_to_vector(flat))


def logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    """L2 logistic regression with inverse strength c, no internal scaling."""
    n = train.count()
    return LogisticRegression(labelCol="y", featuresCol="features", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(train)


def linear(train: DataFrame, penalty: str = "ridge", alpha: float = 1.0):
    """ridge, lasso, elasticnet (half and half) or none."""
    n = train.count()
    reg, mixed = {"ridge": (alpha / max(n, 1), 0.0), "lasso": (alpha, 1.0), "elasticnet": (alpha, 0.5), "none": (0.0, 0.0)}[penalty]
    return LinearRegression(labelCol="y", featuresCol="features", regParam=reg, elasticNetParam=mixed, standardization=False).fit(train)


def scores(model, df: DataFrame, classification: bool = True) -> DataFrame:
    """df with `score`: the probability of class 1, or the prediction."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1] if classification else F.col("prediction"))
