"""Splits, scaling, baselines and exact ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, width


def hash_split(key: Column, train: float = 0.8, seed: int = 42) -> Column:
    """True for the training part; all rows of a key fall on one side."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(train * 1_000_000)


def standardise(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """(x - mean) / population deviation, both of the rows of fit_on; a constant column is only centred."""
    s = df.where(fit_on).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(F.broadcast(s), F.lit(True))  # one row
    scale = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return joined.select(*[((F.col(c) - F.col(f"_m_{c}")) / scale[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def running_totals(per: DataFrame, key: str, columns: list[str], descending: bool = False) -> DataFrame:
    """per (distinct keys) with r_<column>: the column's sum over all rows up to and including this one, in the order of the key.

    Keys are cut into ranges of about equal numbers of rows; each range sums by itself and takes the offset of those before it, so no task
    holds the whole order however the keys crowd."""
    order = F.desc(key) if descending else F.asc(key)
    cut = materialise(per.repartitionByRange(width(per.sparkSession), order).withColumn("_piece", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("_piece").agg(*[F.sum(c).alias(f"_o_{c}") for c in columns])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of a shuffle
    offsets = sums.select("_piece", *[F.coalesce(F.sum(f"_o_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    here = Window.partitionBy("_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, "_piece").select(*per.columns, *[(F.sum(c).over(here) + F.col(f"_o_{c}")).alias(f"r_{c}") for c in columns])


def exact_median(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """The exact median of a column without NULL and NaN, one row (NULL if there is none): the values at the middle ranks, found by
    range-partitioned running counts instead of one task with all values."""
    per = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    run = running_totals(per, "v", ["n"])
    total = run.agg(F.sum("n").alias("_t"))
    lower, upper = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    holds = lambda k: (F.col("r_n") - F.col("n") <= k) & (F.col("r_n") > k)
    return run.join(F.broadcast(total), F.lit(True)).agg(((F.max(F.when(holds(lower), F.col("v"))) + F.max(F.when(holds(upper), F.col("v")))) / 2).alias(name))


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, from the highest: positives and rows there and above (tp, n), with the totals.

    Rows are reduced to distinct scores before the running sums."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("c"))
    run = running_totals(per, "s", ["p", "c"], descending=True)
    total = run.agg(F.sum("p").alias("pos"), F.sum("c").alias("all"))  # one row
    return run.join(F.broadcast(total), F.lit(True)).select("s", "p", "c", F.col("r_p").alias("tp"), F.col("r_c").alias("n"), "pos", "all")


def ranking_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """auroc (ties count half), average_precision (sum of recall steps times precision), accuracy at the cut. One row."""
    c = _curve(df, score, label)
    neg = F.col("all") - F.col("pos")
    here = F.col("c") - F.col("p")
    return c.agg(
        F.try_divide(F.sum(here * (F.col("tp") - F.col("p") / 2)), F.first(neg * F.col("pos"))).alias("auroc"),
        F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("n")), F.first("pos")).alias("average_precision"),
        F.try_divide(F.sum(F.when(F.col("s") >= cut, F.col("p")).otherwise(here)), F.first("all")).alias("accuracy"),
    )


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of the best F1 (ties: the lower threshold) with its sensitivity, specificity, ppv and npv. One row."""
    c = _curve(df, score, label)
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("n") + F.col("pos"))
    tn = F.col("all") - F.col("pos") - (F.col("n") - F.col("tp"))
    row = F.struct(
        f1.alias("f1"), (-F.col("s")).alias("_o"), F.col("s").alias("threshold"), F.try_divide(F.col("tp"), F.col("pos")).alias("sensitivity"),
        F.try_divide(tn, F.col("all") - F.col("pos")).alias("specificity"), F.try_divide(F.col("tp"), F.col("n")).alias("ppv"), F.try_divide(tn, F.col("all") - F.col("n")).alias("npv"),
    )
    return c.agg(F.max(row).alias("b")).select("b.threshold", "b.f1", "b.sensitivity", "b.specificity", "b.ppv", "b.npv")


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """mse, rmse, mae, r2. One row."""
    e = F.col(y) - F.col(pred)
    m = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return m.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"))


def baselines(df: DataFrame, target: str) -> DataFrame:
    """Mean and most frequent value of the target (ties: the smallest). One row."""
    n = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return n.agg((F.sum(F.col(target) * F.col("n")) / F.sum("n")).alias("mean_target"), F.min(F.struct((-F.col("n")).alias("n"), F.col(target).alias("v"))).alias("m")).select("mean_target", F.col("m.v").alias("majority"))
