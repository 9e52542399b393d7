"""Table sources: one reader per format, NaN made NULL on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views of the tables."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "|", header: bool = True) -> DataFrame:
    """Delimited text with a declared schema; codes keep their leading zeros."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table or query; with key and bounds it is read in parallel ranges. Credentials go into options."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if key and bounds:
        r = r.option("dbtable", f"({query}) q").option("partitionColumn", key).option("numPartitions", parts)
        return r.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).load()
    return r.option("query", query).load()


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON concept dictionary {concept: {codes, unit, category, hold_time}} as rows (code, concept, unit, category, hold_s).

    Read by Spark, so from any file system; a missing hold_time (hours), unit or category gives NULL."""
    entry = "MAP<STRING, STRUCT<codes: ARRAY<STRING>, unit: STRING, category: STRING, hold_time: DOUBLE>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("concept", "x"))
    return whole.select(F.explode("x.codes").alias("code"), "concept", "x").select(F.col("code").cast("bigint").alias("code"), "concept", "x.unit", "x.category", (F.col("x.hold_time") * 3600).alias("hold_s"))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN counts as missing; by default in every floating column."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def epoch(col: str) -> F.Column:
    """Seconds since 1970 as DOUBLE, fractions kept."""
    return F.col(col).cast("timestamp").cast("double")
