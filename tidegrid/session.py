"""Session helpers: configuration, shared folder, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` uses `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    if not (path := sc.getConf().get("spark.checkpoint.dir", "")):
        if (own := sc.getCheckpointDir()) is not None:
            return own
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidegrid-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_MADE: list[tuple[str, str | None]] = []  # paths of intermediates, with the table that lies there


def scratch_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((path, table))
    return path


def drop_intermediates(spark: SparkSession) -> int:
    """Delete all intermediates written so far, and their tables; how many. Results that were not collected or written yet need them: call it
    when a query's result is safe."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path, table = _MADE.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return n


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle whose number must be fixed beforehand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting at most max_rows + 1 rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bucketed(df: DataFrame, name: str, *keys: str, partition_by: str | None = None, hashed: bool = False) -> DataFrame:
    """Write rows hashed by `keys` as a bucketed table in the shared folder and return it: later joins, windows and groupings on the keys
    need no shuffle, the lineage is cut and lost executors cost nothing. hashed: the rows already lie in width() partitions by the keys.
    """
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", width(spark)
    w = (df if hashed else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", scratch_path(spark, name, table))
    (w.partitionBy(partition_by) if partition_by else w).saveAsTable(table)
    return spark.table(table)
