import json
from pathlib import Path

from pyspark.sql import functions as F

from tidegrid import session
from tidegrid.sources import sinks, tables


def test_delimited_round_trip_keeps_codes(spark, tmp_path):
    df = spark.createDataFrame([(1, "002542", 1.5), (2, None, None)], "id BIGINT, gsn STRING, x DOUBLE")
    sinks.write_delimited(df, str(tmp_path / "a"))
    assert sorted(map(tuple, tables.read_delimited(spark, str(tmp_path / "a"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_concepts_documents_results(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"hr": {"unit": "bpm", "category": "vital", "codes": ["1", "2"], "hold_time": 2}}))
    assert [(r.code, r.concept, r.hold_s) for r in tables.read_concepts(spark, str(tmp_path / "c.json")).orderBy("code").collect()] == [(1, "hr", 7200.0), (2, "hr", 7200.0)]
    sinks.write_documents(spark.createDataFrame([(1, "x")], "id BIGINT, t STRING"), str(tmp_path / "d"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "d")).collect()] == [{"id": 1, "t": "x"}]
    for k in range(2):
        sinks.append_results(spark.createDataFrame([(k, 0.5)], "h INT, auroc DOUBLE"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2


def test_concepts_without_hold_time(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"hr": {"codes": [7]}, "none": {"codes": []}}, indent=1))
    assert [tuple(r) for r in tables.read_concepts(spark, str(tmp_path / "c.json")).collect()] == [(7, "hr", None, None, None)]


def test_ordered_sink(spark, tmp_path):
    df = spark.range(500).selectExpr("(id * 37) % 500 AS k", "CAST(id AS STRING) AS s")
    sinks.write_delimited(df, str(tmp_path / "o"), order=["k"])
    files = sorted((tmp_path / "o").glob("part-*"))
    keys = [int(line.split("|")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert keys == list(range(500))


def test_bucketed_sink_and_views(spark, tmp_path):
    sinks.write_bucketed(spark.range(100).selectExpr("id % 7 AS e", "id"), "traj_sink", str(tmp_path / "b"), "e", 4)
    plan = spark.table("traj_sink").groupBy("e").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and spark.table("traj_sink").count() == 100
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    tables.register(spark, str(tmp_path), ["t"])
    assert spark.sql("SELECT count(*) AS n FROM t").first().n == 3


def test_intermediates_can_be_dropped(spark):
    a = session.materialise(spark.range(3), "kept")
    b = session.bucketed(spark.range(5), "kept", "id")
    paths = [p for p, _ in session._MADE[-2:]]
    assert (a.count(), b.count()) == (3, 5) and all(Path(p.removeprefix("file:")).exists() for p in paths)
    assert session.drop_intermediates(spark) >= 2 and not any(Path(p.removeprefix("file:")).exists() for p in paths)


def test_nan_is_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x DOUBLE, s STRING"))
    assert df.where(F.col("x").isNull()).count() == 1


def test_jdbc_in_ranges(spark):
    """The database that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:readings;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(1, 101).selectExpr("id", "id % 7 AS g").write.jdbc(url, "readings", properties={"driver": driver})
    whole = tables.read_jdbc(spark, url, 'SELECT "id", "g" FROM readings WHERE "g" < 3', driver=driver)
    parts = tables.read_jdbc(spark, url, 'SELECT "id", "g" FROM readings WHERE "g" < 3', key="id", bounds=(1, 100), parts=4, driver=driver)
    assert parts.rdd.getNumPartitions() == 4 and sorted(r.id for r in whole.collect()) == sorted(r.id for r in parts.collect()) == [k for k in range(1, 101) if k % 7 < 3]
