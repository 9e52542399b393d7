from pyspark.sql import functions as F

from tidegrid.streaming.carry_stream import hold_stream, windowed_means

D = 86400


def drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "hr", 0, 5.0), (1, "hr", 3600, None), (1, "hr", 3 * 3600, None), (2, "hr", 7200, 7.0), (1, "hr", 40 * 3600, 9.0), (2, "hr", 90 * 3600, 1.0)]
    # a day after 1970: what lies at or before the first watermark would count as late
    df = spark.createDataFrame([(e, c, s + D, v) for e, c, s, v in rows], "e BIGINT, c STRING, s BIGINT, v DOUBLE").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(windowed_means(src, "e", "c", "ts", "v", "4 hours", "1 hour"), "means")
    got = {(r.e, r.window_start): r.mean_value for r in spark.table("means").collect()}
    assert got[1, D] == 5.0 and got[2, D] == 7.0
    drain(hold_stream(src, "e", "s", "v", 7200.0), "held")
    held = {(r.e, r.t - D): r.held for r in spark.table("held").collect()}
    assert held[1, 3600.0] == 5.0 and held[2, 7200.0] == 7.0
    assert held[1, 3 * 3600.0] is None or held[1, 3 * 3600.0] != held[1, 3 * 3600.0]


def test_late_rows_never_take_a_value_from_their_future(spark, tmp_path):
    """Two batches: the second brings a row from before the state's clock, a later one and an unordered pair."""
    schema = "e BIGINT, s DOUBLE, v DOUBLE"
    first = [(1, 0.0, 5.0), (1, 10_000.0, 8.0)]
    second = [(1, 9_000.0, None), (1, 10_500.0, None), (2, 50.0, None), (2, 20.0, 3.0), (1, 12_000.0, float("nan")), (None, 1.0, 1.0), (1, 20_000.0, None)]
    for rows in (first, second):
        spark.createDataFrame([(e, t + D, v) for e, t, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(hold_stream(src, "e", "s", "v", 3600.0), "late")
    got = {(r.e, r.t - D): None if r.held is None or r.held != r.held else r.held for r in spark.table("late").collect()}
    assert got[1, 9_000.0] is None and got[1, 10_500.0] == 8.0 and got[1, 12_000.0] == 8.0 and got[1, 20_000.0] is None
    assert got[2, 50.0] == 3.0 and len(got) == 8
