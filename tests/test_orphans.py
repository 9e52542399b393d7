from pyspark.sql import functions as F

from tidegrid.operators.orphans import Edge, Graph, Node, orphan_cascade, orphan_report


def graph(spark, a, b, c):
    sa = spark.createDataFrame(a, "aid BIGINT, t DOUBLE, gone DOUBLE, rec_id STRING")
    sb = spark.createDataFrame(b, "bid BIGINT, aid BIGINT, t DOUBLE, kind STRING")
    sc = spark.createDataFrame(c, "cid BIGINT, bid BIGINT, t DOUBLE, depth INT")
    at = F.col("t")
    return Graph(
        {"a": Node(sa, "aid", at, "aid", at, F.col("gone")), "b": Node(sb, "bid", at, "bid", at), "c": Node(sc, "cid", at)},
        [Edge("b", "aid", "a"), Edge("c", "bid", "b")],
    )


def found(g):
    return sorted((r.src_table, r.rec_id, r.kind, r.depth) for r in orphan_cascade(g).collect())


def test_direct_late_deleted_inherited(spark):
    a = [(1, 0.0, None, ""), (2, 50.0, None, ""), (3, 0.0, 5.0, ""), (1, 0.0, None, "")]
    b = [(10, 1, 9.0, ""), (20, 2, 9.0, ""), (30, 3, 9.0, ""), (40, None, 9.0, ""), (50, 7, 9.0, ""), (20, 2, 9.0, "")]
    c = [(100, 10, 10.0, 0), (200, 20, 10.0, 0), (300, 99, 10.0, 0), (400, None, 10.0, 0), (500, 40, 10.0, 0)]
    assert found(graph(spark, a, b, c)) == [("b", 20, "direct", 0), ("b", 30, "direct", 0), ("b", 50, "direct", 0), ("c", 200, "inherited", 1), ("c", 300, "direct", 0)]


def test_one_sound_version_is_enough(spark):
    """b 10 has a version that stands on nothing and one that stands; b 20 has orphans only, of which one is withdrawn before c is stored."""
    sa = spark.createDataFrame([(1, 0.0)], "aid BIGINT, t DOUBLE")
    sb = spark.createDataFrame([(10, 9, 1.0, None), (10, 1, 2.0, None), (20, 9, 1.0, None), (20, 1, 2.0, 5.0)], "bid BIGINT, aid BIGINT, t DOUBLE, gone DOUBLE")
    sc = spark.createDataFrame([(100, 10, 10.0), (101, 10, 1.5), (200, 20, 10.0), (201, 20, 4.0)], "cid BIGINT, bid BIGINT, t DOUBLE")
    at = F.col("t")
    g = Graph({"a": Node(sa, "aid", at, "aid", at), "b": Node(sb, "bid", at, "bid", at, F.col("gone")), "c": Node(sc, "cid", at)}, [Edge("b", "aid", "a"), Edge("c", "bid", "b")])
    assert found(g) == [("b", 10, "direct", 0), ("b", 20, "direct", 0), ("c", 101, "inherited", 1), ("c", 200, "inherited", 1)]


def test_hierarchy_inside_a_table(spark):
    """A chain of records that refer to the one before: all hang on the first, which refers to nothing that is there. A cycle stands."""
    data = [(1, 0)] + [(k, k - 1) for k in range(2, 7)] + [(50, None), (51, 50), (70, 71), (71, 70)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in data], "id BIGINT, up BIGINT, t DOUBLE")
    at = F.col("t")
    g = Graph({"n": Node(df, "id", at, "id", F.lit(0.0))}, [Edge("n", "up", "n")])
    assert found(g) == [("n", 1, "direct", 0)] + [("n", k, "inherited", k - 1) for k in range(2, 7)]


def test_missing_times_and_empty_tables(spark):
    assert found(graph(spark, [(1, None, None, "")], [(1, 1, 0.0, ""), (2, 1, None, "")], [])) == [("b", 2, "direct", 0)]
    assert found(graph(spark, [], [(1, 1, 0.0, "")], [(5, 1, 0.0, 1)])) == [("b", 1, "direct", 0), ("c", 5, "inherited", 1)]
    assert found(graph(spark, [], [], [])) == []


def test_report(spark):
    g = graph(spark, [], [(1, 1, 0.0, ""), (2, 1, 86400.0 * 40, ""), (3, 1, None, "")], [])
    assert {(r.month, r.n) for r in orphan_report(orphan_cascade(g)).collect()} == {("1970-01", 1), ("1970-02", 1), (None, 1)}
