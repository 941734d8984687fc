"""Counts by value, and the index of topics without items that are none."""

from quillspark.operators import graphs, relational


def test_histograms(spark):
    rows = spark.createDataFrame([("a", 1, 7), ("a", 1, 7), ("a", 2, None), (None, 1, 8)], "kind string, size int, who long")
    found = {(r["field"], r["value"]): (r["n"], r["users"]) for r in relational.histograms(rows, ["kind", "size"], "who").collect()}
    assert found == {("kind", "a"): (3, 1), ("kind", None): (1, 1), ("size", "1"): (3, 2), ("size", "2"): (1, 0)}
    assert relational.histograms(rows.where("false"), ["kind"], "who").count() == 0


def test_topic_index_guards(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (-1, "a"), (None, "a")], "item long, topic string")
    assert [(r["item"], r["topics"], r["n"]) for r in graphs.topic_index(rows).collect()] == [(1, ["a", "b"], 2)]
