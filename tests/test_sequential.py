"""Interval differences, length matching, graph distances, balanced JSON and word changes."""

from pyspark.sql import functions as F

from quern.functions import spans
from quern.operators import graph, intervals


def test_without_cuts(spark):
    entries = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 110), (1, 3, 200, 210), (2, 4, 0, 10)], "agent long, event_id long, start long, stop long")
    cuts = spark.createDataFrame([(1, 10, 20), (1, 15, 40), (1, 90, 115), (2, 0, 3)], "agent long, start long, stop long")
    assert sorted(tuple(r) for r in intervals.without_cuts(entries, cuts).collect()) == [(1, 1, 0, 10), (1, 1, 40, 90), (1, 3, 200, 210), (2, 4, 3, 10)]


def test_length_matched(spark):
    targets = spark.createDataFrame([(1, "a", 10), (1, "b", 100), (2, "c", 5)], "item long, name string, length long")
    donors = spark.createDataFrame([(1, "x", 95), (1, "y", 12), (1, "z", 11)], "item long, name string, length long")
    assert sorted(tuple(r) for r in intervals.length_matched(targets, donors).collect()) == [(1, "a", "z", True), (1, "b", "x", True)]


def test_distances(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 5, 1.0), (8, 9, 1.0)], "source long, target long, weight double")
    found = graph.distances(edges, spark.createDataFrame([(1,)], "node long"), f"file://{tmp_path}/bfs")
    assert {r.node: r.steps for r in found.collect()} == {1: 0, 2: 1, 5: 1, 3: 2, 4: 3}


def test_balanced_json_and_changes(spark):
    cases = {'so {"a": [1, "}"]} end': '{"a": [1, "}"]}', "x ] [1": None, "[}] {}": "{}", "none": None, '[ "open': None, "{[1]}": "{[1]}"}
    table = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert [r[1] for r in table.select("t", spans.balanced_json("t")).collect()] == [*cases.values(), None]
    pair = spark.createDataFrame([("the meeting is at noon today", "the meeting is at six pm today"), (None, "x")], "a string, b string")
    got = [r[0] for r in pair.select(spans.changed_spans(F.col("a"), F.col("b"))).collect()]
    assert [[tuple(x) for x in r] for r in got] == [[("noon", "six pm")], []]
