"""What findings of size and of larger tables were about."""

import random

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import intervals, retrieval
from quern.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encounters_against_every_second(spark):
    rng = random.Random(5)
    rows = []
    for place, reach, longest in [(1, 20000, 900), (2, 4000, 40), (3, 9000, 9000)]:
        rows += [(place, rng.randrange(8), s, s + rng.randint(-1, longest)) for s in (rng.randrange(reach) for _ in range(40))]
    rows += [(4, None, 0, 50), (4, 1, 10, 40), (None, 1, 0, 9), (None, 2, 0, 9), (5, 1, 0, 20), (5, 1, 10, 30), (6, 1, 0, 10), (6, 2, 10, 20), (7, 1, 0, 9000), (7, 2, 10, 20), (7, 2, 8000, 8020)]
    wanted = set()
    for place in range(1, 8):
        there, run, last = {}, None, 30000
        for p, agent, start, stop in rows:
            if p == place and agent is not None:
                for t in range(start, stop):
                    there.setdefault(t, set()).add(agent)
        for t in range(last):
            now = there.get(t, set())
            if len(now) > 1:
                run = (t, now) if run is None else (run[0], run[1] | now)
            elif run:
                if t - run[0] >= 10:
                    wanted.add((place, run[0], t, len(run[1])))
                run = None
    found = intervals.encounters(spark.createDataFrame(rows, "place long, agent long, start long, stop long"), 10)
    assert {tuple(r) for r in found.collect()} == wanted
    assert "collect_set" not in plan(found)


def test_indexed_grid_reads_every_slice(spark, tmp_path):
    ids = spark.range(2500).withColumnRenamed("id", "doc_id")
    ids.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "de").otherwise("fr").alias("lang")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ids.select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 3 % 2).alias("toxic")).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.question_id: r.correct for r in catalogue.QUERIES["indexed_grid"](spark, str(tmp_path)).collect()}
    assert found == {f"q{i}": i % 3 == 0 for i in range(2500) if i % 5 and (i % 2 == 1 or i % 3 % 2 == 0)}


def test_references_are_found_in_growing_frames(spark):
    assert "unboundedfollowing" not in plan(catalogue.QUERIES["coref_first_reference"](spark, DATA)).lower()


def test_permission_items_sorts_few(spark):
    lines = [x.strip(" +-:*") for x in plan(catalogue.QUERIES["permission_items"](spark, DATA)).splitlines()]
    first = lambda name: next(i for i, x in enumerate(lines) if name in x)
    assert first("WindowGroupLimit") < first("BroadcastHashJoin")


def test_window_sums_go_down_the_ids(spark):
    e = [(1, 0, 0.1), (2, 5, 0.2), (3, 9, 0.3), (4, 10, 1e16), (5, 11, 1.0), (6, 12, -1e16), (7, 19, None), (8, 40, None)]
    samples = spark.createDataFrame(e[::-1], "event_id long, at long, value double").repartition(3)
    windows = spark.createDataFrame([(1, 0), (2, 5), (3, 40), (4, 100), (5, None)], "event_id long, at long")
    found = {r.event_id: (r.n, r.total, r.n_values, r.peak) for r in intervals.sampled_windows(samples, windows, 10).collect()}
    assert found == {1: (3, 0.3 + 0.2 + 0.1, 3, 0.3), 2: (5, -1e16 + 1.0 + 1e16 + 0.3 + 0.2, 5, 1e16), 3: (1, None, 0, None)}


def test_window_sums_go_down_the_times(spark):
    e = [(9, 0, 1.0), (8, 1, 1e16), (7, 2, 0.5), (6, 3, -1e16), (5, 3, 2.0), (4, 40, float("nan")), (3, 41, 1.0), (2, 60, 2.0), (2, 70, 3.0), (1, 60, None)]
    samples = spark.createDataFrame(e, "event_id long, at long, value double").repartition(3)
    windows = spark.createDataFrame([(9, 0), (8, 0), (4, 40), (2, 60), (2, 70)], "event_id long, at long")
    found = {r.event_id: (r.n, repr(r.total), r.n_values, repr(r.peak)) for r in intervals.sampled_windows(samples, windows, 10).collect()}
    first = (5, repr(-1e16 + 2.0 + 0.5 + 1e16 + 1.0), 5, "1e+16")
    assert found == {9: first, 8: first, 4: (2, "nan", 2, "nan"), 2: (3, "5.0", 2, "3.0")}


def test_word_lists_are_worked_out_once(spark):
    f1 = tx.multiset_f1(tx.word_list(F.col("a")), tx.word_list(F.col("b")))
    assert str(f1).count("regexp_replace") == 4  # two a list
    rows = spark.createDataFrame([("a a b", "a, a; a c"), ("", "a"), ("x", "y"), ("b b", "b")], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(f1).collect()] == [0.571429, 0, 0, 0.666667]


def test_foreign_pool_sorts_few(spark):
    found = plan(catalogue.QUERIES["foreign_pool"](spark, DATA))
    assert "last#" in found and "WindowGroupLimit" in found.split("last#")[0]


def test_bm25_scores_lie_with_their_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCS", 2, raising=False)
    docs = spark.createDataFrame([(0, 3, "a a b"), (0, 1, "c"), (0, 2, "b"), (1, 9, ""), (1, 8, None), (2, 5, "x")], "scope long, doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, "a a"), (2, 0, "none"), (3, 1, "a"), (4, 0, None), (5, 7, "a")], "question_id long, scope long, text string")
    found = retrieval.bm25(docs, asked)
    assert {(r.question_id, r.rank, r.doc_id, r.score > 0) for r in found.collect()} == {(1, 1, 3, True), (2, 1, 1, False), (3, 1, 8, False), (4, 1, 1, False)}
    moves = [x for x in plan(found).split("== Initial Plan ==")[0].splitlines() if " Exchange " in x]
    assert len(moves) == 2 and "REPARTITION_BY_NUM" in moves[1] and "doc_id" not in moves[0].split("hashpartitioning")[1].split(")")[0]
