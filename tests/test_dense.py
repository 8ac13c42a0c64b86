"""Blocked dense retrieval against all pairs, and bootstrap means against draws in a loop."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import dense
from quern.plans import reports
from quern.plans.reports import drawn_means

SHAPE = "id long, label long, vector array<float>"


@pytest.mark.parametrize("sizes", [(7, 3), (1000, 1000)])
def test_dense_blocks(spark, monkeypatch, sizes):
    monkeypatch.setattr(dense, "VECTORS", sizes[0])
    monkeypatch.setattr(dense, "QUERIES", sizes[1])
    rng = np.random.default_rng(1)
    made = rng.integers(-2, 3, (60, 4))  # many ties
    rows = [(i, None if i % 11 == 0 else i % 4 if i < 50 else 100 + i, [float(x) for x in v]) for i, v in enumerate(made)]
    vectors = spark.createDataFrame([*rows, (None, 1, [1.0] * 4), (99, 1, None)], SHAPE)
    queries = vectors.where("id % 5 = 0 OR id = 99")
    wanted_best, wanted_gold = set(), set()
    for i, label, v in rows[::5]:
        order = sorted(((-float(np.dot(v, w)), j, m) for j, m, w in rows if j != i))
        wanted_best |= {(i, j, label, m, -s, k) for k, (s, j, m) in enumerate(order[:6], 1)}
        gold = [k for k, (_, _, m) in enumerate(order, 1) if m is not None and m == label]
        wanted_gold.add((i, len(gold), sum(k <= 6 for k in gold), gold[0] if gold else None, len(order)))
    blocks = dense.scored_blocks(vectors, queries)
    assert {tuple(r) for r in dense.best(blocks, 6).select("question_id", "doc_id", "wanted", "label", "score", "rank").collect()} == wanted_best
    assert {tuple(r) for r in dense.gold_ranks(blocks, 6).select("question_id", "n_gold", "n_found", "first_gold", "n").collect()} == wanted_gold


def test_dense_of_nothing(spark):
    vectors = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], SHAPE)
    assert dense.best(dense.scored_blocks(vectors, vectors.limit(0)), 5).count() == 0
    assert dense.best(dense.scored_blocks(vectors.limit(0), vectors), 5).count() == 0
    assert dense.gold_ranks(dense.scored_blocks(vectors.where("id = 1"), vectors.where("id = 1")), 5).first()["first_gold"] is None


def test_drawn_means(spark):
    rows = [("a", k, None if k % 4 == 0 else float(k)) for k in range(9)] + [("b", 0, 2.0), ("c", 0, None)]
    got = {(r.g, r.b): r["mean"] for r in drawn_means(spark.createDataFrame(rows, "g string, k long, x double"), ["g"], "x", 5, "s").collect()}
    for g in "abc":
        values = [x for h, _, x in rows if h == g]
        for b in range(5):
            drawn = [values[int(hashlib.md5(f"s:{b}:{i}".encode()).hexdigest()[:8], 16) % len(values)] for i in range(len(values))]
            drawn = [x for x in drawn if x is not None]
            assert got[g, b] == (pytest.approx(sum(drawn) / len(drawn)) if drawn else None)


def test_draws_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(reports, "DRAWS", 100)
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("k"), F.col("id").cast("double").alias("x")).coalesce(1)
    found = reports.drawn_means(rows, ["g"], "x", 2, "s")
    assert found.count() == 4
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 3 and "RoundRobinPartitioning(21)" in text
    assert "SortMergeJoin" in text.split("RoundRobin")[0]


def test_products_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dense, "SCORES", 90, raising=False)
    vectors = spark.createDataFrame([(i, i % 3, [float(i % 7), 1.0]) for i in range(30)], SHAPE)
    parts = dense._products(dense.scored_blocks(vectors, vectors.where("id < 10")), lambda row, asked, wanted, ids, labels, scores: pd.DataFrame({"n": [scores.size], "rows": [len(asked)]}), "n long, rows long")
    assert sorted(tuple(r) for r in parts.collect()) == [(30, 1), (90, 3), (90, 3), (90, 3)]
    best = dense.best(dense.scored_blocks(vectors, vectors.where("id < 10")), 2).where("question_id = 3").orderBy("rank")
    assert [(r.doc_id, r.score) for r in best.collect()] == [(6, 19.0), (13, 19.0)]
