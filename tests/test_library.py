"""Readers, sinks, text functions, intervals, graphs and streams on small tables."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import graph, intervals, retrieval, statistics
from quern.sources import readers, sinks
from quern.streaming import replay


def lines(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")
    return f"file://{path}"


def test_json_lines(spark, tmp_path):
    good = lines(tmp_path / "good.jsonl", [{"id": "a", "n": 1}, {"id": "b", "n": 2}])
    bad = lines(tmp_path / "bad.jsonl", [{"id": "a", "n": 1}, "{broken", {"id": "b", "n": 2}, {"id": "a", "n": 3}])
    assert readers.strict_lines(spark, good, "id string, n long").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_lines(spark, bad, "id string, n long").collect()
    assert {(r.id, r.n) for r in readers.tolerant_lines(spark, bad, "id string, n long", "id").collect()} == {("a", 3), ("b", 2)}
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as file:
        file.write('{"id": "z", "n": 9}\n')
    assert readers.strict_lines(spark, f"file://{tmp_path}/z.jsonl.gz", "id string, n long").first().n == 9


def test_sessions_and_messages(spark, tmp_path):
    turn = {"turn_id": "t1", "speaker_id": "ann_lee", "text": "hello", "timestamp": 3.25}
    rows = [{"session_id": "s1", "start_time": 3.2, "location_id": "loc_old_mill", "modality": "phone", "turns": [turn, {"speaker_id": "bo", "text": "hi"}, {"text": " "}]}, {"id": "s2", "turns": []}, "{", {"id": "s3", "start_time": 1.0, "turns": [{"text": "x"}]}]
    s = readers.sessions(spark, lines(tmp_path / "s.jsonl", rows))
    assert {r.session_id for r in s.collect()} == {"s1", "s3"}
    m = {r.msg_id: r for r in readers.session_messages(s).collect()}
    assert set(m) == {"t1", "s1_t1", "s3_t0"}
    assert m["t1"].text == "[Old Mill | phone]\n[Ann Lee]: hello" and (m["t1"].day, m["s1_t1"].day) == (3, 3)
    owners = readers.owner_sessions(spark, lines(tmp_path / "map.json", [{"ann": ["s1", "s3"], "bo": []}]))
    assert [(r.owner, r.position, r.session_id) for r in owners.collect()] == [("ann", 0, "s1"), ("ann", 1, "s3")]


def test_group_chats_and_canonical_names(spark, tmp_path):
    chat = {"dialogues": {"d2": {"g": [{"speaker": "b", "time": "10:00 x", "text": "later"}]}, "d1": {"h": [{"speaker": "a", "text": "1"}, {"speaker": "a", "text": "2"}], "g": [{"text": "0"}]}}}
    rows = readers.group_chats(spark, lines(tmp_path / "g.json", [chat])).orderBy("date", "group", "position").collect()
    assert [r.text for r in rows] == ["0", "1", "2", "later"] and [r.position for r in rows] == [0, 0, 1, 0] and rows[3].time == "10:00Tx"
    raw = spark.createDataFrame([(" ", "7", "t", "now", None), ("m", "8", None, "then", "soon")], "msg_id string, id string, content string, ts string, deliver_ts string")
    assert [tuple(r) for r in readers.canonical_messages(raw).collect()] == [("7", None, "t", "now", "now"), ("m", None, None, "then", "soon")]


def test_questions_telemetry_results(spark, tmp_path):
    items = spark.createDataFrame([("a", "q", "x", None, None), ("a", "q", "x", None, None), (None, " ", None, None, None), ("b", "q", None, ["1", "2"], "3"), ("c", "q", None, ["1"], "1")], "question_id string, question string, answer string, options array<string>, correct_option string")
    errors = sorted((r.question_id or "", r.error) for r in readers.question_errors(items).collect())
    assert errors == [("", "missing answer"), ("", "missing id"), ("", "missing question"), ("a", "repeated id"), ("a", "repeated id"), ("b", "correct option not among options")]
    csv = lines(tmp_path / "t.csv", ["ts,power", "1,2.5", "x,"])
    assert [tuple(r) for r in readers.telemetry(spark, csv, ["ts", "power"]).collect()] == [(1.0, 2.5), (0.0, 0.0)]
    cell = tmp_path / "runs" / "bm25" / "reader" / "s1"
    cell.mkdir(parents=True)
    (cell / "eval.json").write_text(json.dumps({"details": [{"question_id": "1", "correct": "True"}, {"question_id": "2", "correct": True, "judge_correct": False}, {"question_id": "3", "answer_scored": "False"}, {"question_id": "4", "raw_response": "LLM_ERROR x"}]}))
    got = readers.result_cells(spark, f"file://{tmp_path}/runs").orderBy("question_id").collect()
    assert [(r.backend, r.model, r.seed, r.question_id, r.correct) for r in got] == [("bm25", "reader", "s1", "1", True), ("bm25", "reader", "s1", "2", False)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    table = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0")], "name string, sha256 string")
    assert {r.name: r.fine for r in readers.checked_files(spark, f"file://{tmp_path}/f", table).collect()} == {"a.bin": True, "b.bin": False}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, f"v{i}") for i in range(6)], "k long, pos long, v string")
    sinks.write_table(rows, f"file://{tmp_path}/p", ["pos"], ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 6
    sinks.write_lines(rows, f"file://{tmp_path}/j")
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.json(f"file://{tmp_path}/j").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 6
    done = sinks.upserted(rows, spark.createDataFrame([(3, "new")], "k long, v string"), "k", "pos")
    assert {r.k: r.v for r in done.collect()} == {i: "new" if i == 3 else f"v{i}" for i in range(6)}
    with pytest.raises(Exception, match="unknown key 77"):
        sinks.upserted(rows, spark.createDataFrame([(77, "new")], "k long, v string"), "k", "pos").collect()


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_text_scores(spark):
    sets = lambda a, b: one(spark, tx.token_f1_bonus(tx.word_set(F.col("a")), tx.word_set(F.col("b"))), a=a, b=b)
    assert sets("collar", "Mrs. Gable's collar was found") == 1.0
    assert sets("", "") == 1.0 and sets("x", "") == 0.0 and sets("", "x") == 0.0
    assert sets("the red cat sat", "red cat") == 1.0
    assert sets("a b", "b c") == pytest.approx(0.5)
    multi = lambda a, b: one(spark, tx.multiset_f1(tx.word_list(F.col("a")), tx.word_list(F.col("b"))), a=a, b=b)
    assert multi("a a b", "a b b") == pytest.approx(2 / 3) and multi("", "a") == 0.0
    assert one(spark, tx.refuses(F.col("t")), t="No, I can't say") and one(spark, tx.refuses(F.col("t")), t="Nope!") and not one(spark, tx.refuses(F.col("t")), t="It is at noon")
    assert not one(spark, tx.refuses_for_privacy(F.col("t")), t="I don't know") and one(spark, tx.refuses_for_privacy(F.col("t")), t="That is confidential.")
    assert one(spark, tx.without_thinking(F.col("t")), t="<think>a</think>b<think>c") == "b"
    assert one(spark, tx.fact_leaked(F.col("g"), F.col("p")), g="routing number 021000021", p="it is 021000021") and not one(spark, tx.fact_leaked(F.col("g"), F.col("p")), g="routing number 021000021", p="routing number")
    assert one(spark, tx.entities(F.col("t")), t="met Ann Lee and Ann Lee at Old Mill") == ["Ann Lee", "Old Mill"]


def test_bm25_always_has_a_hit(spark):
    docs = spark.createDataFrame([(0, "a", "red fox"), (0, "b", "blue fox"), (0, "c", ""), (1, "d", "red")], "scope int, doc_id string, text string")
    queries = spark.createDataFrame([("q1", 0, "red"), ("q2", 0, "nothing"), ("q3", 1, "red red"), ("q4", 2, "red")], "question_id string, scope int, text string")
    found = {(r.question_id, r.doc_id): r.rank for r in retrieval.bm25(docs, queries).collect()}
    assert found == {("q1", "a"): 1, ("q2", "a"): 1, ("q3", "d"): 1}


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (1, 3, 20, 30), (1, 2, 20, 25), (2, 1, 0, 9)], "place long, agent long, start long, stop long")
    assert sorted(tuple(r) for r in intervals.encounters(rows).collect()) == [(1, 5, 10, 2), (1, 20, 25, 2)]
    assert intervals.encounters(rows.limit(0)).count() == 0
    moved = intervals.clamped(spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 7), (1, 3, 8, 20)], "agent long, event_id long, start long, stop long"), "agent", ["start"])
    assert sorted((r.event_id, r.new_start, r.new_stop) for r in moved.collect()) == [(1, 0, 10), (2, 10, 10), (3, 10, 20)]
    meetings = spark.createDataFrame([(1, 1, 0, 10, 2), (1, 2, 5, 15, 1), (1, 3, 12, 20, 1), (1, 4, 30, 40, 0)], "agent long, event_id long, start long, stop long, priority long")
    assert {r.event_id: r.keeps for r in intervals.resolved(meetings).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)], "source long, target long, weight double")
    got = {r.node: (r.degree, r.triangles, round(r.clustering, 4)) for r in graph.clustering(edges).collect()}
    assert got == {1: (2, 1, 1.0), 2: (2, 1, 1.0), 3: (3, 1, 0.3333), 4: (1, 0, 0.0)}
    assert {(r.a, r.b) for r in graph.two_hops(edges).collect() if r.a == 4} == {(4, 4), (4, 3), (4, 1), (4, 2)}


def test_statistics(spark):
    same = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert statistics.kappa(same, []).first().kappa is None
    flat = spark.createDataFrame([("g", 1.0, float(i)) for i in range(4)], "g string, x double, y double")
    assert statistics.spearman(flat, "x", "y", ["g"]).first().rho is None
    assert statistics.auc(flat, F.lit(True), "y").first().auc == 0.5


def test_streams(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([("o", "e", f"f{i}", float(i % 4)) for i in range(9)] + [("o", "z", "g", 1.0)], "owner string, entity string, fact string, at double")
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    seen = []
    replay.run_available(replay.knowledge(stream), lambda batch, k: seen.extend(batch.collect()), f"file://{tmp_path}/state", "update")
    assert {(r.owner, r.entity): (r.at, r.n_facts) for r in seen} == {("o", "e"): (3.0, 9), ("o", "z"): (1.0, 1)}
    days = spark.createDataFrame([(0.1, "a", "xx"), (0.9, "b", "y"), (3.5, "a", "zzz")], "sim_day double, speaker string, text string")
    days.coalesce(1).write.parquet(f"{source}2")
    out = []
    timed = replay.with_event_time(spark.readStream.schema(days.schema).parquet(f"{source}2"))
    replay.run_available(replay.daily(timed), lambda batch, k: out.extend(batch.collect()), f"file://{tmp_path}/state2")
    assert [(str(r.day)[:10], r.n_messages, r.n_chars) for r in out] == [("2025-01-01", 2, 3)]
    asked = replay.anchored(spark.createDataFrame([("m1",), ("m2",)], "msg_id string"), spark.createDataFrame([("q", "m2"), ("r", "m9")], "question_id string, anchor string"))
    assert [tuple(r) for r in asked.collect()] == [("q", "m2")]
