"""Streams in several batches, out of order and across restarts."""

from datetime import datetime, timedelta


from quern.streaming import memory, replay

SHAPE = "owner string, kind string, names array<string>, source string, session string, content string, at double, event_time timestamp"
DAY = datetime(2025, 1, 1)


def seen(owner, kind, names, content, at):
    return (owner, kind, names, "x", "s", content, float(at), DAY + timedelta(days=at))


def run(spark, folder, rows, number, days=None):
    """Adds a file of rows to the stream's folder and runs what is new on the same checkpoint, as after a restart."""
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SHAPE).parquet(f"{folder}/in")
    if days is not None:
        stream = stream.withWatermark("event_time", "0 seconds")
    got = []
    memory.run_with_state(memory.knowledge_changes(stream, days), lambda batch, k: got.extend(map(tuple, batch.collect())), f"{folder}/state")
    return sorted(got)


def test_knowledge_goes_on_after_a_restart(spark, tmp_path):
    first = [seen("a", "fact", ["tea", "ann"], "likes tea", 1), seen("a", "fact", ["tea"], "old", 0), seen("a", "feeling", [], "glad", 1), seen("b", "impression", ["ann"], " kind ", 1)]
    assert run(spark, tmp_path, first, 1) == [("a", "entity", "ann", "likes tea", 1), ("a", "entity", "tea", "likes tea", 2), ("a", "feelings", "", "glad", 1), ("b", "person", "ann", "kind", 1)]
    more = [seen("a", "fact", ["tea"], "late news of earlier", 0.5), seen("a", "feeling", [], "sad", 2), *[seen("b", "impression", ["ann"], x, 2 + i) for i, x in enumerate(["kind", "b", "c", "", "d", "e", "f"])]]
    assert run(spark, tmp_path, more, 2) == [("a", "entity", "tea", "likes tea", 3), ("a", "feelings", "", "sad\nglad", 2), ("b", "person", "ann", "b\nc\nd\ne\nf", 5)]
    assert run(spark, tmp_path, [], 3) == []


def test_knowledge_is_forgotten(spark, tmp_path):
    run(spark, tmp_path, [seen("a", "fact", ["tea"], "one", 1)], 1, days=3)
    gone = run(spark, tmp_path, [seen("b", "fact", ["x"], "moves time on", 9)], 2, days=3)
    assert ("a", "forgotten", "", "", 0) in gone
    assert run(spark, tmp_path, [seen("a", "fact", ["tea"], "two", 10)], 3, days=3)[0] == ("a", "entity", "tea", "two", 1)


def test_questions_and_messages_out_of_order(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    messages = [[("m1", at(1.0)), ("m2", at(1.2))], [("m4", at(2.5)), ("m3", at(1.5))], [("m0", at(0.9))]]
    questions = [[("q3", "m3", at(1.6)), ("q1", "m1", at(1.5))], [("q2", "m2", at(2.4)), ("q9", "m9", at(1.0)), ("qn", None, at(1.0))], [("q0", "m0", at(1.0)), ("q4", "m4", at(2.4))]]
    for i, (m, q) in enumerate(zip(messages, questions, strict=True)):
        for name, rows, shape in (("m", m, "msg_id string, event_time timestamp"), ("q", q, "question_id string, anchor string, asked_time timestamp")):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        if i == 0:
            continue  # the first run finds two files of each
        stream = lambda name, shape: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        met = replay.met_in_time(stream("m", "msg_id string, event_time timestamp"), stream("q", "question_id string, anchor string, asked_time timestamp"))
        replay.run_available(met, lambda batch, k: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state")
    asked = spark.read.schema("question_id string, msg_id string").parquet(f"{tmp_path}/out").where("msg_id IS NOT NULL")
    assert sorted(map(tuple, asked.collect())) == [("q0", "m0"), ("q1", "m1"), ("q3", "m3")]  # q2 asks after a day, q4 before its anchor
    every = spark.createDataFrame([(q[0], q[1]) for b in questions for q in b], "question_id string, anchor string")
    assert sorted(r.question_id for r in replay.left_over(every, asked.select("question_id")).collect()) == ["q2", "q4", "q9", "qn"]


def test_a_late_question_is_left_over(spark, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    for i, (m, q) in enumerate([([("m1", at(1)), ("m8", at(8))], [("q8", "m8", at(8.5))]), ([("m9", at(9))], [("q1", "m1", at(1.5)), ("q9", "m9", at(9.1))])]):
        spark.createDataFrame(m, "msg_id string, event_time timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
        spark.createDataFrame(q, "question_id string, anchor string, asked_time timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
        met = replay.met_in_time(spark.readStream.schema("msg_id string, event_time timestamp").parquet(f"{tmp_path}/m"), spark.readStream.schema("question_id string, anchor string, asked_time timestamp").parquet(f"{tmp_path}/q"))
        replay.run_available(met, lambda batch, k: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state")
    asked = spark.read.schema("question_id string, msg_id string").parquet(f"{tmp_path}/out").where("msg_id IS NOT NULL")
    assert sorted(r.question_id for r in asked.collect()) == ["q8", "q9"]  # q1 comes when the watermark is at 6
