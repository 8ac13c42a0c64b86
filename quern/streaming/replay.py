"""Streams of messages: replay against waiting questions, day windows with a policy for late data, knowledge per owner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EPOCH = "2025-01-01"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what is available through `sink`, batch by batch, and waits; a restart goes on after the last whole batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def anchored(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, msg_id of questions asked right after the message they are anchored at. messages may be a stream;
    questions (question_id, anchor) are a table, which each batch meets in a stream-static join."""
    return messages.join(questions, messages["msg_id"] == questions["anchor"]).select("question_id", "msg_id")


def met_in_time(messages: DataFrame, questions: DataFrame, within: str = "1 day", late: str = "2 days") -> DataFrame:
    """question_id, msg_id (null: none came) of two streams: each question with the message it is anchored at, if it was asked
    at most `within` after the message. messages: msg_id, event_time; questions: question_id, anchor, asked_time.

    Both streams may come out of order by `late`, in any number of batches, and a message and its question in either order:
    each side waits in state until the watermark says that nothing can meet it any more. A question that comes later than
    that is dropped here, as is one still waiting when the streams end: both are among left_over().
    """
    m = messages.select("msg_id", "event_time").withWatermark("event_time", late)
    q = questions.select("question_id", "anchor", "asked_time").withWatermark("asked_time", late)
    meets = (F.col("anchor") == F.col("msg_id")) & (F.col("asked_time") >= F.col("event_time")) & (F.col("asked_time") <= F.col("event_time") + F.expr(f"INTERVAL {within}"))
    return q.join(m, meets, "leftOuter").select("question_id", "msg_id")


def left_over(questions: DataFrame, asked: DataFrame) -> DataFrame:
    """Questions without an anchor or whose anchor never came, asked at the end, each once."""
    return questions.dropDuplicates(["question_id"]).join(asked, "question_id", "left_anti")


def with_event_time(messages: DataFrame, day: str = "sim_day", name: str = "event_time") -> DataFrame:
    """Adds event_time from days since EPOCH."""
    return messages.withColumn(name, F.timestamp_micros((F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.col(day) * 86_400_000_000).cast("long")))


def daily(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages, speakers and characters per day; a day is final once messages `late` after its end have come."""
    w = messages.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("w"))
    return w.agg(F.count("*").alias("n_messages"), F.approx_count_distinct("speaker").alias("n_speakers"), F.sum(F.length("text")).alias("n_chars")).select(F.col("w.start").alias("day"), "n_messages", "n_speakers", "n_chars")


def knowledge(facts: DataFrame) -> DataFrame:
    """Latest fact and number of facts of each (owner, entity) as a stream of updates; facts: owner, entity, fact, at."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fact, at, n = state.get if state.exists else (None, None, 0)
        for batch in batches:
            n += len(batch)
            top = batch.sort_values("at").iloc[-1]
            if at is None or top["at"] >= at:
                fact, at = top["fact"], float(top["at"])
        state.update((fact, at, n))
        yield pd.DataFrame({"owner": [key[0]], "entity": [key[1]], "fact": [fact], "at": [at], "n_facts": [n]})

    return facts.groupBy("owner", "entity").applyInPandasWithState(update, "owner string, entity string, fact string, at double, n_facts long", "fact string, at double, n_facts long", "update", "NoTimeout")
