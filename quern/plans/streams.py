"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.sources.tables import MESSAGES_SQL, scratch, table
from quern.streaming import memory, replay


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.endswith(".parquet") else path + "*")


@query(f"""WITH {MESSAGES_SQL}, q AS (SELECT item_id AS question_id, CASE WHEN item_id % 4 <> 3 THEN (item_id * 2) || '_' || (item_id % 9) END AS anchor FROM benchmark)
SELECT question_id, anchor, CASE WHEN m.msg_id IS NOT NULL THEN 'anchor' ELSE 'end' END AS asked_at FROM q LEFT JOIN m ON m.msg_id = q.anchor""")
def replay_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each question is asked as messages stream by: after its anchor, or at the end."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 4 != 3, F.concat_ws("_", F.col("item_id") * 2, F.col("item_id") % 9)).alias("anchor"))
    stream = streamed(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("msg_id"))
    out = scratch(spark, "anchored")
    replay.run_available(replay.anchored(stream, questions), lambda batch, k: batch.write.mode("append").parquet(out), scratch(spark, "state"))
    asked = spark.read.schema("question_id long, msg_id string").parquet(out).select("question_id").distinct()
    done = questions.join(asked, "question_id").withColumn("asked_at", F.lit("anchor"))
    return done.unionByName(replay.left_over(questions, asked).withColumn("asked_at", F.lit("end")))


@query(f"WITH {MESSAGES_SQL} SELECT day, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM m GROUP BY day")
def stream_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and characters per day, kept up to date by a stream; the last state is what a batch gives."""
    c = streamed(spark, sf_dir, "conversations")
    counts = c.groupBy((F.col("conv_id") % 15).alias("day")).agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    out = scratch(spark, "daily")
    replay.run_available(counts, lambda batch, k: batch.write.mode("overwrite").parquet(out), scratch(spark, "state"), "complete")
    return spark.read.schema("day long, n_turns long, n_chars long").parquet(out)


@query(f"""WITH {MESSAGES_SQL}, q AS (SELECT item_id AS question_id, (item_id * 2) || '_' || (item_id % 9) AS anchor, (item_id * 2) % 15 + (item_id % 9) / 100.0::DOUBLE + (item_id % 4) / 2.0::DOUBLE AS day FROM benchmark)
SELECT question_id, anchor, CASE WHEN q.day - m.sim_day < 1.1 THEN 'anchor' ELSE 'end' END AS asked_at FROM q LEFT JOIN m ON m.msg_id = q.anchor""")
def questions_meet_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and questions as two streams: a question is asked at its anchor if it comes within a day of it, else at the end."""
    m = streamed(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("msg_id"), (F.col("conv_id") % 15 + F.col("turn") / 100.0).alias("sim_day"))
    k = F.col("item_id")
    due = lambda t: t.select(k.alias("question_id"), F.concat_ws("_", k * 2, k % 9).alias("anchor"), ((k * 2) % 15 + (k % 9) / 100.0 + (k % 4) / 2.0).alias("asked_day"))
    q = due(streamed(spark, sf_dir, "benchmark"))
    met = replay.met_in_time(replay.with_event_time(m), replay.with_event_time(q, "asked_day", "asked_time"), "1 day", "30 days")
    out = scratch(spark, "met")
    replay.run_available(met, lambda batch, i: batch.write.mode("append").parquet(out), scratch(spark, "state"))
    asked = spark.read.schema("question_id long, msg_id string").parquet(out).where("msg_id IS NOT NULL").select("question_id").distinct()
    every = due(table(spark, sf_dir, "benchmark")).select("question_id", "anchor")
    done = every.join(asked, "question_id").withColumn("asked_at", F.lit("anchor"))
    return done.unionByName(replay.left_over(every, asked).withColumn("asked_at", F.lit("end")))


@query("""WITH o AS (SELECT conv_id, turn, role, trim(text) AS text, CASE WHEN contains(text, '?') THEN 'feeling' WHEN role = 'assistant' THEN 'impression' ELSE 'fact' END AS kind, lower(regexp_extract(text, '^[^ ,.]+')) AS word FROM conversations WHERE trim(text) <> ''),
f AS (SELECT conv_id, turn, text, unnest(list_distinct([role, word])) AS name FROM o WHERE kind = 'fact'), p AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM o WHERE kind = 'impression'),
e AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM o WHERE kind = 'feeling')
SELECT conv_id AS owner, 'entity' AS kind, name, arg_max(text, turn) AS value, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT conv_id, 'person', 'assistant', string_agg(text, chr(10) ORDER BY turn), count(*) FROM p WHERE k <= 5 GROUP BY conv_id
UNION ALL SELECT conv_id, 'feelings', '', string_agg(text, chr(10) ORDER BY turn DESC), any_value(n) FROM e WHERE k <= 5 GROUP BY conv_id""")
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's owner knows once its stream has ended: latest facts by entity, feelings, impressions."""
    t = F.col("text")
    names = F.array_distinct(F.array("role", F.lower(F.regexp_extract(t, "^[^ ,.]+", 0))))
    kind = F.when(F.contains(t, F.lit("?")), "feeling").when(F.col("role") == "assistant", "impression").otherwise("fact")
    c = streamed(spark, sf_dir, "conversations").where(F.trim(t) != "")
    o = c.select(F.col("conv_id").cast("string").alias("owner"), kind.alias("kind"), F.when(kind == "impression", F.array("role")).otherwise(names).alias("names"), F.col("role").alias("source"), F.col("conv_id").cast("string").alias("session"), F.trim(t).alias("content"), F.col("turn").cast("double").alias("at"))
    out = scratch(spark, "memory")
    memory.run_with_state(memory.knowledge_changes(o), lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out), scratch(spark, "state"))
    seen = spark.read.schema(f"{memory.CHANGED}, batch long").parquet(out)
    last = seen.groupBy("owner", "kind", "name").agg(F.max_by(F.struct("value", "n"), "batch").alias("x"))
    return last.select(F.col("owner").cast("long").alias("owner"), "kind", "name", "x.value", "x.n")
