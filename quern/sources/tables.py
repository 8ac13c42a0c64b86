"""The engine's views of stored tables: messages, questions, verdicts, activity, telemetry and social edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Divisors that deal sessions to owners and to simulated days where a corpus names neither.
EGOS, DAYS = 10, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for a job's files under spark.checkpoint.dir, which all executors share. Where that is unset, a local
    master gets a temporary folder of its own; on a cluster it is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once under the scratch folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, msg_id, ego, day, sim_day of every conversation turn."""
    c = table(spark, sf_dir, "conversations")
    day = F.col("conv_id") % DAYS
    return c.select("conv_id", "turn", "role", "text", F.concat_ws("_", "conv_id", "turn").alias("msg_id"), (F.col("conv_id") % EGOS).alias("ego"), day.alias("day"), (day + F.col("turn") / 100.0).alias("sim_day"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, text, ego, cutoff_day, excluded (a session) of every benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), "text", (F.col("item_id") % EGOS).alias("ego"), (F.col("item_id") % DAYS).alias("cutoff_day"), F.col("item_id").alias("excluded"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, place, activity, start, stop (seconds) of every event, which lasts for ten seconds per unit of its value."""
    e = table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("agent"), (F.col("event_id") % 7).alias("place"), F.col("event_type").alias("activity"), start.alias("start"), (start + F.floor(F.col("value") * 10) + 1).alias("stop"))


def social_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source < target, weight: customers of one nation whose keys are neighbours, or who share an order priority day."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("a"), F.to_date("o_orderdate").alias("d"), "o_orderpriority").distinct()
    pairs = o.alias("x").join(o.alias("y"), ["d", "o_orderpriority"]).where("x.a < y.a")
    return pairs.groupBy(F.col("x.a").alias("source"), F.col("y.a").alias("target")).agg(F.count("*").alias("n"))


#: The same views as DuckDB SQL.
MESSAGES_SQL = """m AS (SELECT conv_id, turn, role, text, conv_id || '_' || turn AS msg_id, conv_id % 10 AS ego, conv_id % 15 AS day,
  (conv_id % 15) + turn / 100.0::DOUBLE AS sim_day FROM conversations)"""
QUESTIONS_SQL = "q AS (SELECT item_id AS question_id, text, item_id % 10 AS ego, item_id % 15 AS cutoff_day, item_id AS excluded FROM benchmark)"
INTERVALS_SQL = """i AS (SELECT event_id, user_id AS agent, event_id % 7 AS place, event_type AS activity, floor(epoch(ts))::BIGINT AS start,
  floor(epoch(ts))::BIGINT + floor(value * 10)::BIGINT + 1 AS stop FROM events)"""
EDGES_SQL = """o AS (SELECT DISTINCT o_custkey % 200 AS a, o_orderdate::DATE AS d, o_orderpriority AS p FROM orders),
g AS (SELECT x.a AS source, y.a AS target, count(*) AS n FROM o x JOIN o y ON x.d = y.d AND x.p = y.p AND x.a < y.a GROUP BY ALL)"""


def portable(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The rows of SQL that Spark and DuckDB read alike, over the stored tables `names`, which it writes as {name}."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def in_duckdb(sql: str, *names: str) -> str:
    """The same SQL for DuckDB."""
    for name in names:
        sql = sql.replace("{" + name + "}", name)
    return sql
