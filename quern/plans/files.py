"""Readers and sinks: stored tables written in the formats that corpora come in, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.sources import readers, sinks
from quern.sources.tables import scratch, table
from quern.streaming import replay


@query("SELECT item_id, text FROM benchmark")
def strict_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, gzipped by their suffix, read so that a malformed line would fail."""
    path = scratch(spark, "strict")
    table(spark, sf_dir, "benchmark").write.option("compression", "gzip").json(path)
    return readers.strict_lines(spark, path, "item_id long, text string")


@query("SELECT doc_id AS id, doc_id * 2 + 1 AS n FROM documents")
def tolerant_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with malformed ones and repeated keys: the last good line of each key."""
    path, k = scratch(spark, "tolerant"), F.col("doc_id")
    line = lambda n: F.to_json(F.struct(k.alias("id"), n.alias("n")))
    table(spark, sf_dir, "documents").select(F.explode(F.array(line(k), F.lit('{"id": oops'), line(k * 2 + 1), F.lit(""))).alias("value")).write.text(path)
    return readers.tolerant_lines(spark, path, "id long, n long", "id")


@query("SELECT conv_id // 10 AS owner, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id) - 1 AS position, 's' || conv_id AS session_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def owner_session_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of owners and their sessions in time order, which the format keeps in one file."""
    path = scratch(spark, "owners")
    s = table(spark, sf_dir, "conversations").select("conv_id").distinct().groupBy(F.floor(F.col("conv_id") / 10).cast("string").alias("owner")).agg(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: F.concat(F.lit("s"), x)).alias("ids"))
    s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("owner", "ids")))).alias("value")).write.text(path)
    return readers.owner_sessions(spark, path).select(F.col("owner").cast("long").alias("owner"), F.col("position").cast("long").alias("position"), "session_id")


SESSIONS_SQL = """SELECT 's' || conv_id || '_t' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS msg_id, role AS speaker, '[Town Hall | g1 | voice]' || chr(10) || '[' || upper(left(role, 1)) || substr(role, 2) || ']: ' || text AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''"""


@query(SESSIONS_SQL)
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their turns as JSON lines, read back as one row per message under a header."""
    path = scratch(spark, "sessions")
    turn = F.struct("turn", F.col("role").alias("speaker_id"), "text")
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    sinks.write_lines(s.select(F.concat(F.lit("s"), "conv_id").alias("id"), F.lit("loc_town_hall").alias("location_id"), F.lit("g1").alias("group_id"), F.lit("voice").alias("modality"), "turns"), path)
    return readers.session_messages(readers.sessions(spark, path)).select("msg_id", "speaker", "text")


@query("SELECT '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS date, 'g' || conv_id AS \"group\", row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role AS speaker, '10:00T' || turn AS time, text FROM conversations")
def group_chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested group chats, an object a file, as one row per message."""
    path = scratch(spark, "chats")
    c = table(spark, sf_dir, "conversations")
    message = F.struct("turn", F.col("role").alias("speaker"), F.concat(F.lit("10:00 "), "turn").alias("time"), "text")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    g = g.select(F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("date"), F.concat(F.lit("g"), "conv_id").alias("group"), "m")
    d = g.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("group", "m"))).alias("groups"))
    d.select(F.to_json(F.struct(F.create_map("date", "groups").alias("dialogues"))).alias("value"), "date").write.partitionBy("date").text(path)
    return readers.group_chats(spark, f"{path}/*/*.txt").select("date", "group", F.col("position").cast("long").alias("position"), "speaker", "time", "text")


@query("""SELECT event_id::DOUBLE AS event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value FROM events""")
def telemetry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as CSV, what is no number read as 0."""
    path = scratch(spark, "telemetry")
    sinks.write_csv(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"), "event_type"), path)
    return readers.telemetry(spark, path, ["event_id", "value"])


@query("SELECT 'i' || item_id AS instance_id, 'judge' AS phase, item_id * 1000 AS ts_start_ms, item_id * 1000 + 250 AS ts_end_ms FROM benchmark")
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of timed calls as JSON lines."""
    path, k = scratch(spark, "markers"), F.col("item_id")
    sinks.write_lines(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), k).alias("instance_id"), F.lit("judge").alias("phase"), (k * 1000).alias("ts_start_ms"), (k * 1000 + 250).alias("ts_end_ms")), path)
    return readers.markers(spark, path).select("instance_id", "phase", "ts_start_ms", "ts_end_ms")


@query("""SELECT lang AS backend, 'm' || quality AS model, 's' || toxic AS seed, 'q' || doc_id AS question_id, doc_id % 3 = 0 AS correct, 'L' || doc_id % 5 AS label FROM labels JOIN documents USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0""")
def result_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of result files by backend, model and seed; details that were not scored or failed are left out."""
    path, k = scratch(spark, "grid"), F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    detail = F.struct(F.concat(F.lit("q"), k).alias("question_id"), F.when(k % 3 == 0, "True").otherwise("False").alias("correct"), F.concat(F.lit("L"), k % 5).alias("label"), F.when(k % 7 == 0, "False").alias("answer_scored"), F.when(k % 11 == 0, "LLM_ERROR: x").alias("raw_response"))
    cells = rows.groupBy("lang", "quality", "toxic").agg(F.collect_list(detail).alias("details"))
    cells.write.partitionBy("lang", "quality", "toxic").json(path)
    plain = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "^[^=]*=", "")).alias(c)  # noqa: E731  folders are named key=value here
    return readers.result_cells(spark, path).select(plain("backend", ""), plain("model", "m"), plain("seed", "s"), "question_id", "correct", "label")


@query("""WITH q AS (SELECT 'q' || (item_id // 2) AS question_id, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE text END AS question, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'a' END AS answer, CASE WHEN item_id % 4 = 0 THEN 'x' END AS wrong, item_id % 7 = 0 AS nameless FROM benchmark),
r AS (SELECT CASE WHEN nameless THEN NULL ELSE question_id END AS question_id, question, answer, wrong FROM q), c AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM r)
SELECT count(*) FILTER (WHERE question_id IS NULL) AS no_id, count(*) FILTER (WHERE question_id IS NOT NULL AND n > 1) AS repeated, count(*) FILTER (WHERE trim(question) = '') AS no_question, count(*) FILTER (WHERE answer IS NULL AND wrong IS NULL) AS no_answer, count(*) FILTER (WHERE wrong IS NOT NULL) AS wrong_option FROM c""")
def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions break each rule."""
    k = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select(F.when(k % 7 != 0, F.concat(F.lit("q"), F.floor(k / 2))).alias("question_id"), F.when(k % 5 == 0, " ").otherwise(F.col("text")).alias("question"), F.when(k % 3 != 0, "a").alias("answer"), F.when(k % 4 == 0, F.array(F.lit("y"), F.lit("z"))).alias("options"), F.when(k % 4 == 0, "x").alias("correct_option"))
    e = readers.question_errors(q)
    n = lambda like, name: F.count_if(F.col("error").rlike(like)).alias(name)
    return e.agg(n("^missing id", "no_id"), n("^repeated id", "repeated"), n("^missing question", "no_question"), n("^missing answer", "no_answer"), n("option", "wrong_option"))


@query("SELECT conv_id || '_' || turn AS msg_id, conv_id::VARCHAR AS thread_id, text, '2024-01-01T0' || turn AS occur_ts, '2024-01-01T0' || turn AS deliver_ts FROM conversations")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose columns have other names, in the one shape of messages."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("session_id"), F.col("text").alias("content"), F.concat(F.lit("2024-01-01T0"), "turn").alias("time"))
    return readers.canonical_messages(c).select("msg_id", "thread_id", "text", "occur_ts", "deliver_ts")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def limited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each part of a table written in parts, as trial runs take them."""
    path = scratch(spark, "parts")
    sinks.write_table(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), path, ["source"], ["doc_id"])
    return readers.limited_per_file(spark.read.parquet(path), "source", [F.col("doc_id")], 3).select("doc_id", "source", "lang")


@query("""SELECT user_id AS owner, event_type AS entity, arg_max(event_id::VARCHAR, event_id) AS fact, count(*) AS n_facts FROM events GROUP BY ALL""")
def stream_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fact of each owner and entity as a stream's state keeps it; the last update of each is the table's."""
    path = f"{sf_dir}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    facts = e.select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("entity"), F.col("event_id").cast("string").alias("fact"), F.col("event_id").cast("double").alias("at"))
    out = scratch(spark, "knowledge")
    replay.run_available(replay.knowledge(facts), lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(out), scratch(spark, "state"), "update")
    seen = spark.read.schema("owner string, entity string, fact string, at double, n_facts long, batch long").parquet(out)
    return seen.groupBy(F.col("owner").cast("long").alias("owner"), "entity").agg(F.max_by("fact", F.struct("batch", "n_facts")).alias("fact"), F.max("n_facts").alias("n_facts"))


@query("""WITH m AS (SELECT conv_id % 15 AS day, (conv_id % 15) + turn / 100.0::DOUBLE AS sim_day, length(text) AS n FROM conversations) SELECT (DATE '2025-01-01' + day::INTEGER)::VARCHAR AS day, count(*) AS n_messages, sum(n)::BIGINT AS n_chars FROM m WHERE day + 2 <= (SELECT max(sim_day) FROM m) GROUP BY ALL""")
def stream_final_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are final once messages a day after their end have come; later days are still open."""
    path = f"{sf_dir}/conversations.parquet"
    c = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    m = replay.with_event_time(c.select(F.col("role").alias("speaker"), "text", (F.col("conv_id") % 15 + F.col("turn") / 100.0).alias("sim_day")))
    out = scratch(spark, "final")
    replay.run_available(replay.daily(m), lambda batch, k: batch.write.mode("append").parquet(out), scratch(spark, "state"))
    seen = spark.read.schema("day timestamp, n_messages long, n_speakers long, n_chars long").parquet(out)
    return seen.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_messages", "n_chars")
