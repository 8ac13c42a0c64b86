"""Readers of conversation corpora, questions, telemetry and result grids as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN = "turn_id string, session_id string, speaker_id string, listener_id string, text string, timestamp double, triggering_event string, entities_mentioned array<string>, extracted_facts array<string>"
SESSION = f"session_id string, id string, participants array<string>, start_time double, end_time double, location_id string, group_id string, modality string, turns array<struct<{', '.join(x.replace(' ', ': ', 1) for x in TURN.split(', '))}>>"
INSTANCE = "instance_id string, dimension string, ego string, question string, gold_answer string, query_timestamp double"
MARKER = "instance_id string, phase string, llm_model string, ts_start_ms long, ts_end_ms long, prompt_tokens long, completion_tokens long"


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the job. Compressed files are told by their suffix."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines without the malformed ones; with a key only the last line of each key stays, by file and place in it."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    good = rows.where("_bad IS NULL").drop("_bad")
    if key:
        last = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_at"))
        good = good.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return good.drop("_file", "_at")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with turns; session_id may be called id; sessions without turns of any text are left out."""
    rows = tolerant_lines(spark, path, SESSION).withColumn("session_id", F.coalesce("session_id", "id")).drop("id")
    rows = rows.withColumn("turns", F.filter("turns", lambda t: F.trim(F.coalesce(t["text"], F.lit(""))) != ""))
    last = Window.partitionBy("session_id").orderBy(F.desc(F.monotonically_increasing_id()))
    return rows.where("session_id IS NOT NULL AND size(turns) > 0").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def owner_sessions(spark: SparkSession, path: str) -> DataFrame:
    """owner, position, session_id of one JSON object {owner: [session ids in time order]}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("owner", "ids")).select("owner", F.posexplode("ids").alias("position", "session_id"))


def instances(spark: SparkSession, pattern: str, task: str = r"([^/]+?)(?:\.jsonl)?(?:\.gz)?$") -> DataFrame:
    """Questions of many task files with the task's name, which the pattern `task` finds in the file's; lines that are no
    questions are left out."""
    rows = spark.read.schema(f"{INSTANCE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    rows = rows.withColumn("task", F.regexp_extract(F.col("_metadata.file_path"), task, 1)).where("_bad IS NULL")
    return rows.drop("_bad").withColumn("question", F.trim(F.regexp_replace("question", r"\s+", " ")))


def limited_per_file(rows: DataFrame, file: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each file (for trial runs, whose point the limit is)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def group_chats(spark: SparkSession, path: str) -> DataFrame:
    """file, date, group, position, speaker, time, text of {"dialogues": {date: {group: [messages]}}}; positions count within a
    file's group of a date, from 0."""
    shape = "struct<dialogues: map<string, map<string, array<struct<speaker: string, time: string, text: string>>>>>"
    j = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", shape).alias("j"))
    rows = j.select("file", F.explode("j.dialogues").alias("date", "groups")).select("file", "date", F.explode("groups").alias("group", "messages"))
    rows = rows.select("file", "date", "group", F.posexplode("messages").alias("position", "m"))
    return rows.select("file", "date", "group", "position", "m.speaker", F.regexp_replace(F.col("m.time"), " ", "T").alias("time"), "m.text")


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def first_of(rows: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that rows have and that is not blank."""
    found = [blank_to_null(x) for x in names if x in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def canonical_messages(rows: DataFrame) -> DataFrame:
    """msg_id, thread_id, text, occur_ts, deliver_ts from the names that sources use; delivery defaults to occurrence."""
    occur = first_of(rows, ["occur_ts", "timestamp", "ts", "time", "date"])
    return rows.select(first_of(rows, ["msg_id", "id", "message_id", "turn_id"]).alias("msg_id"), first_of(rows, ["thread_id", "session_id", "group", "conv_id"]).alias("thread_id"), first_of(rows, ["text", "content", "message", "body"]).alias("text"), occur.alias("occur_ts"), F.coalesce(first_of(rows, ["deliver_ts"]), occur).alias("deliver_ts"))


def session_messages(rows: DataFrame) -> DataFrame:
    """One row per turn of sessions(): msg_id (the turn's or session_tN), session_id, position, speaker, text under a header
    of place, group and modality, timestamp, day."""
    t = rows.select("session_id", "location_id", "group_id", "modality", "start_time", F.posexplode("turns").alias("position", "t"))
    name = F.initcap(F.replace(F.col("t.speaker_id"), F.lit("_"), F.lit(" ")))
    header = F.concat(F.lit("["), F.concat_ws(" | ", F.initcap(F.replace(F.regexp_replace("location_id", "^loc_", ""), F.lit("_"), F.lit(" "))), "group_id", "modality"), F.lit("]\n["), name, F.lit("]: "))
    return t.select(F.coalesce("t.turn_id", F.concat("session_id", F.lit("_t"), "position")).alias("msg_id"), "session_id", "position", F.col("t.speaker_id").alias("speaker"), F.concat(header, "t.text").alias("text"), F.coalesce("t.timestamp", "start_time").alias("timestamp"), F.floor(F.coalesce("t.timestamp", "start_time")).alias("day"))


def question_errors(items: DataFrame) -> DataFrame:
    """question_id, error of questions (question_id, question, answer, options, correct_option) that break a rule."""
    counts = items.groupBy("question_id").agg(F.count("*").alias("_copies"))
    rows = items.join(counts, items["question_id"].eqNullSafe(counts["question_id"]), "left").drop(counts["question_id"])
    test = lambda c, name: F.when(c, F.lit(name))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    option = F.col("options").isNotNull() & ~F.coalesce(F.array_contains("options", F.col("correct_option")), F.lit(False))
    rules = F.array(test(blank("question_id"), "missing id"), test(~blank("question_id") & (F.col("_copies") > 1), "repeated id"), test(blank("question"), "missing question"), test(blank("answer") & F.col("options").isNull(), "missing answer"), test(option, "correct option not among options"))
    return rows.select("question_id", F.explode(F.array_compact(rules)).alias("error"))


def telemetry(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV samples, all columns as doubles, what does not parse as 0."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)).alias(c) for c in columns])


def markers(spark: SparkSession, path: str) -> DataFrame:
    return strict_lines(spark, path, MARKER)


def result_cells(spark: SparkSession, root: str) -> DataFrame:
    """question_id, correct, label of every detail under <root>/<backend>/<model>/<seed>/*.json, with those three names;
    details that were not scored or that failed are left out."""
    detail = "question_id: string, correct: string, judge_correct: string, label: string, answer_scored: string, raw_response: string"
    rows = spark.read.schema(f"details array<struct<{detail}>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    part = lambda k: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k)
    d = rows.select(part(4).alias("backend"), part(3).alias("model"), part(2).alias("seed"), F.explode("details").alias("d"))
    true = lambda c: F.lower(c).isin("true", "1")
    kept = d.where(~F.lower(F.coalesce("d.answer_scored", F.lit("true"))).isin("false", "0") & ~F.coalesce(F.startswith(F.col("d.raw_response"), F.lit("LLM_ERROR")), F.lit(False)))
    return kept.select("backend", "model", "seed", "d.question_id", true(F.coalesce("d.judge_correct", "d.correct")).alias("correct"), "d.label")


def checked_files(spark: SparkSession, path: str, manifest: DataFrame, parts: int = 1) -> DataFrame:
    """name, expected, found, fine of every file of a manifest (name: the last `parts` parts of its path, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.select(F.substring_index("path", "/", -parts).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.join(found, "name", "left").select("name", F.col("sha256").alias("expected"), "found", F.coalesce(F.lower("sha256") == F.col("found"), F.lit(False)).alias("fine"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files: line counts all lines from 0, blank ones too, through the files in order of their names.

    Each split of a file is counted and numbered for itself; only the splits' counts, a row per split, are summed up in one
    task. A file that no split can divide, such as a compressed one, is numbered in one task.
    """
    m = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("inside", inside).join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("inside") - 1).alias("line"), "value")


def agent_numbers(spark: SparkSession, path: str) -> DataFrame:
    """agent, line: the last line of a list of agents, as JSON lines, that describes the agent; blank and bad lines count as lines."""
    rows = numbered_lines(spark, path).select("line", F.from_json("value", "agent_id string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    agent = F.trim("j.agent_id")
    return rows.where(F.col("j._bad").isNull() & (agent != "")).groupBy(agent.alias("agent")).agg(F.max("line").alias("line"))


CACHED = "instance_id string, namespace string, query string, system string, extractor_model string, config string, error string, memories array<string>, _bad string"


def frozen_cache(spark: SparkSession, path: str, **expected: str) -> DataFrame:
    """The rows of a cache of memories, as JSON lines, with their line and whether they are `errored` (an error, or no memories).

    expected: values that every row must have in system, extractor_model or config; a row with another one, and a line that is
    no JSON, fails the job that meets it. Blank lines are passed over.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("line", F.from_json("value", CACHED, {"columnNameOfCorruptRecord": "_bad"}).alias("j")).select("line", "j.*")
    fault = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("no JSON in line "), "line"))
    for name, value in expected.items():
        fault = fault.when(~F.col(name).eqNullSafe(F.lit(value)), F.concat(F.lit(f"cache mismatch: expected {name} {value}, got "), F.coalesce(F.col(name), F.lit("none")), F.lit(" of "), F.coalesce("instance_id", F.lit("none"))))
    errored = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise((F.coalesce("error", F.lit("")) != "") | F.col("memories").isNull())
    return rows.withColumn("errored", errored).where("errored IS NOT NULL").drop("_bad")


def from_cache(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (instance_id, namespace, query, and more) with memories, errored and found_by: the cache's last row of the
    instance, else the last one of the namespace and query, else a miss with no memories. Blank keys find nothing."""
    found = F.max(F.struct("line", "errored", F.coalesce("memories", F.array().cast("array<string>")).alias("memories"))).alias("hit")
    by_id = cache.where("instance_id <> ''").groupBy("instance_id").agg(found).withColumnRenamed("hit", "own")
    by_key = cache.where("namespace <> '' AND query <> ''").groupBy("namespace", "query").agg(found).withColumnRenamed("hit", "like")
    rows = asked.join(by_id, "instance_id", "left").join(by_key, ["namespace", "query"], "left").withColumn("hit", F.coalesce("own", "like"))
    by = F.when(F.col("own").isNotNull(), "instance").when(F.col("like").isNotNull(), "query").otherwise("miss")
    return rows.select(*asked.columns, F.coalesce("hit.memories", F.array().cast("array<string>")).alias("memories"), F.coalesce("hit.errored", F.lit(False)).alias("errored"), by.alias("found_by"))
