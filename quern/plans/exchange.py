"""Files that go out and come back: transcripts and chats, tasks, manifests, reports; and the scorer of plain questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import plain
from quern.functions import text as tx
from quern.plans.registry import query
from quern.sources import nested, readers, sinks
from quern.sources.tables import scratch, table


@query("""WITH c AS (SELECT *, conv_id % 2 = 0 AS chat, conv_id // 20 AS file, '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS date, 'g' || conv_id AS thread FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY chat, file ORDER BY CASE WHEN chat THEN date END, CASE WHEN chat THEN thread ELSE lpad(conv_id::VARCHAR, 12, '0') END, turn) - 1 AS n FROM c)
SELECT CASE WHEN turn % 2 = 0 THEN 'm' || conv_id || '_' || turn WHEN chat THEN date || '_' || thread || '_' || n ELSE 'jsonl_' || lpad(n::VARCHAR, 8, '0') END AS msg_id, thread AS thread_id, conv_id AS user_id, text,
  CASE WHEN chat AND turn % 3 = 0 THEN date || 'T00:00:00Z' WHEN chat THEN date || 'T1' || turn || ':00Z' ELSE date END AS occur_ts, CASE WHEN chat AND turn % 3 = 0 THEN date || 'T00:00:00Z' WHEN chat THEN date || 'T1' || turn || ':00Z' WHEN turn % 2 = 0 THEN 'later' ELSE date END AS deliver_ts FROM n""")
def sniffed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a folder in which half the files are group chats and half transcripts, under names that do not say which."""
    path, k = scratch(spark, "mixed"), F.col("conv_id")
    date = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    c = table(spark, sf_dir, "conversations").withColumns({"file": F.floor(k / 20), "date": date, "thread": F.concat(F.lit("g"), k), "id": F.when(F.col("turn") % 2 == 0, F.concat_ws("_", F.concat(F.lit("m"), k), "turn"))})
    said = F.struct("turn", F.col("id").alias("msg_id"), k.alias("speaker_id"), F.when(F.col("turn") % 3 != 0, F.concat("date", F.lit(" 1"), "turn", F.lit(":00"))).alias("time"), F.col("text").alias("dialogue"))
    groups = c.where(k % 2 == 0).groupBy("file", "date", "thread").agg(F.sort_array(F.collect_list(said)).alias("said"))
    days = groups.groupBy("file", "date").agg(F.map_from_entries(F.collect_list(F.struct("thread", "said"))).alias("groups"))
    chats = days.groupBy("file").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("date", "groups"))).alias("dialogues"))).alias("value"))
    line = F.to_json(F.struct("id", F.col("thread").alias("group"), F.struct(k.alias("user_id")).alias("speaker"), F.col("text").alias("content"), F.col("date").alias("time"), F.when(F.col("turn") % 2 == 0, "later").alias("deliver_ts")))
    lines = c.where(k % 2 == 1).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    chats.select((F.col("file") * 2).alias("file"), "value").unionByName(lines.select((F.col("file") * 2 + 1).alias("file"), "value")).write.partitionBy("file").text(path)
    return nested.messages(spark, f"{path}/*/*.txt").drop("file")


@query("""SELECT 't' || item_id % 3 AS task, 'i' || item_id AS instance_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question, split_part(text, ' ', 1) AS gold_answer, item_id / 2.0::DOUBLE AS query_timestamp FROM benchmark""")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the files of three tasks, read in one scan; lines that are cut off are passed over."""
    path, k = scratch(spark, "tasks"), F.col("item_id")
    line = F.to_json(F.struct(F.concat(F.lit("i"), k).alias("instance_id"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit(" ")).alias("question"), F.split_part("text", F.lit(" "), F.lit(1)).alias("gold_answer"), (k / 2).alias("query_timestamp")))
    lines = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), k % 3).alias("task"), F.explode(F.array(line, F.substring(line, 1, 20))).alias("value"))
    lines.write.partitionBy("task").text(path)
    return readers.instances(spark, f"{path}/*/*.txt", "task=([^/]+)/").select("task", "instance_id", "question", "gold_answer", "query_timestamp")


@query("""WITH s AS (SELECT count(DISTINCT source) AS n FROM documents) SELECT n + 1 AS listed, n - 1 AS fine, 1 AS changed, 1 AS missing FROM s""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of a dataset are what its manifest says, how many are another content, and how many are not there."""
    path = scratch(spark, "dataset")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5("source").alias("part"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").json(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    listed = sinks.manifest(found, 2).unionByName(spark.createDataFrame([("part=none/x.json", "00")], "name string, sha256 string"))
    first = F.row_number().over(Window.orderBy("name")) == 2  # a row per source
    stored = scratch(spark, "manifest")
    sinks.write_csv(listed.withColumn("sha256", F.when(first, F.sha2("name", 256)).otherwise(F.upper("sha256"))), stored)
    checked = readers.checked_files(spark, path, spark.read.option("header", True).csv(stored), 2)
    return checked.agg(F.count("*").alias("listed"), F.count_if("fine").alias("fine"), F.count_if(~F.col("fine") & F.col("found").isNotNull()).alias("changed"), F.count_if(F.col("found").isNull()).alias("missing"))


@query("""WITH d AS (SELECT lang, source, length(text) AS n FROM documents), s AS (SELECT lang, source, count(*) AS docs, sum(n)::BIGINT AS chars FROM d GROUP BY ALL) SELECT lang, source, docs, chars, sum(docs) OVER (PARTITION BY lang)::BIGINT AS lang_docs FROM s""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of documents by language, with a part per source, written as nested JSON and read back."""
    path = scratch(spark, "report")
    s = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))
    r = s.groupBy("lang").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "docs", "chars")).alias("parts"))
    sinks.write_lines(r.select("lang", F.struct("docs", "parts").alias("summary")), path)
    back = readers.strict_lines(spark, path, "lang string, summary struct<docs: long, parts: array<struct<source: string, docs: long, chars: long>>>")
    return back.select("lang", F.col("summary.docs").alias("lang_docs"), F.explode("summary.parts").alias("p")).select("lang", "p.source", "p.docs", "p.chars", "lang_docs")


@query("""SELECT 'q' || item_id AS question_id, text AS question, split_part(text, ' ', 1) AS answer, CASE WHEN item_id % 2 = 0 THEN 'multiple_choice' ELSE 'open_ended' END AS question_type, CASE WHEN item_id % 2 = 0 THEN [split_part(text, ' ', 1), split_part(text, ' ', 2)] END AS options, CASE WHEN item_id % 2 = 0 THEN 'A' END AS correct_option FROM benchmark""")
def question_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions dumped as objects, with lists of 50 a file, and scanned again."""
    path, k = scratch(spark, "dump"), F.col("item_id")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    even = k % 2 == 0
    q = table(spark, sf_dir, "benchmark").select(F.floor(k / 50).alias("file"), F.struct(F.concat(F.lit("q"), k).alias("question_id"), F.col("text").alias("question"), word(1).alias("answer"), F.when(even, F.array(word(1), word(2))).alias("options"), F.when(even, "A").alias("correct_option")).alias("item"))
    sinks.write_lines(q.groupBy("file").agg(F.collect_list("item").alias("questions")).repartition("file"), path, ["file"])
    return nested.questions(nested.json_files(spark, f"{path}/*/*.json")).drop("file", "position", "item")


def _refused(text: str) -> str:
    """Whether a text in lower case and single blanks refuses, in DuckDB."""
    norm = f"trim(regexp_replace(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    either = lambda t, hints: "(" + " OR ".join(f"contains({t}, '{h}')" for h in hints) + ")"
    quoted = [h.replace("'", "''") for h in tx.REFUSAL_HINTS]
    return f"({norm} IN {tuple(tx.PLAIN_NO)} OR regexp_matches({norm}, '{tx.NO_I}') OR {either(text, quoted)} OR {either(norm, [tx._plain(h) for h in tx.REFUSAL_HINTS])})"


@query(rf"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, conv_id % 8 AS k FROM conversations),
i AS (SELECT *, CASE k WHEN 1 THEN '1A 2b x 10C' WHEN 4 THEN '  ' || text || ' ' WHEN 5 THEN array_to_string(string_split(text, ' ')[2:4], ' ') ELSE before END AS gold, CASE k WHEN 1 THEN 'so: {{"answer": "1' || chr((65 + turn % 4)::INTEGER) || ' 2:B"}} 2C' WHEN 2 THEN 'I cannot share: ' || text ELSE text END AS said FROM t),
n AS (SELECT *, lower(trim(regexp_replace(coalesce(gold, ''), '\s+', ' ', 'g'))) AS want, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) AS have FROM i),
w AS (SELECT conv_id, turn, unnest(list_filter(string_split(have, ' '), lambda x: x <> '')) AS x, 'p' AS side FROM n UNION ALL SELECT conv_id, turn, unnest(list_filter(string_split(want, ' '), lambda x: x <> '')), 'g' FROM n),
m AS (SELECT conv_id, turn, x, least(count(*) FILTER (WHERE side = 'p'), count(*) FILTER (WHERE side = 'g')) AS c, count(*) AS a FROM w GROUP BY ALL),
o AS (SELECT conv_id, turn, 2.0 * sum(c) / sum(a) AS f1 FROM m GROUP BY ALL),
f AS (SELECT n.*, {_refused("have")} AS refused, CASE WHEN want = '' OR have = '' THEN 0 ELSE coalesce(f1, 0) END AS f1 FROM n LEFT JOIN o USING (conv_id, turn)),
r AS (SELECT conv_id, turn, CASE WHEN k = 7 THEN {{'c': turn % 2 = 0, 's': turn / 10.0::DOUBLE, 'r': 'pre_scored:' || CASE WHEN turn = 0 THEN 'unknown' ELSE 'timeout' END}}
  WHEN k = 0 THEN {{'c': trim(coalesce(gold, '')) <> '' AND upper(left(trim(said), 1)) = upper(left(trim(gold), 1)), 's': (trim(coalesce(gold, '')) <> '' AND upper(left(trim(said), 1)) = upper(left(trim(gold), 1)))::INT::DOUBLE, 'r': 'mc_exact_option'}}
  WHEN k = 1 THEN {{'c': false, 's': (CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END) / 3.0::DOUBLE, 'r': 'cloze_' || CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END || '/3'}}
  WHEN want = have AND want <> '' THEN {{'c': true, 's': 1.0::DOUBLE, 'r': 'exact'}}
  WHEN k = 2 THEN {{'c': refused, 's': refused::INT::DOUBLE, 'r': CASE WHEN refused THEN 'abstain_denial_match' ELSE 'abstain_expected_but_answered' END}}
  WHEN k = 3 THEN {{'c': NOT refused, 's': (NOT refused)::INT::DOUBLE, 'r': CASE WHEN refused THEN 'disclose_expected_but_denied' ELSE 'disclose_provided' END}}
  WHEN want <> '' AND contains(have, want) THEN {{'c': true, 's': 0.9::DOUBLE, 'r': 'contains_gold'}} ELSE {{'c': f1 >= 0.65, 's': f1::DOUBLE, 'r': 'token_f1'}} END AS z FROM f)
SELECT conv_id, turn, z.c AS correct, round(z.s, 6) AS score, z.r AS reason FROM r""")
def plain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns scored as answers to questions without a dimension: options, blanks, refusals, scores given before, and overlap."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") % 8
    t = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    some = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    gold = F.when(k == 1, "1A 2b x 10C").when(k == 4, F.concat(F.lit("  "), "text", F.lit(" "))).when(k == 5, some).otherwise(F.col("before"))
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("turn") % 4 + 1).cast("int"))
    said = F.when(k == 1, F.concat(F.lit('so: {"answer": "1'), letter, F.lit(' 2:B"} 2C'))).when(k == 2, F.concat(F.lit("I cannot share: "), "text")).otherwise(F.col("text"))
    kind = F.when(k == 0, "multiple_choice").when(k == 1, "cloze").otherwise("open_ended")
    mode = F.when(k == 2, "abstain").when(k == 3, "disclose").otherwise("answer")
    pre = F.when(k == 7, F.struct((F.col("turn") % 2 == 0).alias("correct"), (F.col("turn") / 10).alias("score"), F.when(F.col("turn") > 0, "timeout").alias("reason")))
    r = t.select("conv_id", "turn", plain.score(kind, gold, F.lit(None).cast("string"), mode, said, pre).alias("r"))
    return r.select("conv_id", "turn", "r.correct", F.round("r.score", 6).alias("score"), "r.reason")
