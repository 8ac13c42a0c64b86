"""Corpora: how alike their texts are, and the nested shapes of files that they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import overlap
from quern.plans.registry import query
from quern.sources import nested
from quern.sources.tables import scratch, table


@query(r"""WITH t AS (SELECT lang AS grp, doc_id AS id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT grp, id, len(w) AS len, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM t, range(1, 5) r(n)),
c AS (SELECT grp, id, n, gram, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT *, max(c) OVER (PARTITION BY grp, n, gram ORDER BY c DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, lead(c) OVER (PARTITION BY grp, n, gram ORDER BY c DESC, id) AS below FROM c),
h AS (SELECT grp, id, n, sum(least(c, coalesce(above, below, 0))) AS hit FROM m GROUP BY ALL),
k AS (SELECT grp, len, count(*) AS k, lag(len) OVER l AS low, lead(len) OVER l AS high FROM (SELECT grp, len(w) AS len FROM t) GROUP BY grp, len WINDOW l AS (PARTITION BY grp ORDER BY len)),
b AS (SELECT t.grp, t.id, len(w) AS len, CASE WHEN k > 1 THEN k.len WHEN high IS NULL OR k.len - low <= high - k.len THEN low ELSE high END AS closest,
  list_transform([1, 2, 3, 4], lambda n: ln(CASE WHEN coalesce(hits[n], 0) > 0 THEN hits[n] ELSE 0.1 END / greatest(len(w) - n + 1, 1))) AS logs, coalesce(hits[1], 0) AS words
  FROM t JOIN k ON k.grp = t.grp AND k.len = len(w) LEFT JOIN (SELECT grp, id, map_from_entries(list((n, hit::DOUBLE))) AS hits FROM h GROUP BY ALL) x ON x.grp = t.grp AND x.id = t.id),
s AS (SELECT grp, CASE WHEN closest IS NULL THEN NULL WHEN words = 0 THEN 0 ELSE exp(CASE WHEN len > closest THEN 0 ELSE 1 - closest / len END + list_sum(logs) / 4) END AS bleu FROM b)
SELECT grp AS lang, count(*) AS n, round(avg(bleu), 6) AS self_bleu FROM s GROUP BY grp""")
def self_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the documents of a language are: the mean of BLEU of each with all others."""
    words = F.array_remove(F.split(F.lower("text"), r"[ \t\n\r]+"), "")
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), words.alias("words"))
    return overlap.self_bleu(t).groupBy(F.col("grp").alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("bleu"), 6).alias("self_bleu"))


@query(r"""WITH q AS (SELECT item_id, text, item_id % 3 AS shape, string_split_regex(trim(text), ' +') AS w FROM benchmark)
SELECT 'q' || item_id AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN w[1] ELSE w[2] END AS answer, CASE WHEN item_id % 2 = 0 OR shape = 2 THEN 'multiple_choice' ELSE 'open_ended' END AS question_type,
  CASE WHEN shape = 0 AND item_id % 2 = 0 THEN ['A. ' || w[2], 'B. ' || w[1]] WHEN shape = 1 AND item_id % 2 = 0 OR shape = 2 THEN [w[1], w[2]] END AS options,
  CASE WHEN shape = 0 AND item_id % 2 = 0 THEN CASE WHEN lower(w[2]) = lower(w[1]) THEN 'A' ELSE 'B' END WHEN shape = 1 AND item_id % 2 = 0 THEN 'B' WHEN shape = 2 THEN CASE WHEN left(upper(CASE WHEN item_id % 2 = 0 THEN w[1] ELSE w[2] END), 1) IN ('A', 'B', 'C', 'D') THEN left(upper(CASE WHEN item_id % 2 = 0 THEN w[1] ELSE w[2] END), 1) END END AS correct_option,
  CASE WHEN shape = 1 THEN item_id::VARCHAR END AS level FROM q""")
def question_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a folder of files of three shapes, one of which is broken, in one plan."""
    path, k = scratch(spark, "questions"), F.col("item_id")
    w = F.split(F.trim("text"), " +")
    first, second, even = w[0], w[1], k % 2 == 0
    b = table(spark, sf_dir, "benchmark").withColumn("id", F.concat(F.lit("q"), k)).withColumn("answer", F.when(even, first).otherwise(second))
    keyed = F.struct(F.col("id"), F.col("text").alias("Q"), F.col("answer").alias("A"), F.when(even, F.struct(second.alias("A"), first.alias("B"))).alias("options"))
    old = F.struct(F.col("id").alias("question_id"), F.col("text").alias("question"), "answer", F.when(even, F.array(first, second)).alias("options"), F.when(even, "b").alias("correct_option"), k.cast("string").alias("level"))
    mixed = F.struct("id", F.col("text").alias("Q"), "answer", F.array(first, second).alias("options"))
    item = F.when(k % 3 == 0, F.to_json(keyed)).when(k % 3 == 1, F.to_json(old)).otherwise(F.to_json(mixed))
    files = b.select((k % 3).alias("shape"), F.floor(k / 60).alias("file"), item.alias("item")).groupBy("shape", "file").agg(F.concat_ws(",\n", F.collect_list("item")).alias("items"))
    whole = F.when(F.col("shape") == 0, F.concat(F.lit('{"qars": ['), "items", F.lit("]}"))).when(F.col("shape") == 1, F.concat(F.lit('{"about": 1, "questions": ['), "items", F.lit("]}"))).otherwise(F.concat(F.lit("["), "items", F.lit("]")))
    broken = files.select("shape", (-1 - F.col("file")).alias("file"), F.lit('{"questions": [{"question": "cut').alias("value"))
    files.select("shape", "file", whole.alias("value")).unionByName(broken).write.partitionBy("shape", "file").text(path)
    q = nested.questions(nested.json_files(spark, f"{path}/*/*/*.txt"))
    return q.select("question_id", "question", "answer", "question_type", "options", "correct_option", F.expr("variant_get(item, '$.level', 'string')").alias("level"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, 'turns[' || i || '].' || unnest(['who', 'said.text', 'said.marks[0][1].note']) AS path, unnest([role, text, 'turn ' || turn]) AS value FROM c UNION ALL SELECT DISTINCT conv_id, 'name', 's' || conv_id FROM c""")
def string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string in sessions stored as nested objects and arrays, with the path that leads to it."""
    note = F.array(F.array(F.lit(None).cast("struct<note:string>"), F.struct(F.concat(F.lit("turn "), "turn").alias("note"))))
    turn = F.struct("turn", F.col("role").alias("who"), F.struct("text", note.alias("marks")).alias("said"))
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    c = c.select("conv_id", F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("name"), "turns")).alias("json"))
    return nested.string_leaves(c.select("conv_id", F.parse_json("json").alias("value")))


@query("""WITH c AS (SELECT conv_id // 12 AS owner, conv_id % 12 + 1 AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role AS speaker, trim(text) AS text FROM conversations)
SELECT owner, session, position, speaker, text FROM c WHERE text <> ''""")
def keyed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of corpora that are objects with a key per session, of two nestings in one folder, sessions in the order of their numbers."""
    path, owner = scratch(spark, "keyed"), F.floor(F.col("conv_id") / 12)
    turn = F.struct("turn", F.col("role").alias("speaker"), F.when(owner % 2 == 0, F.col("text")).alias("clean_text"), F.when(owner % 2 == 1, F.col("text")).alias("text"))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    entry = F.concat(F.lit('"session_'), F.col("conv_id") % 12 + 1, F.lit('": '), F.to_json("turns"), F.lit(', "session_'), F.col("conv_id") % 12 + 1, F.lit('_date_time": "noon"'))
    o = s.groupBy(owner.alias("owner")).agg(F.concat_ws(", ", F.collect_list(entry)).alias("sessions"))
    plain = F.concat(F.lit('{"name": "x", '), "sessions", F.lit("}"))
    o.select("owner", F.when(F.col("owner") % 2 == 0, plain).otherwise(F.concat(F.lit('[{"conversation": '), plain, F.lit("}]"))).alias("value")).write.partitionBy("owner").text(path)
    found = nested.keyed_sessions(nested.json_files(spark, f"{path}/*/*.txt"))
    return found.select(F.regexp_extract("file", "owner=([0-9]+)", 1).cast("long").alias("owner"), "session", "position", "speaker", "text")
