"""Memory systems by name, and whom questions concern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import adapters, askers
from quern.plans.registry import query
from quern.plans.retrieval import bm25_sql
from quern.sources.tables import messages, questions, table


@query(bm25_sql("SELECT conv_id // 10 AS scope, msg_id AS doc_id, text FROM m", "SELECT question_id, question_id // 10 AS scope, text FROM q", """,
v AS (SELECT conv_id // 10 AS scope, conv_id, msg_id AS doc_id, turn, conv_id * 1000 + turn AS pos, greatest(1, length(coalesce(text, '')) // 4) AS cost FROM m),
l AS (SELECT scope, doc_id, row_number() OVER w AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM v WINDOW w AS (PARTITION BY scope ORDER BY pos DESC, doc_id DESC)),
e AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY pos, doc_id) AS rank FROM q JOIN v ON v.scope = question_id // 10 AND v.conv_id IN (question_id, question_id + 1)),
b AS (SELECT h.*, pos FROM hits h JOIN v USING (doc_id)), s AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY pos DESC, doc_id) AS rank FROM b),
u AS (SELECT question_id, doc_id, round(1.0 / (60 + hits.rank) + 1.0 / (60 + s.rank), 9)::DOUBLE AS score FROM hits JOIN s USING (question_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM u)
SELECT unnest(['inmem', 'mem0']) AS system, question_id, rank, doc_id, score FROM hits WHERE rank <= 10 UNION ALL SELECT 'vanilla', question_id, rank, doc_id, 0.0 FROM q JOIN l ON l.scope = question_id // 10 WHERE rank <= 10 AND (spent <= 300 OR rank = 1)
UNION ALL SELECT unnest(CASE WHEN question_id % 2 = 0 THEN ['oracle', 'oracle_gated'] ELSE ['oracle'] END), question_id, rank, doc_id, 0.0 FROM e WHERE rank <= 10 UNION ALL SELECT 'hybrid_rrf', question_id, rank, doc_id, score FROM r WHERE rank <= 10""", 50))
def system_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hits of each memory system for every question of its owner's turns; a system without memory has none."""
    k = F.col("question_id")
    m = messages(spark, sf_dir).select(F.floor(F.col("conv_id") / 10).alias("scope"), F.col("msg_id").alias("doc_id"), "text", F.col("conv_id").alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    q = questions(spark, sf_dir).select("question_id", F.floor(k / 10).alias("scope"), "text", F.array(k, k + 1, k).alias("gold"), (k % 2 == 0).alias("allowed"))
    found = None
    for system in ["inmem", " Mem0", "vanilla", "oracle", "oracle_gated", "baseline_session", "hybrid_rrf"]:
        adapter = adapters.build(system, test_mode=True, **({"max_tokens": 300} if system == "vanilla" else {}))
        hits = adapter.hits(m, q, 10).withColumn("system", F.lit(adapter.name))
        found = hits if found is None else found.unionByName(hits)
    return found.select("system", *adapters.HITS)


@query("""WITH s AS (SELECT conv_id, 's' || conv_id AS session_id, list_sort(list_distinct(list(CASE WHEN conv_id % 7 <> 0 THEN role || conv_id % 5 END))) AS people FROM conversations GROUP BY conv_id),
i AS (SELECT item_id AS k, text, 's' || item_id * 3 AS source, CASE WHEN item_id % 4 = 1 THEN 'user' || item_id % 6 END AS target, ['s' || item_id * 7, 's' || item_id] AS evidence, split_part(text, ' ', 1) AS word FROM benchmark),
p AS (SELECT conv_id, people, unnest(people) AS who FROM s), o AS (SELECT who, arg_min(list_filter(people, lambda x: x <> who)[1], conv_id) AS other FROM p WHERE len(people) > 1 GROUP BY who),
j AS (SELECT i.*, src.people AS src, o.other, e1.people[1] AS one, e2.people[1] AS two FROM i LEFT JOIN s src ON src.session_id = source LEFT JOIN o ON o.who = target LEFT JOIN s e1 ON e1.session_id = evidence[1] LEFT JOIN s e2 ON e2.session_id = evidence[2])
SELECT 'i' || k AS instance_id, coalesce(CASE k % 10 WHEN 0 THEN word WHEN 3 THEN 'answerer' WHEN 5 THEN word END, CASE WHEN k % 10 = 7 THEN 'meta' END, CASE WHEN k % 11 = 2 THEN 'truth' END, target, '') AS owner,
  coalesce(CASE WHEN k % 10 = 5 THEN word END, CASE WHEN k % 11 = 2 THEN 'truth' END, CASE WHEN target IS NOT NULL THEN coalesce(list_filter(src, lambda x: x <> target)[1], other, target) END, CASE WHEN k % 4 = 2 THEN src[1] END, CASE WHEN k % 10 = 3 THEN 'answerer' END, one, two, (SELECT arg_min(people, conv_id)[1] FROM s), '') AS asker FROM j""")
def owners_and_askers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and asker of every question, from fields and sessions that tell of some and not of others."""
    k, none = F.col("item_id"), F.lit(None).cast("string")
    c = table(spark, sf_dir, "conversations")
    people = F.array_sort(F.collect_set(F.when(F.col("conv_id") % 7 != 0, F.concat("role", F.col("conv_id") % 5))))
    s = c.groupBy("conv_id").agg(people.alias("people")).select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("conv_id").alias("place"), "people")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    target = F.when(k % 4 == 1, F.concat(F.lit("user"), k % 6))
    meta = F.struct(F.when(k % 10 == 1, "assistant").alias("ego_agent_id"), F.when(k % 10 == 5, word).alias("query_agent"), none.alias("instance_query_agent"), F.when(k % 10 == 7, "meta").alias("answerer_agent_id"), none.alias("target_agent"), F.array(F.concat(F.lit("s"), k * 7), F.concat(F.lit("s"), k)).alias("evidence_sessions"))
    truth = F.struct(F.when(k % 11 == 2, "truth").alias("query_agent"), target.alias("target_agent"), F.concat(F.lit("s"), k * 3).alias("source_session"), F.when(k % 4 == 2, "speaker").alias("attribute"), F.when(k % 4 == 2, "x").alias("value"))
    ego = F.when(k % 10 == 0, F.concat(F.lit(" "), word)).when(k % 10 == 2, "  ").when(k % 10 == 4, "__assistant__")
    answerer = F.when(k % 10 == 3, "answerer").when(k % 10 == 6, "assistant")
    i = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), k).alias("instance_id"), ego.alias("ego_agent_id"), answerer.alias("answerer_agent_id"), none.alias("target_agent"), meta.alias("metadata"), truth.alias("ground_truth"))
    return askers.with_askers(i, s).select("instance_id", askers.owner().alias("owner"), "asker")
