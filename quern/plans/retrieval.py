"""Retrieval, fusion and context-packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.operators import dense
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.sources.tables import MESSAGES_SQL, QUESTIONS_SQL, messages, questions, table

BM25 = """
lists AS (SELECT scope, doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') AS terms FROM docs),
sizes AS (SELECT scope, doc_id, coalesce(len(terms), 0) AS length FROM lists),
scopes AS (SELECT scope, count(*) AS n, avg(length) AS mean_length, min(doc_id) AS first FROM sizes GROUP BY scope),
postings AS (SELECT scope, doc_id, term, count(*) AS tf FROM (SELECT scope, doc_id, unnest(terms) AS term FROM lists) GROUP BY ALL),
raws AS (SELECT p.scope, p.term, ln(s.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings p JOIN scopes s USING (scope) GROUP BY p.scope, p.term, s.n),
weights AS (SELECT scope, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY scope) ELSE raw END AS idf FROM raws),
asked AS (SELECT question_id, scope, term, count(*) AS times FROM (SELECT question_id, scope, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS term FROM queries) GROUP BY ALL),
parts AS (SELECT a.question_id, p.doc_id, a.times * w.idf * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * z.length / s.mean_length)) AS score
  FROM asked a JOIN weights w USING (scope, term) JOIN postings p USING (scope, term) JOIN sizes z ON z.scope = p.scope AND z.doc_id = p.doc_id JOIN scopes s ON s.scope = p.scope
  UNION ALL SELECT question_id, first, 0.0 FROM queries JOIN scopes USING (scope)),
scores AS (SELECT question_id, doc_id, round(sum(score), 6) AS score FROM parts GROUP BY question_id, doc_id),
hits AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores
  QUALIFY rank <= {k} AND (score > 0 OR rank = 1))"""


def bm25_sql(docs: str, queries: str, tail: str, k: int = 10) -> str:
    return f"WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, docs AS ({docs}), queries AS ({queries}), {BM25.format(k=k)} {tail}"


TURNS, ASKED = "SELECT 0 AS scope, msg_id AS doc_id, text FROM m", "SELECT question_id, 0 AS scope, text FROM q"
PLAIN = "SELECT question_id, rank, doc_id, score FROM hits"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(F.lit(0).alias("scope"), F.col("msg_id").alias("doc_id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", F.lit(0).alias("scope"), "text")


@query(bm25_sql(TURNS, ASKED, PLAIN))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best turns for every question by BM25."""
    return rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir))


@query(bm25_sql(
    "SELECT q.question_id AS scope, m.msg_id AS doc_id, m.text FROM q JOIN m ON m.ego = q.ego AND m.day <= q.cutoff_day AND m.conv_id <> q.excluded",
    "SELECT question_id, question_id AS scope, text FROM q", PLAIN))
def bm25_ego_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over what the question's owner had seen by its day, without the session that it stems from."""
    m = messages(spark, sf_dir).select("ego", "day", "conv_id", F.col("msg_id").alias("doc_id"), "text")
    return rt.bm25_asof(m, questions(spark, sf_dir))


@query(bm25_sql(TURNS, ASKED, "SELECT h.question_id, h.rank, '[session=' || m.conv_id || ' speaker=' || m.role || ' time=' || m.day || '] ' || m.text AS line FROM hits h JOIN m ON m.msg_id = h.doc_id"))
def bm25_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits as lines that name their session, speaker and day."""
    m = messages(spark, sf_dir)
    line = F.format_string("[session=%s speaker=%s time=%s] %s", "conv_id", "role", "day", "text")
    return bm25_topk(spark, sf_dir).join(m, F.col("doc_id") == m["msg_id"]).select("question_id", "rank", line.alias("line"))


@query(bm25_sql(TURNS, ASKED, """, aged AS (SELECT h.question_id, h.doc_id, h.score / max(h.score) OVER (PARTITION BY h.question_id) AS share, 15 - m.sim_day AS age FROM hits h JOIN m ON m.msg_id = h.doc_id),
decayed AS (SELECT question_id, doc_id, round(0.7 * coalesce(share, 0) + 0.3 * coalesce(share, 0) * exp(-ln(2) / 7.0 * age), 6) AS decayed FROM aged)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY decayed DESC, doc_id) AS rank, doc_id, decayed FROM decayed""".replace(", aged", ", aged", 1), 50))
def temporal_decay_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best turns, ranked anew by a score that fades with age."""
    m = messages(spark, sf_dir).select(F.col("msg_id").alias("doc_id"), "sim_day")
    hits = rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir), 50).drop("rank").join(m, "doc_id")
    decayed = rt.recency_decayed(hits, F.lit(15.0) - F.col("sim_day"))
    return rt.ranked(decayed, "question_id", [F.desc("decayed"), F.asc("doc_id")]).select("question_id", "rank", "doc_id", "decayed")


DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT q.vec_id AS question_id, c.vec_id AS doc_id, q.label AS wanted, c.label AS label, round(list_dot_product(q.v, c.v), 6) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM d)"""


def dense_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated set of queries among them."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return v, v.where("id % 50 = 0")


@query(f"""WITH {DENSE} SELECT question_id, rank, doc_id, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 6) AS score
FROM r WHERE rank <= 10 WINDOW w AS (PARTITION BY question_id)""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors, scores rescaled inside each result."""
    top = dense.best(dense.scored_blocks(*dense_vectors(spark, sf_dir)), 10)
    return top.select("question_id", "rank", "doc_id", F.round(rt.minmax(F.col("score"), "question_id"), 6).alias("score"))


@query(f"""WITH {DENSE}, g AS (SELECT question_id, count(*) FILTER (WHERE wanted = label) AS n_gold, count(*) FILTER (WHERE wanted = label AND rank <= 10) AS n_found,
  min(rank) FILTER (WHERE wanted = label) AS first_gold, count(*) AS n FROM r GROUP BY question_id)
SELECT question_id, n_gold, n_found, first_gold, round(n_found / nullif(n_gold, 0), 6) AS recall_at_10, round(1 / first_gold, 6) AS reciprocal_rank, round((first_gold - 1) / nullif(n - 1, 0), 6) AS normalised_rank FROM g""")
def dense_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten, reciprocal and normalised rank of vectors of the query's label."""
    g = dense.gold_ranks(dense.scored_blocks(*dense_vectors(spark, sf_dir), reused=True), 10)
    return g.select("question_id", "n_gold", "n_found", "first_gold", F.round(F.try_divide("n_found", "n_gold"), 6).alias("recall_at_10"), F.round(1 / F.col("first_gold"), 6).alias("reciprocal_rank"), F.round(F.try_divide(F.col("first_gold") - 1, F.col("n") - 1), 6).alias("normalised_rank"))


OVERLAP = """o AS (SELECT q.question_id, m.msg_id AS doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[A-Za-z0-9_]+')), list_distinct(regexp_extract_all(lower(m.text), '[A-Za-z0-9_]+')))) AS shared FROM q JOIN m ON m.ego = q.ego),
second AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, doc_id) AS rank FROM o QUALIFY rank <= 30)"""


def overlap_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 turns of the question's owner that share most distinct terms with it."""
    words = lambda c: F.array_distinct(tx.tokens(F.col(c)))
    q = questions(spark, sf_dir).select("question_id", "ego", words("text").alias("terms"))
    m = messages(spark, sf_dir).select("ego", F.col("msg_id").alias("doc_id"), words("text").alias("said"))
    both = m.join(q, "ego").select("question_id", "doc_id", F.size(F.array_intersect("terms", "said")).alias("shared"))
    return rt.ranked(both, "question_id", [F.desc("shared"), F.asc("doc_id")], 30)


@query(bm25_sql(TURNS, ASKED, f""", {OVERLAP}, fused AS (SELECT question_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT question_id, doc_id, rank FROM hits UNION ALL SELECT question_id, doc_id, rank FROM second) GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM fused QUALIFY rank <= 10""", 30))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of BM25 and of the owner's turns by shared terms."""
    fused = rt.reciprocal_ranks([rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir), 30), overlap_ranks(spark, sf_dir)])
    return fused.select("question_id", "rank", "doc_id", "score")


@query(bm25_sql(TURNS, ASKED, """, e AS (SELECT h.*, len(list_intersect(regexp_extract_all(b.text, '[A-Z][a-z]+'), regexp_extract_all(m.text, '[A-Z][a-z]+'))) > 0 AS shares FROM hits h JOIN m ON m.msg_id = h.doc_id JOIN benchmark b ON b.item_id = h.question_id),
f AS (SELECT *, count(*) FILTER (WHERE shares) OVER (PARTITION BY question_id) AS n FROM e)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, doc_id, n < 2 AS fell_back FROM f WHERE shares OR n < 2 QUALIFY rank <= 10""", 30).replace("AS rank, doc_id, n < 2", "AS new_rank, doc_id, n < 2").replace("QUALIFY rank <= 10", "QUALIFY new_rank <= 10"))
def entity_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that share a capitalised word with the question; all hits if fewer than two do."""
    names = lambda c: F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), F.lit(0))
    hits = rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir), 30)
    q = questions(spark, sf_dir).select("question_id", names(F.col("text")).alias("asked_for"))
    m = messages(spark, sf_dir).select(F.col("msg_id").alias("doc_id"), names(F.col("text")).alias("named"))
    flagged = hits.join(m, "doc_id").join(q, "question_id").withColumn("shares", F.arrays_overlap("asked_for", "named"))
    flagged = flagged.withColumn("n", F.count_if("shares").over(Window.partitionBy("question_id"))).where("shares OR n < 2").withColumnRenamed("rank", "old")
    return rt.ranked(flagged, "question_id", [F.asc("old")], 10).select("question_id", F.col("rank").alias("new_rank"), "doc_id", (F.col("n") < 2).alias("fell_back"))


@query("""WITH a AS (SELECT DISTINCT user_id AS question_id, min(ts) OVER (PARTITION BY user_id) AS anchor FROM events WHERE event_type = 'purchase'),
s AS (SELECT a.question_id, e.event_id, round(e.value / 100 + 0.5 * exp(-abs(epoch(e.ts) - epoch(a.anchor)) / 86400 / 30), 6) AS score FROM a JOIN events e ON e.user_id = a.question_id)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, event_id) AS rank, event_id, score FROM s QUALIFY rank <= 5""")
def temporal_prior_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by value plus nearness in time to the first purchase."""
    e = table(spark, sf_dir, "events")
    anchors = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("question_id")).agg(F.min("ts").alias("anchor"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    score = F.round(F.col("value") / 100 + 0.5 * F.exp(-F.abs(seconds("ts") - seconds("anchor")) / 86400 / 30), 6)
    rows = e.join(anchors, F.col("user_id") == F.col("question_id")).select("question_id", "event_id", score.alias("score"))
    return rt.ranked(rows, "question_id", [F.desc("score"), F.asc("event_id")], 5).select("question_id", "rank", "event_id", "score")


@query(bm25_sql(TURNS, ASKED, """, s AS (SELECT h.question_id, h.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[A-Za-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(m.text), '[A-Za-z0-9_]+')) AS t FROM hits h JOIN m ON m.msg_id = h.doc_id JOIN benchmark b ON b.item_id = h.question_id),
f AS (SELECT question_id, doc_id, round(2.0 * len(list_intersect(a, t)) / nullif(len(a) + len(t), 0), 6) AS score FROM s)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS new_rank, doc_id, score FROM f QUALIFY new_rank <= 5""", 20))
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty turns by BM25, the five of greatest term overlap among them."""
    words = lambda c: F.array_distinct(tx.tokens(F.col(c)))
    hits = rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir), 20).select("question_id", "doc_id")
    q = questions(spark, sf_dir).select("question_id", words("text").alias("a"))
    m = messages(spark, sf_dir).select(F.col("msg_id").alias("doc_id"), words("text").alias("t"))
    both = hits.join(m, "doc_id").join(q, "question_id")
    scored = both.select("question_id", "doc_id", F.round(F.try_divide(2.0 * F.size(F.array_intersect("a", "t")), F.size("a") + F.size("t")), 6).alias("score"))
    return rt.ranked(scored, "question_id", [F.desc("score"), F.asc("doc_id")], 5).select("question_id", F.col("rank").alias("new_rank"), "doc_id", "score")


@query(f"WITH {MESSAGES_SQL} SELECT ego, row_number() OVER (PARTITION BY ego ORDER BY sim_day DESC, conv_id DESC, turn DESC) AS position, msg_id FROM m QUALIFY position <= 20")
def ego_memory_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's twenty latest turns."""
    latest = rt.ranked(messages(spark, sf_dir), "ego", [F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")], 20)
    return latest.select("ego", F.col("rank").alias("position"), "msg_id")


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT ego, msg_id, row_number() OVER w AS position, sum(length(text) // 4 + 1) OVER w AS spent FROM m
WINDOW w AS (PARTITION BY ego ORDER BY sim_day DESC, conv_id DESC, turn DESC ROWS UNBOUNDED PRECEDING)) SELECT ego, position, msg_id, spent::BIGINT AS spent FROM s WHERE spent <= 1500 OR position = 1""")
def vanilla_budget_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's latest turns that fit 1500 estimated tokens."""
    fits = rt.budget_prefix(messages(spark, sf_dir), "ego", [F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")], F.floor(F.length("text") / 4) + 1, F.lit(1500))
    return fits.select("ego", "position", "msg_id", "spent")


@query(f"""WITH {MESSAGES_SQL}, c AS (SELECT ego, msg_id, length(text) + 1 AS cost, role = 'assistant' AS first, sim_day, conv_id, turn FROM m),
a AS (SELECT ego, msg_id, sum(cost) OVER (PARTITION BY ego ORDER BY sim_day DESC, conv_id DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM c WHERE first QUALIFY spent <= 2000),
t AS (SELECT ego, max(spent) AS used FROM a GROUP BY ego),
b AS (SELECT c.ego, c.msg_id, coalesce(t.used, 0) + sum(c.cost) OVER (PARTITION BY c.ego ORDER BY c.sim_day DESC, c.conv_id DESC, c.turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM c LEFT JOIN t USING (ego) WHERE NOT c.first QUALIFY spent <= 3000)
SELECT ego, msg_id, true AS priority, spent::BIGINT AS spent FROM a UNION ALL SELECT ego, msg_id, false, spent::BIGINT FROM b""")
def pack_priority_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns newest first up to 2000 characters, then the others from there up to 3000."""
    newest = Window.partitionBy("ego").orderBy(F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    c = messages(spark, sf_dir).withColumn("cost", F.length("text") + 1)
    a = c.where("role = 'assistant'").withColumn("spent", F.sum("cost").over(newest)).where("spent <= 2000").select("ego", "msg_id", F.lit(True).alias("priority"), "spent")
    used = a.groupBy("ego").agg(F.max("spent").alias("used"))
    b = c.where("role <> 'assistant'").withColumn("own", F.sum("cost").over(newest)).join(used, "ego", "left")
    b = b.withColumn("spent", F.coalesce("used", F.lit(0)) + F.col("own")).where("spent <= 3000").select("ego", "msg_id", F.lit(False).alias("priority"), "spent")
    return a.unionByName(b)


def _fill(order_sql: str) -> str:
    return f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, e AS (SELECT q.question_id, m.msg_id, m.conv_id = q.excluded AS evidence, length(m.text) + 1 AS cost, m.sim_day, m.conv_id, m.turn FROM q JOIN m ON m.ego = q.ego),
k AS (SELECT question_id, sum(cost) FILTER (WHERE evidence) AS used FROM e GROUP BY question_id),
f AS (SELECT e.question_id, e.msg_id, coalesce(k.used, 0) + sum(e.cost) OVER (PARTITION BY e.question_id ORDER BY {order_sql} ROWS UNBOUNDED PRECEDING) AS spent FROM e JOIN k USING (question_id) WHERE NOT e.evidence QUALIFY spent <= 4000)
SELECT question_id, msg_id, true AS evidence FROM e WHERE evidence UNION ALL SELECT question_id, msg_id, false FROM f"""


def _filled(spark: SparkSession, sf_dir: str, order: list) -> DataFrame:
    m, q = messages(spark, sf_dir), questions(spark, sf_dir).select("question_id", "ego", "excluded")
    e = m.join(q, "ego").select("question_id", "msg_id", (F.col("conv_id") == F.col("excluded")).alias("evidence"), (F.length("text") + 1).alias("cost"), "sim_day", "conv_id", "turn")
    used = e.groupBy("question_id").agg(F.coalesce(F.sum(F.when(F.col("evidence"), F.col("cost"))), F.lit(0)).alias("used"))
    w = Window.partitionBy("question_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    f = e.where("NOT evidence").withColumn("own", F.sum("cost").over(w)).join(used, "question_id").where("used + own <= 4000")
    return e.where("evidence").select("question_id", "msg_id", "evidence").unionByName(f.select("question_id", "msg_id", "evidence"))


@query(_fill("e.sim_day DESC, e.conv_id DESC, e.turn DESC"))
def distractor_fill_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's evidence, then the owner's latest other turns up to 4000 characters."""
    return _filled(spark, sf_dir, [F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")])


@query(_fill("md5(e.question_id || ':' || e.msg_id), e.msg_id"))
def distractor_fill_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with other turns in the order of a hash."""
    return _filled(spark, sf_dir, [F.md5(F.concat_ws(":", "question_id", "msg_id")), F.col("msg_id")])


@query(f"WITH {MESSAGES_SQL}, {QUESTIONS_SQL} SELECT q.question_id, m.msg_id FROM q JOIN m ON m.conv_id = q.excluded LEFT JOIN labels l ON l.doc_id = q.question_id WHERE l.toxic IS DISTINCT FROM 1")
def oracle_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence turns of questions that are not denied."""
    denied = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("question_id"))
    q = questions(spark, sf_dir).join(denied, "question_id", "left_anti").select("question_id", F.col("excluded").alias("conv_id"))
    return messages(spark, sf_dir).join(q, "conv_id").select("question_id", "msg_id")


@query("""WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id FROM c WHERE k = 1)
SELECT b.item_id, coalesce(d.doc_id, f.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 'id' WHEN f.doc_id IS NOT NULL THEN 'key' ELSE 'miss' END AS found_by
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3 AND b.item_id % 2 = 0 LEFT JOIN f ON d.doc_id IS NULL AND f.source = 'src' || (b.item_id % 25)""")
def cache_replay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks cached results up by id, then by a second key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = d.groupBy("source").agg(F.min("doc_id").alias("by_key"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id") * 3).alias("wanted"), F.concat(F.lit("src"), F.col("item_id") % 25).alias("key"))
    hit = b.join(d.select(F.col("doc_id").alias("wanted"), F.col("doc_id").alias("by_id")), "wanted", "left").join(first.withColumnRenamed("source", "key"), "key", "left")
    return hit.select("item_id", F.coalesce("by_id", "by_key").alias("doc_id"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_key").isNotNull(), "key").otherwise("miss").alias("found_by"))


@query(bm25_sql(TURNS, ASKED, """, s AS (SELECT h.question_id, m.conv_id, min(h.rank) AS rank FROM hits h JOIN m ON m.msg_id = h.doc_id WHERE m.conv_id <> h.question_id GROUP BY ALL)
SELECT s.question_id, s.conv_id, s.rank, count(m.msg_id) AS n_turns FROM s LEFT JOIN m ON m.conv_id = s.conv_id GROUP BY ALL"""))
def hits_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of a question's hits, first hit each, and their turns; its own session is left out."""
    m = messages(spark, sf_dir)
    s = bm25_topk(spark, sf_dir).join(m.select(F.col("msg_id").alias("doc_id"), "conv_id"), "doc_id").where("conv_id <> question_id").groupBy("question_id", "conv_id").agg(F.min("rank").alias("rank"))
    n = m.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return s.join(n, "conv_id", "left").select("question_id", "conv_id", "rank", F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


@query(f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, w AS (SELECT question_id, unnest([excluded, excluded + 3, excluded, excluded + 1]) AS conv_id FROM q)
SELECT question_id, string_agg(m.msg_id, ' ' ORDER BY m.sim_day, m.conv_id, m.turn) AS context, count(*) AS n_turns FROM (SELECT DISTINCT question_id, conv_id FROM w) d JOIN m USING (conv_id) GROUP BY question_id""")
def context_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a question's listed sessions, each once, in time order."""
    x = F.col("excluded")
    w = questions(spark, sf_dir).select("question_id", F.explode(F.array_distinct(F.array(x, x + 3, x, x + 1))).alias("conv_id"))
    t = w.join(messages(spark, sf_dir), "conv_id").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("sim_day", "conv_id", "turn", "msg_id"))).alias("t"))
    return t.select("question_id", F.array_join("t.msg_id", " ").alias("context"), F.size("t").cast("long").alias("n_turns"))


@query(f"""WITH {MESSAGES_SQL}, p AS (SELECT ego, count(DISTINCT conv_id) AS n_sessions, count(*) AS n_turns, sum(length(text)) AS n_chars FROM m GROUP BY ego),
e AS (SELECT user_id % 10 AS ego, count(*) AS n_events FROM events GROUP BY ALL)
SELECT ego, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_turns, 0) AS n_turns, coalesce(n_chars, 0)::BIGINT AS n_chars, coalesce(n_events, 0) AS n_events FROM p FULL JOIN e USING (ego)""")
def ego_projection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, turns, characters and events of each owner."""
    p = messages(spark, sf_dir).groupBy("ego").agg(F.count_distinct("conv_id").alias("n_sessions"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("ego")).agg(F.count("*").alias("n_events"))
    return p.join(e, "ego", "full").fillna(0).select("ego", "n_sessions", "n_turns", "n_chars", "n_events")


@query(f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, s AS (SELECT ego, list(DISTINCT conv_id) AS own FROM m GROUP BY ego)
SELECT q.question_id, len(list_filter([q.excluded, q.excluded + 10, q.excluded + q.question_id % 3], lambda x: NOT list_contains(coalesce(s.own, []), x))) = 0 AS answerable FROM q LEFT JOIN s USING (ego)""")
def ego_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of a question's evidence sessions are its owner's."""
    own = messages(spark, sf_dir).select("ego", "conv_id").distinct()
    x = F.col("excluded")
    need = questions(spark, sf_dir).select("question_id", "ego", F.explode(F.array(x, x + 10, x + F.col("question_id") % 3)).alias("conv_id"))
    return need.join(own.withColumn("own", F.lit(True)), ["ego", "conv_id"], "left").groupBy("question_id").agg(F.every(F.coalesce("own", F.lit(False))).alias("answerable"))
