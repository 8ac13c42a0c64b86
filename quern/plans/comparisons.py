"""Paired comparisons, access checks, trimming and orderings over records and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import maths
from quern.plans.registry import query
from quern.sources.tables import MESSAGES_SQL, messages, table

JUDGES_SQL = """a AS (SELECT doc_id AS question_id, quality AS a FROM labels WHERE doc_id % 11 <> 0), b AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 3 > 0)::INT END AS b FROM labels WHERE doc_id % 7 <> 0)"""


def judges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts of two judges who each miss some questions."""
    x, k = table(spark, sf_dir, "labels"), F.col("doc_id")
    a = x.where(k % 11 != 0).select(k.alias("question_id"), F.col("quality").alias("a"))
    b = x.where(k % 7 != 0).select(k.alias("question_id"), F.when(k % 13 != 0, (k % 3 > 0).cast("int")).alias("b"))
    return a, b


@query(f"WITH {JUDGES_SQL} SELECT CASE WHEN b.question_id IS NULL THEN 'only a' WHEN a.question_id IS NULL THEN 'only b' WHEN b.b IS NULL THEN 'unscored' WHEN a.a = b.b THEN 'agree' ELSE 'differ' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (question_id) GROUP BY ALL")
def paired_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' verdicts side by side: agreeing, differing, unscored, or given by one alone."""
    a, b = judges(spark, sf_dir)
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "question_id", "full")
    outcome = F.when(F.col("in_b").isNull(), "only a").when(F.col("in_a").isNull(), "only b").when(F.col("b").isNull(), "unscored").when(F.col("a") == F.col("b"), "agree").otherwise("differ")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {JUDGES_SQL}, p AS (SELECT a.a, b.b, d.lang FROM a JOIN b USING (question_id) JOIN documents d ON d.doc_id = question_id WHERE b.b IS NOT NULL)
SELECT coalesce(lang, 'all') AS dimension, count(*) FILTER (WHERE a = 1 AND b = 1) AS both_right, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b, count(*) FILTER (WHERE a = 0 AND b = 0) AS both_wrong FROM p GROUP BY ROLLUP (lang)""")
def judge_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion of two judges per dimension and over all."""
    a, b = judges(spark, sf_dir)
    p = a.join(b.where("b IS NOT NULL"), "question_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "lang"), "question_id")
    cell = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    found = p.rollup("lang").agg(cell(1, 1).alias("both_right"), cell(1, 0).alias("only_a"), cell(0, 1).alias("only_b"), cell(0, 0).alias("both_wrong"))
    return found.select(F.coalesce("lang", F.lit("all")).alias("dimension"), "both_right", "only_a", "only_b", "both_wrong")


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE toxic = 1) AS deny, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 0) AS allow, count(*) FILTER (WHERE toxic = 0 AND doc_id % 5 = 0) AS fp FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, tp, deny - tp AS fn, fp, allow - fp AS tn, round(tp / nullif(deny, 0), 6) AS withheld, round(fp / nullif(allow, 0), 6) AS false_refusals FROM c""")
def withhold_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often denied items are withheld and allowed ones refused."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    deny = F.col("toxic") == 1
    c = rows.groupBy("source").agg(F.count_if(deny).alias("deny"), F.count_if(deny & (F.col("quality") == 1)).alias("tp"), F.count_if(~deny).alias("allow"), F.count_if(~deny & (F.col("doc_id") % 5 == 0)).alias("fp"))
    return c.select("source", "tp", (F.col("deny") - F.col("tp")).alias("fn"), "fp", (F.col("allow") - F.col("fp")).alias("tn"), F.round(F.try_divide("tp", "deny"), 6).alias("withheld"), F.round(F.try_divide("fp", "allow"), 6).alias("false_refusals"))


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT ego, conv_id, min(sim_day) AS start FROM m GROUP BY ALL), l AS (SELECT ego, conv_id FROM s QUALIFY row_number() OVER (PARTITION BY ego ORDER BY start DESC, conv_id DESC) <= 5)
SELECT b.item_id, l.conv_id IS NOT NULL AS has_access FROM benchmark b LEFT JOIN l ON l.ego = b.item_id % 10 AND l.conv_id = b.item_id + 40""")
def access_last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question's source is among its owner's five latest sessions."""
    s = messages(spark, sf_dir).groupBy("ego", "conv_id").agg(F.min("sim_day").alias("start"))
    last = s.withColumn("k", F.row_number().over(Window.partitionBy("ego").orderBy(F.desc("start"), F.desc("conv_id")))).where("k <= 5").select("ego", "conv_id", F.lit(True).alias("found"))
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 10).alias("ego"), (F.col("item_id") + 40).alias("conv_id"))
    return b.join(last, ["ego", "conv_id"], "left").select("item_id", F.coalesce("found", F.lit(False)).alias("has_access"))


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS kept, min(event_id) AS first, max(event_id) AS last FROM n WHERE event_type = 'error' OR n < 1000 OR k <= floor(1000 * 0.8) GROUP BY event_type""")
def cap_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes at the cap of 1000 are cut to 0.8 of it, one class never is (the cap is the operator's point)."""
    w = Window.partitionBy("event_type")
    n = table(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(w.orderBy("event_id")).alias("k"), F.count("*").over(w).alias("n"))
    kept = n.where((F.col("event_type") == "error") | (F.col("n") < 1000) | (F.col("k") <= 800))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""WITH f AS (SELECT user_id, json_extract_string(props, '$.k') AS seen, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, seen, first FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first DESC) <= 5""")
def last_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last five distinct observations, by when they were first made."""
    f = table(spark, sf_dir, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("seen")).agg(F.min("event_id").alias("first"))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("first")))).where("k <= 5").drop("k")


@query("""WITH s AS (SELECT p_partkey, lower(p_brand) AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, CASE WHEN k = 0 THEN slug ELSE slug || '_' || k END AS slug FROM s""")
def slug_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, repeated ones numbered."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    s = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("slug"), k.alias("k"))
    return s.select("p_partkey", F.when(F.col("k") == 0, F.col("slug")).otherwise(F.concat_ws("_", "slug", "k")).alias("slug"))


@query("""WITH p AS (SELECT l_partkey, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS a, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem GROUP BY l_partkey),
d AS (SELECT *, b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(corr(a, b), 6) AS pearson FROM d""")
def paired_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two conditions measured on the same items, and how they go together."""
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(mean("O").alias("a"), mean("F").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    d = p.withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.median("d"), 6).alias("median"), F.round(F.percentile("d", F.lit(0.95)), 6).alias("p95"), F.round(F.corr("a", "b"), 6).alias("pearson"))


@query("""SELECT ts::DATE AS day, round(median(value), 6) AS search, round(median(greatest(0, value - (event_id % 30))), 6) AS first_token, count(*) AS n FROM events GROUP BY ALL""")
def first_token_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median search time and time to the first token of each day."""
    e = table(spark, sf_dir, "events")
    rest = F.greatest(F.lit(0.0), F.col("value") - (F.col("event_id") % 30))
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.median("value"), 6).alias("search"), F.round(F.median(rest), 6).alias("first_token"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT CASE WHEN k = 1 THEN 'first' ELSE 'later' END AS call, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM r GROUP BY ALL""")
def first_versus_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First calls of each user against later ones."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, sf_dir, "events").select("value", k.alias("k"))
    return r.groupBy(F.when(F.col("k") == 1, "first").otherwise("later").alias("call")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


@query("""WITH x AS (SELECT item_id, [item_id + 3, item_id, item_id + 1, item_id + 9] AS evidence, [item_id + 1, item_id + 7, item_id + 9] AS cited FROM benchmark),
g AS (SELECT item_id, list_filter(cited, lambda c: list_contains(evidence, c)) AS gold, evidence FROM x)
SELECT item_id, array_to_string(list_concat(gold, list_filter(evidence, lambda e: NOT list_contains(gold, e))), ',') AS ordered FROM g""")
def gold_sessions_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence sessions, the cited ones ahead."""
    i = F.col("item_id")
    x = table(spark, sf_dir, "benchmark").select("item_id", F.array(i + 3, i, i + 1, i + 9).alias("evidence"), F.array(i + 1, i + 7, i + 9).alias("cited"))
    return x.select("item_id", F.array_join(F.transform(F.array_union(F.array_intersect("cited", "evidence"), F.col("evidence")), lambda v: v.cast("string")), ",").alias("ordered"))


@query("""WITH p AS (SELECT n_nationkey AS k, (n_nationkey * 7) % 11 / 2.0::DOUBLE AS x, (n_nationkey * 5) % 13 / 2.0::DOUBLE AS y FROM nation), d AS (SELECT a.k AS here, b.k AS there, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS km FROM p a, p b)
SELECT here, there, CASE WHEN here = there THEN 0 ELSE greatest(3, least(60, round_even(CASE WHEN km < 1 THEN km * 12 WHEN km < 5 THEN 12 + (km - 1) * 6 ELSE 36 + (km - 5) * 2 END, 0)::INTEGER)) END AS minutes FROM d""")
def transit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel minutes between all places (a catalogue of 25, so the whole matrix is the result)."""
    k = F.col("n_nationkey")
    p = table(spark, sf_dir, "nation").select(k.alias("k"), ((k * 7) % 11 / 2.0).alias("x"), ((k * 5) % 13 / 2.0).alias("y"))
    d = p.alias("a").crossJoin(p.alias("b"))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    here, there = F.col("a.k"), F.col("b.k")
    return d.select(here.alias("here"), there.alias("there"), F.when(here == there, 0).otherwise(maths.minutes_for(F.sqrt(dx * dx + dy * dy))).alias("minutes"))


@query("""WITH f AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error') AND value > 10), k AS (SELECT event_id, user_id, unnest(['user_' || user_id, event_type, 'band_' || floor(value / 10)::BIGINT]) AS entity FROM f)
SELECT entity, count(*) AS n_facts, max(event_id) AS latest, round(0.9::DOUBLE, 1) AS confidence FROM k GROUP BY entity""")
def activity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from activity, indexed under three keys each."""
    f = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error') AND value > 10")
    keys = F.array(F.concat(F.lit("user_"), "user_id"), F.col("event_type"), F.concat(F.lit("band_"), F.floor(F.col("value") / 10)))
    return f.select("event_id", F.explode(keys).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_facts"), F.max("event_id").alias("latest"), F.lit(0.9).alias("confidence"))


@query("""WITH n AS (SELECT c_custkey AS a FROM customer), k AS (SELECT count(*) AS k FROM customer), e AS (SELECT DISTINCT o_custkey AS a, (o_orderkey * 7 + o_custkey) % k + 1 AS b FROM orders, k),
d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b) SELECT x.a AS knower, count(d.b) AS n_close, max(k) - 1 - count(d.b) AS n_strangers FROM n x CROSS JOIN k LEFT JOIN (SELECT d.* FROM d JOIN n ON n.a = d.b) d ON d.a = x.a GROUP BY x.a""")
def social_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many each customer knows by an edge and how many as strangers: strangers are all but the neighbours, so they are counted, not listed."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    k = n.agg(F.count("*").alias("k"))  # one row
    o = table(spark, sf_dir, "orders").crossJoin(k).select(F.col("o_custkey").alias("a"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % F.col("k") + 1).alias("b")).where("a <> b")
    d = o.unionByName(o.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().join(n.select(F.col("a").alias("b")), "b", "left_semi").groupBy("a").agg(F.count("*").alias("n_close"))
    found = n.join(d, "a", "left").fillna(0).crossJoin(k)
    return found.select(F.col("a").alias("knower"), "n_close", (F.col("k") - 1 - F.col("n_close")).alias("n_strangers"))
