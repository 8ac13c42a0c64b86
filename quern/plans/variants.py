"""Variants of retrieval, summaries and instants that differ in a rule: fallbacks, tolerant statistics, checks of completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import maths, names, time
from quern.functions import text as tx
from quern.functions.spans import changed_spans
from quern.operators import graph, intervals, statistics
from quern.operators import retrieval as rt
from quern.plans.permissions import FLAGS_SQL, RECORDS_SQL, allowed, cell_scalars, legacy_compliance, permission_records, records
from quern.plans.registry import query
from quern.plans.retrieval import ASKED, TURNS, asked, bm25_sql, turns
from quern.sources.tables import EDGES_SQL, MESSAGES_SQL, QUESTIONS_SQL, kept, messages, questions, social_edges, table


@query(bm25_sql(TURNS, ASKED, """, best AS (SELECT question_id, doc_id, rank FROM hits WHERE score > 0), late AS (SELECT msg_id AS doc_id, row_number() OVER (ORDER BY sim_day DESC, conv_id DESC, turn DESC) AS rank FROM m QUALIFY rank <= 3)
SELECT question_id, doc_id, rank, false AS fell_back FROM best UNION ALL SELECT q.question_id, late.doc_id, late.rank, true FROM q, late WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.question_id = q.question_id)""", 3))
def memory_or_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best memories by BM25; the three latest where none scores over 0."""
    best = kept(rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir), 3).where("score > 0").select("question_id", "doc_id", "rank"), "best")  # read twice
    latest = messages(spark, sf_dir).orderBy(F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")).limit(3)
    w = Window.orderBy(F.desc("sim_day"), F.desc("conv_id"), F.desc("turn"))
    latest = latest.select(F.col("msg_id").alias("doc_id"), F.row_number().over(w).cast("long").alias("rank"))
    bare = questions(spark, sf_dir).select("question_id").join(best, "question_id", "left_anti").crossJoin(F.broadcast(latest))  # three rows
    return best.withColumn("fell_back", F.lit(False)).unionByName(bare.withColumn("fell_back", F.lit(True)))


@query(f"WITH {MESSAGES_SQL} SELECT msg_id, row_number() OVER (ORDER BY sim_day DESC, conv_id DESC, turn DESC) AS position FROM m QUALIFY position <= 50")
def corpus_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest turns of the whole corpus, for baselines that see everything."""
    order = [F.desc("sim_day"), F.desc("conv_id"), F.desc("turn")]
    last = messages(spark, sf_dir).orderBy(*order).limit(50)
    return last.select("msg_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@query(f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, a AS (SELECT question_id, excluded, CASE WHEN question_id % 3 = 0 THEN 1 END AS wanted, CASE WHEN question_id % 3 = 1 THEN 'assistant' END AS speaker FROM q),
j AS (SELECT a.*, m.turn, m.role, m.text, row_number() OVER (PARTITION BY a.question_id ORDER BY m.turn) AS k FROM a JOIN m ON m.conv_id = a.excluded)
SELECT question_id, coalesce(max(text) FILTER (WHERE turn = wanted), arg_min(text, turn) FILTER (WHERE role = speaker), string_agg(text, ' ' ORDER BY turn) FILTER (WHERE k <= 5)) AS said FROM j GROUP BY question_id""")
def turn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of an instance: its turn, else its speaker's first turn, else the session's first five turns."""
    k = F.col("question_id")
    a = questions(spark, sf_dir).select("question_id", F.col("excluded").alias("conv_id"), F.when(k % 3 == 0, 1).alias("wanted"), F.when(k % 3 == 1, "assistant").alias("speaker"))
    j = a.join(messages(spark, sf_dir).select("conv_id", "turn", "role", "text"), "conv_id")
    own, first = F.max(F.when(F.col("turn") == F.col("wanted"), F.col("text"))), F.min(F.when(F.col("role") == F.col("speaker"), F.struct("turn", "text")))["text"]
    head = F.array_join(F.slice(F.sort_array(F.collect_list(F.struct("turn", "text"))), 1, 5)["text"], " ")
    return j.groupBy("question_id").agg(F.coalesce(own, first, head).alias("said"))


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN question_id % 2 = 0 THEN '' ELSE 's' || excluded END AS evidence, CASE WHEN question_id % 2 = 0 THEN 'withheld' ELSE 'full' END AS tier FROM q")
def withheld_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose evidence is taken away for one tier; the rest of them stays."""
    hide = F.col("question_id") % 2 == 0
    i = questions(spark, sf_dir).select("question_id", F.struct(F.concat(F.lit("s"), "excluded").alias("evidence"), F.lit("full").alias("tier")).alias("i"))
    i = i.withColumn("i", F.when(hide, F.col("i").withField("evidence", F.lit("")).withField("tier", F.lit("withheld"))).otherwise(F.col("i")))
    return i.select("question_id", "i.evidence", "i.tier")


@query(f"""WITH {RECORDS_SQL} SELECT backend, count(*) AS submitted, count(flag) AS answered, bool_and(flag IS NOT NULL) AS complete, bool_and(NOT starts_with(qid, 'd4') OR label <> 'COMPLY') AS relabelled, count(*) FILTER (WHERE label = 'OTHER') = 0 AS none_pending FROM r GROUP BY backend""")
def completeness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run answered all, labelled all permission items anew, and left none pending."""
    done = F.col("flag").isNotNull()
    labelled = ~F.startswith("qid", F.lit("d4")) | (F.col("label") != "COMPLY")
    return records(spark, sf_dir).groupBy("backend").agg(F.count("*").alias("submitted"), F.count("flag").alias("answered"), F.every(done).alias("complete"), F.every(labelled).alias("relabelled"), (F.count_if(F.col("label") == "OTHER") == 0).alias("none_pending"))


@query("SELECT d.lang, min(d.doc_id) AS next FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
def next_unannotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language that nobody labelled yet."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.min("doc_id").alias("next"))


@query(f"""WITH {FLAGS_SQL}, d AS (SELECT backend, 'D' || (doc_id % 5 + 1) AS dim, 100 * avg(correct::INT) AS x FROM f WHERE NOT starts_with(qid, 'd4') GROUP BY ALL), p AS (SELECT backend, max(x) FILTER (WHERE dim = 'D1') AS d1, max(x) FILTER (WHERE dim = 'D2') AS d2, max(x) FILTER (WHERE dim = 'D3') AS d3, max(x) FILTER (WHERE dim = 'D4') AS d4, max(x) FILTER (WHERE dim = 'D5') AS d5 FROM d GROUP BY backend),
c AS (SELECT backend, avg(told) FILTER (WHERE allow) AS u, 1 - avg(by_label) FILTER (WHERE NOT allow) AS p FROM f WHERE starts_with(qid, 'd4') GROUP BY backend), s AS (SELECT backend, 100 * round(CASE WHEN u + p > 0 THEN 2 * u * p / (u + p) ELSE 0 END, 6) AS d6 FROM c)
SELECT backend, round(d6, 2) AS d6, round((d1 + d2) / 2, 2) AS recall, round((d3 + d4) / 2, 2) AS reasoning, round((d5 + d6) / 2, 2) AS trust, round((d1 + d2 + d3 + d4 + d5 + d6) / 6, 2) AS average FROM p JOIN s USING (backend)""")
def paper_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reasoning, trust and the average over six dimensions of each backend, in percent."""
    r = records(spark, sf_dir)
    d = r.where("NOT startswith(qid, 'd4')").groupBy("backend", F.concat(F.lit("d"), F.col("doc_id") % 5 + 1).alias("dim")).agg((100 * F.avg(F.col("correct").cast("int"))).alias("x"))
    p = d.groupBy("backend").agg(*[F.max(F.when(F.col("dim") == f"d{k}", F.col("x"))).alias(f"d{k}") for k in range(1, 6)])
    s = cell_scalars(permission_records(r), ["backend"]).select("backend", (100 * F.col("f1_pu")).alias("d6"))
    mean = lambda name, *ks: F.round(sum((F.col(f"d{k}") for k in ks[1:]), F.col(f"d{ks[0]}")) / len(ks), 2).alias(name)
    return p.join(s, "backend").select("backend", F.round("d6", 2).alias("d6"), mean("recall", 1, 2), mean("reasoning", 3, 4), mean("trust", 5, 6), mean("average", 1, 2, 3, 4, 5, 6))


@query("""WITH v AS (SELECT user_id, CASE WHEN (event_id % 3 > 0 OR user_id % 7 > 0) AND (event_id % 2 = user_id % 2 OR user_id % 5 > 0) THEN value END AS x FROM events) SELECT user_id, count(x) AS n, round(avg(x), 6) AS mean, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS sd FROM v GROUP BY user_id""")
def tolerant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation over the values that are there: none give null, one has deviation 0. NaN counts as missing."""
    k, u = F.col("event_id"), F.col("user_id")
    v = table(spark, sf_dir, "events").select("user_id", F.when(((k % 3 > 0) | (u % 7 > 0)) & ((k % 2 == u % 2) | (u % 5 > 0)), F.col("value")).otherwise(F.lit(float("nan"))).alias("x"))
    x = F.when(~F.isnan("x"), F.col("x"))
    return v.groupBy("user_id").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x)), 6).alias("sd"))


@query("""WITH c AS (SELECT user_id % 400 AS cell, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY ALL) SELECT cell, n, round(list_avg(v), 3) AS mean, round(list_median(v), 6) AS median, CASE WHEN n >= 20 THEN v[(n * 95 // 100 + 1)::INT] END AS p95, v[-1] AS peak FROM c""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, 95th percentile by index (of twenty samples or more) and peak of each cell."""
    v = F.sort_array(F.collect_list("value"))
    c = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 400).alias("cell")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), v.alias("v"), F.max("value").alias("peak"))
    return c.select("cell", "n", F.round("mean", 3).alias("mean"), F.round("median", 6).alias("median"), F.when(F.col("n") >= 20, F.get("v", F.floor(F.col("n") * 95 / 100).cast("int"))).alias("p95"), "peak")


@query(f"""WITH {RECORDS_SQL}, d AS (SELECT backend, doc_id % 3 AS k FROM r WHERE mode IN ('deny', 'abstain') AND label = 'REFUSE') SELECT backend, CASE k WHEN 0 THEN 'info_absent' WHEN 1 THEN 'privacy' ELSE 'other' END AS provenance, count(*) AS n FROM d GROUP BY ALL""")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the refusals of denied items come from, per backend (REFUSE is the label of today for the legacy REFUSAL)."""
    legacy = F.when(F.col("label") == "REFUSE", "REFUSAL").otherwise(F.col("label"))
    d = records(spark, sf_dir).where(F.col("mode").isin("deny", "abstain") & legacy_compliance(legacy, F.col("mode")))
    return d.groupBy("backend", tx.provenance_of_refusal(F.col("prediction")).alias("provenance")).agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT backend, seed, avg((label = 'REFUSE')::INT) FILTER (WHERE upper(coalesce(policy_expected, '')) <> 'ALLOW') AS w, avg((label = 'REFUSE')::INT) FILTER (WHERE upper(coalesce(policy_expected, '')) = 'ALLOW') AS f FROM r GROUP BY ALL)
SELECT backend, count(*) AS n_seeds, round(avg(w), 6) AS withhold, round(coalesce(stddev_samp(w), 0), 6) AS withhold_sd, round(avg(f), 6) AS false_refusal FROM s WHERE w IS NOT NULL AND f IS NOT NULL GROUP BY backend""")
def withhold_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of due and of false refusals over the seeds that have both sides."""
    allow, refuse = allowed(F.col("policy_expected")), (F.col("label") == "REFUSE").cast("int")
    s = records(spark, sf_dir).groupBy("backend", "seed").agg(F.avg(F.when(~allow, refuse)).alias("w"), F.avg(F.when(allow, refuse)).alias("f")).where("w IS NOT NULL AND f IS NOT NULL")
    return s.groupBy("backend").agg(F.count("*").alias("n_seeds"), F.round(F.avg("w"), 6).alias("withhold"), F.round(F.coalesce(F.stddev_samp("w"), F.lit(0.0)), 6).alias("withhold_sd"), F.round(F.avg("f"), 6).alias("false_refusal"))


@query("""WITH b AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, n, unnest(range(1, n + 1)) AS k FROM b), y AS (SELECT conv_id, k, chr((65 + (conv_id + k) % 4)::INT) AS gold, CASE WHEN conv_id % 3 = 0 AND k = 1 THEN 'E' WHEN conv_id % 2 = 0 THEN lower(chr((65 + (conv_id + k) % 4)::INT)) WHEN k > 1 THEN 'A' ELSE chr((65 + (conv_id + k) % 4)::INT) END AS said FROM x)
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE upper(said) = gold AND said <> 'E') AS hits, bool_and(upper(said) = gold) AS correct FROM y GROUP BY conv_id""")
def cloze_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's cloze rule: letters A to D after each number, right only if all are."""
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    x = b.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    gold = F.char((65 + (F.col("conv_id") + F.col("k")) % 4).cast("long"))
    said = F.when((F.col("conv_id") % 3 == 0) & (F.col("k") == 1), "E").when(F.col("conv_id") % 2 == 0, F.lower(gold)).when(F.col("k") > 1, "A").otherwise(gold)
    r = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", gold.alias("gold"), said.alias("said")))).alias("r"))
    text = F.array_join(F.transform("r", lambda z: F.concat(z["k"].cast("string"), F.lit(":"), z["said"])), " ")
    pattern = F.lit(r"(\d+)\s*:?\s*([A-Da-d])")
    read = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, c: F.concat(a, F.upper(c)))
    hits = F.size(F.array_intersect(F.transform("r", lambda z: F.concat(z["k"].cast("string"), z["gold"])), read))
    return r.select("conv_id", F.size("r").cast("long").alias("n"), hits.cast("long").alias("hits"), (hits == F.size("r")).alias("correct"))


@query(f"""WITH {MESSAGES_SQL}, b AS (SELECT ego, conv_id, day, '[Day ' || day || ']' || chr(10) || string_agg('  ' || role || ': ' || text, chr(10) ORDER BY turn) AS block FROM m GROUP BY ego, conv_id, day) SELECT ego, string_agg(block, chr(10) ORDER BY day, conv_id) AS shown, count(*) AS n FROM b GROUP BY ego""")
def session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's sessions as blocks: a header, then the turns, indented."""
    line = F.concat(F.lit("  "), "role", F.lit(": "), "text")
    b = messages(spark, sf_dir).groupBy("ego", "conv_id", "day").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    b = b.select("ego", "conv_id", "day", F.concat(F.lit("[Day "), "day", F.lit("]\n"), F.array_join("t.line", "\n")).alias("block"))
    return b.groupBy("ego").agg(F.array_join(F.sort_array(F.collect_list(F.struct("day", "conv_id", "block")))["block"], "\n").alias("shown"), F.count("*").alias("n"))


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT conv_id, min(day)::DOUBLE AS a, CASE WHEN conv_id % 3 > 0 THEN min(day) + 0.02 END AS b, max(sim_day) AS t FROM m GROUP BY conv_id), k AS (SELECT max(day) + 0.99 AS horizon FROM m)
SELECT conv_id, round(greatest(a, coalesce(b, a), t), 6)::DOUBLE AS ended, round(horizon, 6)::DOUBLE AS horizon, CASE WHEN conv_id % 2 = 0 THEN a::BIGINT ELSE 0 END AS instance_day, CASE WHEN conv_id % 4 = 0 THEN 5 ELSE 9 END AS message_day, '2024-02-03' AS valid_from FROM s, k""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When sessions end, the corpus ends, instances and messages happen, and facts begin to hold."""
    m, k = messages(spark, sf_dir), F.col("conv_id")
    s = m.groupBy("conv_id").agg(F.min("day").cast("double").alias("a"), F.when(F.first("conv_id") % 3 > 0, F.min("day") + 0.02).alias("b"), F.collect_list("sim_day").alias("t"))
    horizon = m.agg((F.max("day") + 0.99).alias("horizon"))  # one row
    s = s.crossJoin(horizon)
    delivered = F.when(k % 4 == 0, "5.75").when(k % 4 == 1, "")
    said = F.lit("seen on 2024-05-01, valid since 2024/02/03 and 2024-02-31")
    return s.select(
        "conv_id", F.round(F.greatest("a", "b", F.array_max("t")), 6).alias("ended"), F.round("horizon", 6).alias("horizon"), F.coalesce(F.when(k % 2 == 0, F.col("a").cast("long")), F.lit(0).cast("long")).alias("instance_day"),
        time.day_of(F.coalesce(F.nullif(delivered, F.lit("")), F.lit("9.1"))).cast("int").alias("message_day"), F.array_min(time.dates_in(said)).cast("string").alias("valid_from"))


@query(f"""WITH {EDGES_SQL}, w AS (SELECT source, target, n / 3.0::DOUBLE AS w FROM g), k AS (SELECT DISTINCT o_custkey % 200 AS a, (o_orderkey * 7 + 3) % 200 AS b FROM orders) SELECT k.a, k.b, CASE WHEN w.w >= 0.8 THEN 1 WHEN w.w >= 0.5 THEN 2 WHEN w.w >= 0.2 THEN 3 ELSE 4 END AS layer FROM k LEFT JOIN w ON w.source = least(k.a, k.b) AND w.target = greatest(k.a, k.b)""")
def layer_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of pairs of agents by the weight of their edge; without one the outermost."""
    k = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("a"), ((F.col("o_orderkey") * 7 + 3) % 200).alias("b")).distinct()
    e = social_edges(spark, sf_dir).select("source", "target", (F.col("n") / 3.0).alias("w"))
    j = k.join(e, (F.least("a", "b") == F.col("source")) & (F.greatest("a", "b") == F.col("target")), "left")
    return j.select("a", "b", maths.tier(F.coalesce("w", F.lit(0.0)), (0.8, 0.5, 0.2), (1, 2, 3, 4)).alias("layer"))


@query("""WITH p AS (SELECT lang, CASE WHEN lang = 'en' THEN 1 ELSE quality END AS a, CASE WHEN lang = 'en' THEN 1 ELSE toxic END AS b FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) AS n, avg((a = b)::INT) AS o, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS e FROM p GROUP BY lang) SELECT lang, n, round(CASE WHEN e = 1 THEN 1.0 ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa FROM s""")
def kappa_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of two binary raters, 1 where chance alone would agree always."""
    en = F.col("lang") == "en"
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.when(en, 1).otherwise(F.col("quality")).alias("a"), F.when(en, 1).otherwise(F.col("toxic")).alias("b"))
    return statistics.kappa(p, ["lang"], certain=1.0).select("lang", "n", "kappa")


@query(f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, d AS (SELECT day FROM m UNION SELECT cutoff_day FROM q), i AS (SELECT day, count(*) AS n FROM m GROUP BY day), a AS (SELECT cutoff_day AS day, count(*) AS n FROM q GROUP BY ALL)
SELECT d.day, coalesce(i.n, 0) AS ingested, coalesce(a.n, 0) AS asked, sum(coalesce(i.n, 0)) OVER (ORDER BY d.day)::BIGINT AS visible FROM d LEFT JOIN i USING (day) LEFT JOIN a USING (day)""")
def day_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by day what is taken in before that day's questions are asked, and what they can see by then; days are few."""
    i = messages(spark, sf_dir).groupBy("day").agg(F.count("*").alias("ingested"))
    a = questions(spark, sf_dir).groupBy(F.col("cutoff_day").alias("day")).agg(F.count("*").alias("asked"))
    return i.join(a, "day", "full").fillna(0).withColumn("visible", F.sum("ingested").over(Window.orderBy("day")))


STEPS_SQL = """r(source, node, steps) USING KEY (source, node) AS (SELECT DISTINCT a, a, 0 FROM d UNION SELECT r.source, d.b, r.steps + 1 FROM r JOIN d ON d.a = r.node LEFT JOIN recurring.r AS k ON k.source = r.source AND k.node = d.b WHERE k.node IS NULL),
c AS (SELECT source, min(node) AS part, count(*) AS size FROM r GROUP BY source), l AS (SELECT part, any_value(size) AS size FROM c GROUP BY part ORDER BY 2 DESC, part LIMIT 1)"""


def largest_component(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part, size of every component of edges (source, target), and the edges of the largest, of equal ones the least."""
    parts = kept(graph.components(e), "components")
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "part").limit(1)
    inside = parts.join(largest, "part", "left_semi").select(F.col("node").alias("source"))
    return sizes, e.join(inside, "source", "left_semi")


@query(f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT source, target FROM g WHERE n >= 2), d AS (SELECT source AS a, target AS b FROM s UNION SELECT target, source FROM s), {STEPS_SQL}
SELECT count(*) AS n_pairs, round(avg(steps), 6) AS mean_steps FROM r JOIN c USING (source) JOIN l USING (part) WHERE steps > 0""")
def mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean number of steps between nodes of the largest component, however far apart."""
    _, inside = largest_component(social_edges(spark, sf_dir).where("n >= 2").select("source", "target"))
    n = F.sum("n_pairs")
    return graph.path_lengths(inside).agg(F.coalesce(n, F.lit(0)).alias("n_pairs"), F.round(F.try_divide(F.sum(F.col("steps") * F.col("n_pairs")), n), 6).alias("mean_steps"))


@query(f"""WITH RECURSIVE s AS (SELECT x.conv_id * 1000 + x.turn AS source, y.conv_id * 1000 + y.turn AS target FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1), d AS (SELECT source AS a, target AS b FROM s UNION SELECT target, source FROM s), {STEPS_SQL}
SELECT (SELECT count(*) FROM (SELECT DISTINCT part FROM c)) AS n_components, (SELECT count(DISTINCT part) FROM c) = 1 AS is_connected, (SELECT size FROM l) AS largest, max(steps)::BIGINT AS diameter, round(avg(steps), 6) AS mean_steps FROM r JOIN c USING (source) JOIN l USING (part) WHERE steps > 0""")
def reply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of turns and their replies, which is a path per conversation, and the mean path of the largest."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    node = lambda shift: F.col("conv_id") * 1000 + F.col("turn") + shift
    s = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select(node(0).alias("source"), node(1).alias("target"))
    sizes, inside = largest_component(s)
    steps = graph.path_lengths(inside).agg(F.max("steps").alias("diameter"), F.round(F.sum(F.col("steps") * F.col("n_pairs")) / F.sum("n_pairs"), 6).alias("mean_steps"))
    whole = sizes.agg(F.count("*").alias("n_components"), (F.count("*") == 1).alias("is_connected"), F.max("size").alias("largest"))
    return whole.crossJoin(F.broadcast(steps))  # a row each


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT conv_id, min(sim_day) AS start FROM m GROUP BY conv_id), o AS (SELECT conv_id, row_number() OVER (ORDER BY start, conv_id) - 1 AS place FROM s), w AS (SELECT role AS entity, conv_id FROM m GROUP BY ALL) SELECT entity, min(place) AS first_place, count(*) AS n_sessions FROM w JOIN o USING (conv_id) GROUP BY entity""")
def first_mention_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place, in the corpus's order of sessions, at which each entity is first met: sessions of a day are numbered for
    themselves, and days start where those before them end."""
    m = messages(spark, sf_dir)
    s = m.groupBy("conv_id").agg(F.min("sim_day").alias("start")).withColumn("day", F.floor("start"))
    days = s.groupBy("day").agg(F.count("*").alias("n")).select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    o = s.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("start", "conv_id")) - 1).join(days, "day").select("conv_id", (F.col("before") + F.col("k")).alias("place"))
    return m.select(F.col("role").alias("entity"), "conv_id").distinct().join(o, "conv_id").groupBy("entity").agg(F.min("place").alias("first_place"), F.count("*").alias("n_sessions"))


@query("""WITH d AS (SELECT doc_id % 100 AS item, lpad(doc_id::VARCHAR, 9, '0') AS name, length(text) AS length, l.doc_id IS NOT NULL AS labelled FROM documents LEFT JOIN labels l USING (doc_id) WHERE text IS NOT NULL), t AS (SELECT item, min(name) AS target, arg_min(length, name) AS n FROM d WHERE labelled GROUP BY item)
SELECT t.item, t.target, d.name AS donor, abs(d.length - t.n) <= 0.2 * t.n AS fits FROM t JOIN d ON d.item = t.item AND NOT d.labelled QUALIFY row_number() OVER (PARTITION BY t.item ORDER BY abs(d.length - t.n), d.length, d.name) = 1""")
def length_matched_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first labelled document of each of a hundred pools the unlabelled one nearest to it in length."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (F.col("doc_id") % 100).alias("item"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.length("text").cast("long").alias("length"))
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    first = d.join(labelled, "doc_id", "left_semi").groupBy("item").agg(F.min(F.struct("name", "length")).alias("t")).select("item", "t.name", "t.length")
    return intervals.length_matched(first, d.join(labelled, "doc_id", "left_anti"))


@query("""SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS n_named, CASE WHEN contains(lower(text), 'bye') OR contains(lower(text), 'take care') OR contains(lower(text), 'see you') OR contains(lower(text), 'talk later') OR contains(lower(text), 'gotta go') OR contains(lower(text), 'nice talking') OR contains(lower(text), 'catch you later') OR contains(lower(text), 'ttyl') OR contains(lower(text), 'g2g') OR contains(lower(text), 'cya') OR contains(lower(text), 'nite') THEN 'ends' ELSE 'goes on' END AS state, 'k ' || turn || ' and Ann Lee' AS topic FROM conversations""")
def topics_and_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named things and endings of turns, and the topic of things named."""
    t = F.col("text")
    topic = names.topic(F.lit("nothing"), F.array(F.concat(F.lit("k "), "turn"), F.lit("at"), F.lit("Ann Lee"), F.lit("Bob Ray")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.entities(t)).cast("long").alias("n_named"), F.when(names.ends_conversation(t), "ends").otherwise("goes on").alias("state"), topic.alias("topic"))


@query("""SELECT conv_id, turn, 1::BIGINT AS n, 'noon ' || turn AS before, 'dusk' AS after FROM conversations WHERE turn > 0""")
def replaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that two versions of a sentence differ in."""
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    said = lambda x: F.concat(F.lit("we met at "), x, F.lit(" in the park"))
    c = c.select("conv_id", "turn", changed_spans(said(F.concat(F.lit("noon "), "turn")), said(F.lit("dusk"))).alias("s"))
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["before"].alias("before"), F.get("s", F.lit(0))["after"].alias("after"))
