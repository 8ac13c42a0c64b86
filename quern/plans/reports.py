"""Reports and intervals: metrics by dimension, bootstraps, named percentiles, latency and serving cells, audits, text checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed, maths, spans, stems
from quern.operators import retrieval as rt
from quern.operators import statistics
from quern.plans.evaluation import SCORE_SQL, score_case
from quern.plans.registry import query
from quern.plans.retrieval import ASKED, TURNS, asked, bm25_sql, turns
from quern.plans.scoring import _list
from quern.sources.tables import kept, messages, table


@query(f"WITH s AS ({SCORE_SQL}) SELECT dimension, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(score), 6) AS mean_score, list_sort(list(score))[count(*) // 2 + 1] AS upper_median, round(avg(correct::INT) FILTER (WHERE mode = 'abstain'), 6) AS deny_accuracy, round(avg(correct::INT) FILTER (WHERE mode = 'disclose'), 6) AS disclose_accuracy FROM s GROUP BY dimension")
def metrics_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, mean and upper median score, and accuracy where a refusal or a disclosure is due, by dimension."""
    right = F.col("correct").cast("int")
    part = lambda mode: F.round(F.avg(F.when(F.col("mode") == mode, right)), 6)
    return score_case(spark, sf_dir).groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("mean_score"), (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -score)")).alias("upper_median"), part("abstain").alias("deny_accuracy"), part("disclose").alias("disclose_accuracy"))


def percentile_of(values: Column, share: float, way: str) -> Column:
    """A percentile of a sorted array: linear between neighbours, of the nearest rank, or cut at an index from below or above."""
    n = F.size(values)
    at = lambda i: F.get(values, F.greatest(F.lit(0), F.least(n - 1, i)).cast("int"))
    place = share * (n - 1)
    if way == "linear":
        low = F.floor(place)
        return at(low) + (place - low) * (at(low + 1) - at(low))
    if way == "nearest":
        return at(F.bround(place))
    return at(F.floor(share * n + 1e-9) - (1 if way == "above" else 0))


#: Draws that a task makes, or that meet their rows in it, on average.
DRAWS = 2**20


def drawn_means(rows: DataFrame, by: list[str], value: str, draws: int, seed: str) -> DataFrame:
    """by, b, mean: means of `draws` samples with replacement of each group's rows (numbered by k, from 0, within it).

    Draw i of sample b takes the row whose number is a hash of (seed, b, i) modulo the group's size, so no state is kept.
    Each row stands for the draw of its number. Rows are dealt out before they are multiplied, and draws by the row that they
    take, to so many tasks that each has about DRAWS. Null values are drawn but do not count."""
    n = rows.groupBy(*by).agg(F.count("*").alias("m"))
    tasks = 1 + rows.count() * draws // DRAWS
    wanted = rows.select(*by, F.col("k").alias("i")).join(n, by).repartition(tasks).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long")
    drawn = wanted.select(*by, "b", (key % F.col("m")).alias("k")).repartition(tasks, *by, "k")
    return drawn.join(rows.select(*by, "k", value).repartition(tasks, *by, "k").hint("merge"), [*by, "k"]).groupBy(*by, "b").agg(F.avg(value).alias("mean"))


BOOT_SQL = """a AS (SELECT lang, doc_id % 2 AS k_docs, quality, row_number() OVER (PARTITION BY lang, doc_id % 2 ORDER BY doc_id) - 1 AS k FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, k_docs, count(*) AS m FROM a GROUP BY ALL),
d AS (SELECT lang, k_docs, b, ('0x' || substr(md5('s:' || b || ':' || i), 1, 8))::BIGINT % m AS k FROM (SELECT *, unnest(range(m)) AS i FROM n), range(100) t(b)), r AS (SELECT lang, k_docs, b, avg(quality) AS mean FROM d JOIN a USING (lang, k_docs, k) GROUP BY ALL), s AS (SELECT lang, k_docs, list_sort(list(mean)) AS v FROM r GROUP BY ALL)"""


@query(f"""WITH {BOOT_SQL} SELECT lang, k_docs, round(v[3] + (99 * 0.025 - 2) * (v[4] - v[3]), 6) AS linear_low, round(v[97] + (99 * 0.975 - 96) * (v[98] - v[97]), 6) AS linear_high, round(v[3], 6) AS nearest_low, round(v[3], 6) AS cut_low, round(v[97], 6) AS cut_high, round(m.mean, 6) AS mean
FROM s JOIN (SELECT lang, k_docs, avg(quality) AS mean FROM a GROUP BY ALL) m USING (lang, k_docs)""")
def iid_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per budget and dimension with intervals from rows drawn anew, by each way to cut a percentile."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", (F.col("doc_id") % 2).alias("k_docs"), "quality", "doc_id")
    by = ["lang", "k_docs"]
    a = kept(statistics.sums_below(a.withColumn("n", F.lit(1)), "doc_id", by, "n", "k").drop("n"), "numbered")
    s = drawn_means(a, by, "quality", 100, "s").groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("v"))
    cut = lambda share, way, name: F.round(percentile_of(F.col("v"), share, way), 6).alias(name)
    point = a.groupBy(*by).agg(F.round(F.avg("quality"), 6).alias("mean"))
    return s.join(point, by).select(*by, cut(0.025, "linear", "linear_low"), cut(0.975, "linear", "linear_high"), cut(0.025, "nearest", "nearest_low"), cut(0.025, "below", "cut_low"), cut(0.975, "above", "cut_high"), "mean")


@query("""WITH a AS (SELECT source, lang, sum(quality) AS x, sum(toxic) AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), u AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM a)),
d AS (SELECT b, ('0x' || substr(md5('p:' || b || ':' || u.k), 1, 8))::BIGINT % m AS k FROM u, range(100) t(b)), r AS (SELECT b, lang, sum(x) / sum(n) - sum(y) / sum(n) AS delta FROM d JOIN u USING (k) JOIN a USING (source) GROUP BY ALL), g AS (SELECT b, avg(delta) AS macro FROM r GROUP BY b)
SELECT count(*) AS n_draws, round(avg(macro), 6) AS mean, round(quantile_cont(macro, 0.025), 6) AS low, round(quantile_cont(macro, 0.975), 6) AS high, round(least(1, 2 * least(avg((macro <= 0)::INT), avg((macro >= 0)::INT))), 6)::DOUBLE AS p FROM g""")
def macro_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval and two-sided p of the mean, over dimensions, of the paired difference, when whole sources are drawn anew."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    a = rows.groupBy("source", "lang").agg(F.sum("quality").alias("x"), F.sum("toxic").alias("y"), F.count("*").alias("n"))
    u = a.select("source").distinct().withColumn("k", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))
    size = u.agg(F.count("*").alias("m"))  # one row
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("p"), "b", "i")), 1, 8), 16, 10).cast("long")
    draws = size.select("m", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select("b", (key % F.col("m")).alias("k"))
    r = draws.join(u, "k").join(a, "source").groupBy("b", "lang").agg((F.sum("x") / F.sum("n") - F.sum("y") / F.sum("n")).alias("delta")).groupBy("b").agg(F.avg("delta").alias("macro"))
    tail = lambda c: F.avg(c.cast("int"))
    p = F.least(F.lit(1.0), 2 * F.least(tail(F.col("macro") <= 0), tail(F.col("macro") >= 0)))
    return r.agg(F.count("*").alias("n_draws"), F.round(F.avg("macro"), 6).alias("mean"), F.round(F.percentile("macro", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("macro", F.lit(0.975)), 6).alias("high"), F.round(p, 6).alias("p"))


@query("""WITH c AS (SELECT o_orderpriority AS reader, l_shipmode AS backend, l_quantity AS prompt, l_linenumber AS completion, 0.02::DOUBLE + 0.001::DOUBLE * l_quantity + 0.00001::DOUBLE * l_quantity * l_quantity AS ttft, 0.1::DOUBLE + l_tax AS answer FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT reader, backend, count(*) AS n, median(prompt) AS prompt_tokens, median(completion) AS completion_tokens, round(median(ttft), 6) AS ttft, round(median(answer), 6) AS answer, round(median(CASE WHEN answer - ttft > 0 THEN completion / (answer - ttft) END), 4) AS tokens_a_second, round(median(ttft) + median(answer), 6) AS total FROM c GROUP BY ALL""")
def serving_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of tokens, first-token time by its curve, answer time and decoding rate of each reader and backend."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("reader"))
    c = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("reader", F.col("l_returnflag").alias("backend"), F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("completion"), maths.first_token_time(F.col("l_quantity"), 0.02, 0.001, 0.00001).alias("ttft"), (0.1 + F.col("l_tax")).alias("answer"))
    gap = F.col("answer") - F.col("ttft")
    median = lambda x, places, name: F.round(F.median(x), places).alias(name)
    return c.groupBy("reader", "backend").agg(F.count("*").alias("n"), F.median("prompt").alias("prompt_tokens"), F.median("completion").alias("completion_tokens"), median("ttft", 6, "ttft"), median("answer", 6, "answer"), median(F.when(gap > 0, F.col("completion") / gap), 4, "tokens_a_second"), F.round(F.median("ttft") + F.median("answer"), 6).alias("total"))


@query(bm25_sql(TURNS, ASKED, """, g AS (SELECT q.question_id, min(h.rank) FILTER (WHERE m.conv_id = q.excluded) AS gold_rank, max(h.score) FILTER (WHERE m.conv_id <> q.excluded) > coalesce(max(h.score) FILTER (WHERE m.conv_id = q.excluded), 0) AS outscored FROM q LEFT JOIN hits h USING (question_id) LEFT JOIN m ON m.msg_id = h.doc_id GROUP BY q.question_id)
SELECT count(*) AS n, count(*) FILTER (WHERE gold_rank IS NULL) AS missed, median(gold_rank) AS median_rank, round(avg(coalesce(outscored, false)::INT), 6) AS outscored FROM g"""))
def bm25_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the ten best turns miss the evidence, its median rank, and how often another turn scores higher."""
    m = messages(spark, sf_dir).select(F.col("msg_id").alias("doc_id"), "conv_id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    h = q.join(rt.bm25(turns(spark, sf_dir), asked(spark, sf_dir)).join(m, "doc_id"), "question_id", "left")
    gold = F.col("conv_id") == F.col("question_id")
    best = lambda c: F.max(F.when(c, F.col("score")))
    g = h.groupBy("question_id").agg(F.min(F.when(gold, F.col("rank"))).alias("rank"), (best(~gold) > F.coalesce(best(gold), F.lit(0.0))).alias("outscored"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("rank").isNull()).alias("missed"), F.median("rank").alias("median_rank"), F.round(F.avg(F.coalesce("outscored", F.lit(False)).cast("int")), 6).alias("outscored"))


STOP = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "on", "by", "it", "as", "at", "an", "or", "are"]
STEM_SQL = """s1 AS (SELECT *, regexp_replace(regexp_replace(w, '^(.{2,})ies$', '\\1y'), '^(.{2,}[^s])s$', '\\1') AS a FROM {src}),
s2 AS (SELECT *, CASE a WHEN 'sent' THEN 'send' WHEN 'told' THEN 'tell' WHEN 'knew' THEN 'know' WHEN 'known' THEN 'know' WHEN 'felt' THEN 'feel' WHEN 'thought' THEN 'think' WHEN 'kept' THEN 'keep' WHEN 'took' THEN 'take' WHEN 'taken' THEN 'take' WHEN 'got' THEN 'get' WHEN 'gotten' THEN 'get' WHEN 'shot' THEN 'shoot' ELSE a END AS b FROM s1),
s3 AS (SELECT *, regexp_replace(b, '^(.{3,}?)(?:ing|ed|ly)$', '\\1') AS c FROM s2), s4 AS (SELECT *, CASE WHEN length(c) > 3 AND right(c, 1) = left(right(c, 2), 1) THEN left(c, length(c) - 1) ELSE c END AS d FROM s3),
stemmed AS (SELECT *, regexp_replace(regexp_replace(d, '^(.{3,})e$', '\\1'), '^(.{3,})i$', '\\1y') AS stem FROM s4)"""


@query(f"""WITH k AS (SELECT conv_id, turn, replace(replace(lower(text), '’', ''''), '‘', '''') AS low FROM conversations), t AS (SELECT conv_id, turn, unnest(regexp_extract_all(low, '[a-z0-9]+(?:''[a-z]+)*')) AS x, generate_subscripts(regexp_extract_all(low, '[a-z0-9]+(?:''[a-z]+)*'), 1) AS i FROM k),
b AS (SELECT conv_id, turn, i, regexp_replace(CASE x WHEN 'can''t' THEN 'can' WHEN 'won''t' THEN 'will' WHEN 'shan''t' THEN 'shall' ELSE x END, '(?:n''t|''s|''re|''ve|''ll|''d|''m)$', '') AS w FROM t), f AS (SELECT * FROM b WHERE length(w) >= 2 AND NOT list_contains({_list(STOP)}, w)), {STEM_SQL.replace("{src}", "f")},
g AS (SELECT conv_id, turn, stem, arg_min(w, i) AS word FROM stemmed WHERE NOT list_contains({_list(STOP)}, stem) GROUP BY ALL) SELECT conv_id, turn, string_agg(stem || ':' || word, ' ' ORDER BY stem) AS words, count(*) AS n FROM g GROUP BY ALL""")
def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content words of turns by stem, each with the first form it has."""
    found = stems.stem_rows(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", STOP)
    g = found.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("stem", "word"))).alias("w"))
    return g.select("conv_id", "turn", F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["stem"], x["word"])), " ").alias("words"), F.size("w").cast("long").alias("n"))


@query(r"""WITH b AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'Did Ann keep the secret door?' WHEN 1 THEN 'What is Bob''s {place}' WHEN 2 THEN 'Where did Ann walk?' WHEN 3 THEN 'Ann walked to doors' ELSE 'Was it quiet between us, Ann?' END AS q FROM benchmark),
p AS (SELECT item_id, q, (CASE WHEN item_id % 5 IN (0, 3) THEN 'content:' || CASE item_id % 5 WHEN 0 THEN 'door' ELSE 'doors,walked' END || ';' WHEN item_id % 5 = 2 THEN 'content:walk;' ELSE '' END) || CASE WHEN item_id % 5 = 0 THEN 'banned:secret;' WHEN item_id % 5 = 4 THEN 'banned:quiet;banned:between us;' ELSE '' END
|| CASE WHEN NOT contains(q, 'Ann') THEN 'form:does not name the target;' ELSE '' END || CASE WHEN contains(q, '{') THEN 'form:unfilled placeholder;' ELSE '' END || CASE WHEN NOT contains(q, '?') THEN 'form:not a question;' ELSE '' END AS problems FROM b)
SELECT item_id, replace(problems, 'content:doors,walked;', 'content:doors;content:walked;') AS problems, item_id % 5 IN (2, 3) AS keeps_cue FROM p""")
def question_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with questions about one fact, and whether they keep the topic's cue."""
    k = F.col("item_id") % 5
    q = F.when(k == 0, "Did Ann keep the secret door?").when(k == 1, "What is Bob's {place}").when(k == 2, "Where did Ann walk?").when(k == 3, "Ann walked to doors").otherwise("Was it quiet between us, Ann?")
    b = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q"))
    found = stems.query_problems(F.col("q"), F.lit("She walks through a green door"), F.lit("Ann"), STOP, ["keep"], 0.9)
    shown = F.array_join(F.transform(found, lambda x: F.concat(x["check"], F.lit(":"), x["detail"], F.lit(";"))), "")
    return b.select("item_id", shown.alias("problems"), stems.keeps_a_cue(F.col("q"), ["walking"], STOP).alias("keeps_cue"))


STEMMED = f"""k AS (SELECT conv_id, side, unnest(regexp_extract_all(low, '[a-z0-9]+(?:''[a-z]+)*')) AS x, generate_subscripts(regexp_extract_all(low, '[a-z0-9]+(?:''[a-z]+)*'), 1) AS i FROM halves),
b AS (SELECT conv_id, side, i, regexp_replace(CASE x WHEN 'can''t' THEN 'can' WHEN 'won''t' THEN 'will' WHEN 'shan''t' THEN 'shall' ELSE x END, '(?:n''t|''s|''re|''ve|''ll|''d|''m)$', '') AS w FROM k), f AS (SELECT * FROM b WHERE length(w) >= 2 AND NOT list_contains({_list(STOP)}, w)), {STEM_SQL.replace("{src}", "f")},
g AS (SELECT conv_id, side, stem, arg_min(w, i) AS word FROM stemmed WHERE NOT list_contains({_list(STOP)}, stem) GROUP BY ALL)"""
BANNED = " || ".join(rf"CASE WHEN regexp_matches(low, '\b{cue.replace(chr(39), chr(39) * 2)}') THEN 'banned:{cue.replace(chr(39), chr(39) * 2)};' ELSE '' END" for cue in fixed.SECRECY_CUES)


@query(rf"""WITH q AS (SELECT item_id, substr(text, length(text) // 3 + 1) || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '' END AS q, left(text, length(text) // 3 * 2) AS fact, string_split(text, ' ')[1] AS target FROM benchmark),
halves AS (SELECT item_id AS conv_id, 'q' AS side, replace(replace(lower(q), '’', ''''), '‘', '''') AS low FROM q UNION ALL SELECT item_id, 'f', replace(replace(lower(fact), '’', ''''), '‘', '''') FROM q), {STEMMED},
o AS (SELECT x.conv_id AS item_id, string_agg('content:' || x.word || ';', '' ORDER BY x.stem) AS shared FROM g x JOIN g y ON y.conv_id = x.conv_id AND y.stem = x.stem AND x.side = 'q' AND y.side = 'f' GROUP BY x.conv_id),
w AS (SELECT *, replace(lower(q), '’', '''') AS low, list_distinct(list_filter(string_split_regex(lower(q), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(fact), '\s+'), lambda x: x <> '')) AS b FROM q)
SELECT item_id, coalesce(shared, '') || CASE WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.3 THEN 'jaccard:too like the fact;' ELSE '' END || {BANNED}
|| CASE WHEN NOT contains(' ' || regexp_replace(q, '[^A-Za-z0-9_]', ' ', 'g') || ' ', ' ' || target || ' ') THEN 'form:does not name the target;' ELSE '' END || CASE WHEN regexp_matches(q, '[{{}}]') THEN 'form:unfilled placeholder;' ELSE '' END || CASE WHEN NOT contains(q, '?') THEN 'form:not a question;' ELSE '' END AS problems FROM w LEFT JOIN o USING (item_id)""")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with questions made of the later two thirds of benchmark texts, whose facts are the first two thirds."""
    third = F.floor(F.length("text") / 3).cast("int")
    q = F.concat(F.substring("text", third + 1, F.length("text")), F.when(F.col("item_id") % 2 == 0, "?").otherwise(""))
    b = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q"), F.substring("text", F.lit(1), third * 2).alias("fact"), F.split("text", " ")[0].alias("target"))
    found = stems.query_problems(F.col("q"), F.col("fact"), F.col("target"), STOP, [], 0.3)
    return b.select("item_id", F.array_join(F.transform(found, lambda x: F.concat(x["check"], F.lit(":"), x["detail"], F.lit(";"))), "").alias("problems"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, text FROM conversations) SELECT conv_id, turn, '{"a": "' || role || '", "b": [' || turn || ']}' AS repaired, '{"a": [' || turn || ', {"b": "x]y"}]}' AS balanced, [role, 'v ' || turn] AS leaves, CASE WHEN n > 0 THEN greatest(1, n // 4) ELSE 0 END AS tokens, left(text, 40) AS short FROM t""")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON put right, found in prose, and walked for its strings; token estimates and texts cut to ten tokens."""
    c = table(spark, sf_dir, "conversations")
    broken = F.concat(F.lit("{'a': '"), "role", F.lit("', 'b': ["), F.col("turn").cast("string"), F.lit(",],}"))
    prose = F.concat(F.lit("so } here: "), F.lit('{"a": ['), F.col("turn").cast("string"), F.lit(', {"b": "x]y"}]} and more {'))
    nested = F.concat(F.lit('{"k": "'), "role", F.lit('", "l": [1, {"m": "v '), F.col("turn").cast("string"), F.lit('"}]}'))
    return c.select("conv_id", "turn", stems.repaired_json(broken).alias("repaired"), spans.balanced_json(prose).alias("balanced"), stems.string_leaves(nested).alias("leaves"), stems.estimated_tokens(F.col("text")).alias("tokens"), stems.truncated(F.col("text"), 10).alias("short"))
