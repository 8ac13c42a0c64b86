"""Agreement, rank, calibration, sampling, latency and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import maths
from quern.operators import intervals
from quern.operators import statistics as st
from quern.plans.registry import query
from quern.sources.tables import MESSAGES_SQL, messages, table

RATED_SQL = """r AS (SELECT doc_id, quality AS a, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b, toxic AS c FROM labels)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the verdicts of three raters."""
    q = F.col("quality")
    return table(spark, sf_dir, "labels").select("doc_id", q.alias("a"), F.when(F.col("doc_id") % 7 == 0, 1 - q).otherwise(q).alias("b"), F.col("toxic").alias("c"))


def _kappa(rows: str, group: str = "") -> str:
    g, using, by, on = (f"{group}, ", f"USING ({group})", f"PARTITION BY {group}", f"x.{group} = y.{group} AND ") if group else ("", "ON true", "", "")
    grouping = f"GROUP BY {group}" if group else ""
    return f"""n AS (SELECT {g}count(*) AS n, avg((a = b)::INT) AS agreement FROM {rows} {grouping}),
x AS (SELECT {g}a AS v, count(*) AS k FROM {rows} GROUP BY ALL), y AS (SELECT {g}b AS v, count(*) AS k FROM {rows} GROUP BY ALL),
c AS (SELECT {"x." + group + "," if group else ""} sum(x.k * y.k) AS met FROM x JOIN y ON {on} x.v = y.v {"GROUP BY x." + group if group else ""}),
s AS (SELECT {"n." + group + "," if group else ""} n.n, agreement, coalesce(met, 0) / (n.n * n.n) AS share FROM n LEFT JOIN c {using})
SELECT {g}n, round(agreement, 6) AS agreement, round(CASE WHEN share < 1 THEN (agreement - share) / (1 - share) END, 6) AS kappa FROM s"""


@query(f"WITH {RATED_SQL}, {_kappa('r')}")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two raters beyond chance."""
    return st.kappa(rated(spark, sf_dir).select("a", "b"), [])


@query(f"WITH {RATED_SQL}, p AS (SELECT 'a-b' AS pair, a, b FROM r UNION ALL SELECT 'a-c', a, c FROM r UNION ALL SELECT 'b-c', b, c FROM r), {_kappa('p', 'pair')}")
def kappa_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every pair of three raters."""
    pair = lambda name, x, y: F.struct(F.lit(name).alias("pair"), F.col(x).alias("a"), F.col(y).alias("b"))
    p = rated(spark, sf_dir).select(F.explode(F.array(pair("a-b", "a", "b"), pair("a-c", "a", "c"), pair("b-c", "b", "c"))).alias("p")).select("p.*")
    return st.kappa(p, ["pair"])


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM n)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS verdict FROM t WHERE n = most GROUP BY user_id""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type, null on a tie."""
    return st.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH r AS (SELECT l_returnflag, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS rb FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 6) AS rho FROM r GROUP BY l_returnflag""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of quantity and price per return flag."""
    return st.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("""WITH s AS (SELECT n_chars AS s, quality = 1 AS p FROM labels JOIN documents USING (doc_id)), w AS (SELECT a.p, sum((a.s > b.s)::INT + 0.5::DOUBLE * (a.s = b.s)::INT) AS wins, count(*) AS n FROM s a JOIN s b ON a.p AND NOT b.p GROUP BY a.p)
SELECT (SELECT count(*) FILTER (WHERE p) FROM s) AS n_positive, (SELECT count(*) FILTER (WHERE NOT p) FROM s) AS n_other, round(coalesce((SELECT wins / n FROM w), 0.5), 6) AS auc""")
def pu_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells good documents from others."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return st.auc(rows, F.col("quality") == 1, "n_chars")


@query("""WITH c AS (SELECT ((doc_id * 37) % 101) / 100.0::DOUBLE AS conf, quality AS ok FROM labels), b AS (SELECT *, (ceil(conf * 10 - 1e-9) - 1)::BIGINT AS bin FROM c WHERE conf > 0),
g AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(ok) AS acc FROM b GROUP BY bin) SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM c), 6) AS ece, count(*) AS n_bins FROM g""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error over ten bins open below; confidence 0 is in no bin but counts in the total."""
    c = table(spark, sf_dir, "labels").select((((F.col("doc_id") * 37) % 101) / 100.0).alias("conf"), F.col("quality").alias("ok"))
    g = c.groupBy(F.when(F.col("conf") > 0, F.ceil(F.col("conf") * 10 - 1e-9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("ok").alias("acc"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))))
    return g.agg(F.round(gap / F.sum("n"), 6).alias("ece"), F.count("bin").alias("n_bins"))


DRAWS_SQL = """a AS (SELECT source, sum(quality)::DOUBLE AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS k FROM labels JOIN documents USING (doc_id) GROUP BY source),
z AS (SELECT count(*) AS m FROM a), d AS (SELECT b, i, ('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % z.m AS k FROM range(200) t(b), range(1000) u(i), z WHERE i < z.m)"""


@query(f"""WITH {DRAWS_SQL}, r AS (SELECT b, sum(s) / sum(n) AS acc FROM d JOIN a USING (k) GROUP BY b)
SELECT count(*) AS n_draws, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM r""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the accuracy when whole sources are drawn anew; each source enters as its sums."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    a = rows.groupBy("source").agg(F.sum("quality").cast("double").alias("s"), F.count("*").alias("n"))
    a = a.withColumn("k", (F.row_number().over(Window.orderBy("source")) - 1).cast("long"))
    size = a.agg(F.count("*").alias("m"))
    draws = spark.range(200).withColumnRenamed("id", "b").crossJoin(size).select("b", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "i")), 1, 8), 16, 10).cast("long")
    r = draws.select("b", (key % F.col("m")).alias("k")).join(a, "k").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("acc"))
    return r.agg(F.count("*").alias("n_draws"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.percentile("acc", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("acc", F.lit(0.975)), 6).alias("high"))


@query("""SELECT doc_id, source, quality FROM labels JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source, quality ORDER BY md5('7:' || doc_id), doc_id) <= 3""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source and verdict, in the order of a hash."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")
    return st.quota_sample(rows, ["source", "quality"], F.struct(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id"), 3)


GUMBEL_SQL = """u AS (SELECT p_brand, p_partkey, p_retailprice / 100 AS score, (('0x' || substr(md5('g:' || p_partkey), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM part),
g AS (SELECT p_brand, p_partkey, round(score - ln(-ln(u)), 6) AS key FROM u)"""


@query(f"WITH {GUMBEL_SQL} SELECT p_brand, p_partkey, key FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY key DESC, p_partkey) <= 5")
def gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of each brand, drawn without replacement with softmax weights (score plus Gumbel noise from a hash)."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("g:"), "p_partkey")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    g = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / 100 - F.ln(-F.ln(u)), 6).alias("key"))
    return st.quota_sample(g, ["p_brand"], F.struct((-F.col("key")).alias("k"), "p_partkey"), 5)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def splice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a tenth of them replaced by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return st.splice(o, new, "o_orderkey")


@query(f"""WITH {MESSAGES_SQL}, e AS (SELECT conv_id, ego, max(sim_day) AS stop FROM m GROUP BY ALL), g AS (SELECT ego, max(stop) AS ego_stop FROM e GROUP BY ego)
SELECT b.item_id, round(coalesce(e.stop, g.ego_stop, (SELECT max(stop) FROM e)), 6) AS query_time, CASE WHEN e.stop IS NOT NULL THEN 'evidence' WHEN g.ego_stop IS NOT NULL THEN 'owner' ELSE 'corpus' END AS rule
FROM benchmark b LEFT JOIN e ON e.conv_id = b.item_id * 5 LEFT JOIN g ON g.ego = b.item_id % 13""")
def query_time_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a question is asked: the end of its evidence, else of its owner's sessions, else of all."""
    e = messages(spark, sf_dir).groupBy("conv_id", "ego").agg(F.max("sim_day").alias("stop"))
    g = e.groupBy("ego").agg(F.max("stop").alias("ego_stop"))
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 5).alias("conv_id"), (F.col("item_id") % 13).alias("owner"))
    rows = b.join(e.select("conv_id", "stop"), "conv_id", "left").join(g.withColumnRenamed("ego", "owner"), "owner", "left").join(F.broadcast(e.agg(F.max("stop").alias("last"))))
    rule = F.when(F.col("stop").isNotNull(), "evidence").when(F.col("ego_stop").isNotNull(), "owner").otherwise("corpus")
    return rows.select("item_id", F.round(F.coalesce("stop", "ego_stop", "last"), 6).alias("query_time"), rule.alias("rule"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.day') AS BIGINT), floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400)::BIGINT, 0) AS day FROM events""")
def session_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulated day of an event: as named, else from its time, else 0."""
    named = F.expr("try_cast(get_json_object(props, '$.day') AS BIGINT)")
    since = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 86400)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(named, since, F.lit(0)).alias("day"))


@query("""WITH q AS (SELECT c_custkey, TIMESTAMP '1995-06-01' + INTERVAL (c_custkey % 400) DAY AS asked_at FROM customer)
SELECT c_custkey, count(o_orderkey) AS n_valid, max(o_orderkey) AS latest FROM q LEFT JOIN orders ON o_custkey = c_custkey AND (o_orderdate <= asked_at + INTERVAL 30 DAY OR o_orderdate IS NULL) GROUP BY c_custkey""")
def bitemporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's facts valid by the time of the question and thirty days; undated ones always are."""
    q = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 400).cast("int").alias("days"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    limit = F.lit("1995-06-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("days") + 30)
    valid = q.join(o, "c_custkey", "left").select("c_custkey", F.when((F.col("o_orderdate") <= limit) | F.col("o_orderdate").isNull(), F.col("o_orderkey")).alias("o_orderkey"))
    return valid.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_valid"), F.max("o_orderkey").alias("latest"))


@query("""WITH w AS (SELECT event_id, epoch_ms(ts) AS a, epoch_ms(ts) + 600000 AS b FROM events WHERE event_type = 'error')
SELECT w.event_id, count(*) AS n, round(avg(s.value), 6) AS mean_power, round(max(s.value), 6) AS peak_power, round(greatest(0, (avg(s.value) - 20) * 600), 4) AS net_energy
FROM w JOIN events s ON epoch_ms(s.ts) >= w.a AND epoch_ms(s.ts) < w.b GROUP BY w.event_id""")
def telemetry_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power samples inside marked windows of ten minutes, which meet in buckets of time."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "value", "event_type")
    found = intervals.sampled_windows(e, e.where("event_type = 'error'"), 600_000)
    mean = F.col("total") / F.nullif("n_values", F.lit(0))
    return found.select("event_id", "n", maths.rounded(mean, 6).alias("mean_power"), maths.rounded(F.col("peak"), 6).alias("peak_power"), maths.rounded(F.greatest(F.lit(0.0), (mean - 20) * 600), 4).alias("net_energy"))


@query("""SELECT event_type AS phase, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS longest,
round(sum(json_extract_string(props, '$.k')::DOUBLE) / sum(value), 6) AS rate, round(max(epoch(ts) + value) - min(epoch(ts)), 3) AS span FROM events GROUP BY event_type""")
def timing_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, totals, quantiles, rate and span of each phase."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    tokens = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.max("value").alias("longest"), F.round(F.sum(tokens) / F.sum("value"), 6).alias("rate"), F.round(F.max(at + F.col("value")) - F.min(at), 3).alias("span"))


@query("""WITH m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY event_type) SELECT event_id, event_type, value, round(value / mid, 6) AS ratio FROM events JOIN m USING (event_type) WHERE value > 3 * mid""")
def slow_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of over three times their phase's median."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    mid = e.groupBy("event_type").agg(F.median("value").alias("mid"))
    return e.join(mid, "event_type").where("value > 3 * mid").select("event_id", "event_type", "value", F.round(F.col("value") / F.col("mid"), 6).alias("ratio"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, n, max(value) FILTER (WHERE k = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(value) FILTER (WHERE k = round_even(0.95 * (n - 1), 0) + 1) AS p95 FROM r GROUP BY user_id, n""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of each user's values."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("k") == F.bround(q * (F.col("n") - 1)) + 1, F.col("value")))
    return r.groupBy("user_id", "n").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice) / CASE WHEN avg(l_tax) - avg(l_discount) > 0 THEN avg(l_tax) - avg(l_discount) END, 2) AS k FROM lineitem GROUP BY l_suppkey""")
def breakeven_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost over gain per item, null without a gain."""
    gain = F.avg("l_tax") - F.avg("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice") / F.when(gain > 0, gain), 2).alias("k"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL""")
def decode_ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line fitted per group."""
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("""WITH s AS (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem),
t AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x) AS a, sum(x*x) AS b, sum(x*x*x) AS c, sum(x*x*x*x) AS d, sum(y) AS p, sum(x*y) AS q, sum(x*x*y) AS r FROM s GROUP BY ALL),
u AS (SELECT *, n*(b*d - c*c) - a*(a*d - b*c) + b*(a*c - b*b) AS det FROM t),
f AS (SELECT *, (p*(b*d - c*c) - a*(q*d - c*r) + b*(q*c - b*r)) / det AS c0, (n*(q*d - r*c) - p*(a*d - b*c) + b*(a*r - b*q)) / det AS c1, (n*(b*r - c*q) - a*(a*r - b*q) + p*(a*c - b*b)) / det AS c2 FROM u)
SELECT l_returnflag, c2 < 0 AS refitted, round(CASE WHEN c2 < 0 THEN (p - (n*q - a*p) / (n*b - a*a) * a) / n ELSE c0 END, 5) AS k0, round(CASE WHEN c2 < 0 THEN (n*q - a*p) / (n*b - a*a) ELSE c1 END, 5) AS k1, round(CASE WHEN c2 < 0 THEN 0 ELSE c2 END, 5) AS k2 FROM f""")
def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parabola fitted per group from its moments; a line where it would bend down."""
    x, y = F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("a"), F.sum(x * x).alias("b"), F.sum(x * x * x).alias("c"), F.sum(x * x * x * x).alias("d"), F.sum(y).alias("p"), F.sum(x * y).alias("q"), F.sum(x * x * y).alias("r"))
    n, a, b, c, d, p, q, r = (F.col(z) for z in "nabcdpqr")
    f = t.withColumn("det", n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b))
    f = f.select("*", ((p * (b * d - c * c) - a * (q * d - c * r) + b * (q * c - b * r)) / F.col("det")).alias("c0"), ((n * (q * d - r * c) - p * (a * d - b * c) + b * (a * r - b * q)) / F.col("det")).alias("c1"), ((n * (b * r - c * q) - a * (a * r - b * q) + p * (a * c - b * b)) / F.col("det")).alias("c2"), ((n * q - a * p) / (n * b - a * a)).alias("slope"))
    line = F.col("c2") < 0
    return f.select("l_returnflag", line.alias("refitted"), F.round(F.when(line, (p - F.col("slope") * a) / n).otherwise(F.col("c0")), 5).alias("k0"), F.round(F.when(line, F.col("slope")).otherwise(F.col("c1")), 5).alias("k1"), F.round(F.when(line, 0.0).otherwise(F.col("c2")), 5).alias("k2"))


WORDS_SQL = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


def words(column: str = "text"):
    return F.size(F.array_remove(F.split(column, r"[ \t\n\r]+"), "")).cast("long")


@query(f"""WITH {MESSAGES_SQL}, w AS (SELECT *, {WORDS_SQL} AS n FROM m)
SELECT day, count(DISTINCT conv_id) AS n_sessions, count(*) AS n_turns, sum(n)::BIGINT AS n_words, sum(floor(n * 1.3))::BIGINT AS n_tokens, count(*) FILTER (WHERE n < 20) AS short, count(*) FILTER (WHERE n BETWEEN 20 AND 79) AS middle, count(*) FILTER (WHERE n >= 80) AS long FROM w GROUP BY day""")
def daily_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, turns, words and length classes of each day."""
    w = messages(spark, sf_dir).withColumn("n", words())
    n = F.col("n")
    return w.groupBy("day").agg(F.count_distinct("conv_id").alias("n_sessions"), F.count("*").alias("n_turns"), F.sum(n).alias("n_words"), F.sum(F.floor(n * 1.3)).alias("n_tokens"), F.count_if(n < 20).alias("short"), F.count_if(n.between(20, 79)).alias("middle"), F.count_if(n >= 80).alias("long"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, {WORDS_SQL} AS n, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true)::INT AS new, contains(text, '?') AS asks FROM conversations),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c), r AS (SELECT conv_id, run, role, count(*) AS m, sum(n) AS w, count(*) FILTER (WHERE asks) AS q FROM i GROUP BY ALL)
SELECT role, count(*) AS n_runs, sum(m)::BIGINT AS n_messages, round(sum(w) / sum(m), 6) AS words_per_message, round(sum(w) / count(*), 6) AS words_per_run, round(sum(m) / count(*), 6) AS messages_per_run, round(sum(q) / sum(m), 6) AS question_rate FROM r GROUP BY role""")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one speaker's messages: their lengths and how often they ask."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words().alias("n"), F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).cast("int").alias("new"), F.contains(F.col("text"), F.lit("?")).alias("asks"))
    r = c.withColumn("run", F.sum("new").over(w)).groupBy("conv_id", "run", "role").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.count_if("asks").alias("q"))
    return r.groupBy("role").agg(F.count("*").alias("n_runs"), F.sum("m").alias("n_messages"), F.round(F.sum("w") / F.sum("m"), 6).alias("words_per_message"), F.round(F.sum("w") / F.count("*"), 6).alias("words_per_run"), F.round(F.sum("m") / F.count("*"), 6).alias("messages_per_run"), F.round(F.sum("q") / F.sum("m"), 6).alias("question_rate"))


@query("""WITH w AS (SELECT lang, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')[1:12] AS w FROM documents),
b AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w) SELECT lang, count(*) AS n, count(DISTINCT b) AS n_distinct, round(count(DISTINCT b) / count(*), 6) AS distinct_2 FROM b GROUP BY lang""".replace("\\\\", "\\"))
def distinct_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of distinct word pairs in the first twelve words of documents."""
    w = table(spark, sf_dir, "documents").select("lang", F.slice(F.array_remove(F.split(F.lower("text"), r"[ \t\n\r]+"), ""), 1, 12).alias("w"))
    b = w.where(F.size("w") > 1).select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).alias("b"))
    return b.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("b").alias("n_distinct"), F.round(F.count_distinct("b") / F.count("*"), 6).alias("distinct_2"))


@query("""SELECT lang, sum(len(regexp_extract_all(text, '[^\\x00-\\x7F]')))::BIGINT AS non_ascii, sum(len(regexp_extract_all(text, '[\\p{Han}\\p{Hiragana}\\p{Katakana}]')))::BIGINT AS cjk, sum(len(regexp_extract_all(text, '\\p{Cyrillic}')))::BIGINT AS cyrillic,
sum(len(regexp_extract_all(text, '[\\x{C0}-\\x{24F}]')))::BIGINT AS latin FROM documents GROUP BY lang""".replace("\\\\", "\\"))
def script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of other scripts than ASCII per language."""
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n(r"[^\x00-\x7F]").alias("non_ascii"), n(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]").alias("cjk"), n(r"\p{IsCyrillic}").alias("cyrillic"), n(r"[\x{C0}-\x{24F}]").alias("latin"))


@query("""WITH i AS (SELECT 'documents' AS kind, unnest(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN n_chars < 20 THEN 'short' END, CASE WHEN regexp_matches(text, '(?i)password|token') THEN 'secret' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL)) AS rule FROM documents
UNION ALL SELECT 'conversations', unnest(list_filter([CASE WHEN length(text) > 800 THEN 'long' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL)) FROM conversations)
SELECT kind, rule, count(*) AS n FROM i GROUP BY ALL""")
def health_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by documents and turns, counted."""

    def broken(kind: str, df: DataFrame, **rules) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("rule"))

    t, n = F.col("text"), F.col("n_chars")
    d = broken("documents", table(spark, sf_dir, "documents"), empty=F.length(F.trim(t)) == 0, short=n < 20, secret=t.rlike("(?i)password|token"), length=n != F.length(t))
    c = broken("conversations", table(spark, sf_dir, "conversations"), long=F.length(t) > 800, role=~F.col("role").isin("user", "assistant"), lines=F.contains(t, F.lit("\n")))
    return d.unionByName(c).groupBy("kind", "rule").agg(F.count("*").alias("n"))
