"""Picks, draws, memory merges and scopes: small selections over activity, turns and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions import text as tx
from quern.operators import graph
from quern.plans.groundtruth import edges
from quern.plans.registry import query
from quern.sources.tables import EDGES_SQL, MESSAGES_SQL, messages, table



def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in words) + "]"


def unit_hash(*parts: Column) -> Column:
    """A number from [0, 1) that depends on the parts alone: 32 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *[x.cast("string") for x in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def content_words(text: Column) -> Column:
    """Distinct lower-case words of three characters or more that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(*fixed.CONTENT_STOP_WORDS)))


@query("""SELECT user_id, count(*) FILTER (WHERE value > 10) AS n_positive, count(*) AS n, count(*) FILTER (WHERE value > 10) >= count(*) // 2 + 1 AS verdict FROM events GROUP BY user_id""")
def boolean_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether over half of a user's votes are positive."""
    yes, n = F.count_if(F.col("value") > 10), F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(yes.alias("n_positive"), n.alias("n"), (yes >= F.floor(n / 2) + 1).alias("verdict"))


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT ego, conv_id, min(sim_day) AS start FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY start, conv_id) - 1 AS k, count(*) OVER (PARTITION BY ego) AS n FROM s)
SELECT ego, conv_id, k = 0 AS is_first, k = n // 2 AS is_middle, k = n - 1 AS is_last FROM r WHERE k IN (0, n // 2, n - 1)""")
def first_middle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, middle and last session of each owner."""
    s = messages(spark, sf_dir).groupBy("ego", "conv_id").agg(F.min("sim_day").alias("start"))
    w = Window.partitionBy("ego")
    r = s.select("ego", "conv_id", (F.row_number().over(w.orderBy("start", "conv_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    found = r.select("ego", "conv_id", (F.col("k") == 0).alias("is_first"), (F.col("k") == F.floor(F.col("n") / 2)).alias("is_middle"), (F.col("k") == F.col("n") - 1).alias("is_last"))
    return found.where("is_first OR is_middle OR is_last")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, count(*) AS n_kept, min(event_id) AS least FROM r WHERE k <= greatest(1, n * 3 // 10) GROUP BY user_id""")
def tail_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30% of each user's events, one at least."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"), F.count("*").over(w).alias("n"))
    return r.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 3 / 10))).groupBy("user_id").agg(F.count("*").alias("n_kept"), F.min("event_id").alias("least"))


@query("""WITH r AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS upto FROM conversations)
SELECT conv_id, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS shown FROM r WHERE upto <= 1500 GROUP BY conv_id""")
def prefix_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading turns of each session that fit 1500 characters, a separator between two counting as one."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.sum(F.length("text") + 1).over(w) - 1).alias("upto")).where("upto <= 1500")
    return r.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("shown"))


@query("""SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY event_type""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greater of the two middle values; as an aggregate, since it is the negated lower median of negated values."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg((-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -value)")).alias("upper_median"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({_listed(fixed.CONTENT_STOP_WORDS)}, x))) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w)
SELECT conv_id, turn, len(list_intersect(w, before))::INTEGER AS n_shared, round(len(list_intersect(w, before)) / nullif(len(before), 0), 6) AS overlap FROM p WHERE before IS NOT NULL""")
def content_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a turn's content words the next one takes up."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", content_words(F.col("text")).alias("w"))
    p = w.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    n = F.size(F.array_intersect("w", "before"))
    return p.select("conv_id", "turn", n.alias("n_shared"), F.round(F.try_divide(n, F.size("before")), 6).alias("overlap"))


@query(f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]+'), lambda x: length(x) > 3 AND NOT list_contains({_listed(fixed.HINT_STOP_WORDS)}, x)) AS w FROM benchmark),
d AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM w) SELECT item_id, array_to_string(d[1:4], ' ') AS hint FROM d""")
def hint_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four distinct words of a question that are long and no stop words."""
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]+"), F.lit(0)), lambda x: (F.length(x) > 3) & ~x.isin(*fixed.HINT_STOP_WORDS))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(found), 1, 4), " ").alias("hint"))


@query("""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS said, trim(regexp_replace(lower(string_split(p_name, ' ')[1]), '[^a-z0-9]+', ' ', 'g')) AS option FROM part)
SELECT p_partkey, CASE WHEN option = '' THEN 'none' WHEN said = option THEN 'equal' WHEN contains(' ' || said || ' ', ' ' || option || ' ') THEN 'inside' WHEN NOT contains(said, ' ') AND starts_with(option, said) THEN 'prefix' ELSE 'none' END AS match FROM n""")
def choice_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an answer names an option: as a whole, as words inside it, or as one word that the option starts with."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    n = table(spark, sf_dir, "part").select("p_partkey", plain(F.col("p_type")).alias("said"), plain(F.split("p_name", " ")[0]).alias("option"))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    said, option = F.col("said"), F.col("option")
    match = F.when(option == "", "none").when(said == option, "equal").when(F.contains(padded(said), padded(option)), "inside").when(~F.contains(said, F.lit(" ")) & F.startswith(option, said), "prefix").otherwise("none")
    return n.select("p_partkey", match.alias("match"))


@query("""WITH e AS (SELECT conv_id, turn, text, nullif(regexp_extract(text, '[A-Z][a-z]+'), '') AS entity, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM conversations),
k AS (SELECT *, list_filter(s, lambda x: contains(lower(x), lower(entity))) AS k FROM e WHERE entity IS NOT NULL) SELECT conv_id, turn, entity, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS said FROM k""".replace("\\\\", "\\"))
def entity_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a turn that name its first capitalised word; the whole turn if none does."""
    entity = F.nullif(F.regexp_extract("text", "[A-Z][a-z]+", 0), F.lit(""))
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", entity.alias("entity"), F.split(F.regexp_replace("text", r"([.!?])[ \t\n\r]+", "$1\x01"), "\x01", -1).alias("s")).where("entity IS NOT NULL")
    k = F.filter("s", lambda x: F.contains(F.lower(x), F.lower("entity")))
    return e.select("conv_id", "turn", "entity", F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(F.col("text")).alias("said"))


@query("""WITH u AS (SELECT event_id, ('0x' || substr(md5('template:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS t, ('0x' || substr(md5('modality:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS m FROM events)
SELECT event_id, floor(t * 7)::INTEGER AS template, CASE WHEN m < 0.5 THEN 'in_person' WHEN m < 0.8 THEN 'text' WHEN m < 0.95 THEN 'call' ELSE 'video' END AS modality FROM u""")
def hashed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of seven templates and a weighted way of talking for each event, drawn by hashes, so that reruns agree."""
    t, m = unit_hash(F.lit("template"), F.col("event_id")), unit_hash(F.lit("modality"), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.floor(t * 7).cast("int").alias("template"), F.when(m < 0.5, "in_person").when(m < 0.8, "text").when(m < 0.95, "call").otherwise("video").alias("modality"))


@query(f"""WITH {EDGES_SQL}, w AS (SELECT source, target, least(1, n / 3.0::DOUBLE) AS w FROM g), f AS (SELECT *, CASE WHEN w >= 0.8 THEN 3.0 WHEN w >= 0.5 THEN 2.0 WHEN w >= 0.3 THEN 1.5 ELSE 1.0 END::DOUBLE AS factor FROM w)
SELECT source, target, factor, round(least(1, 0.1 * (1 + source % 3) * factor + CASE WHEN source % 5 = target % 5 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS chance FROM f""")
def encounter_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that two acquaintances meet: a base by place, more for familiar ones and for those who share a group."""
    w = edges(spark, sf_dir).select("source", "target", F.least(F.lit(1.0), F.col("weight")).alias("w"))
    factor = F.when(F.col("w") >= 0.8, 3.0).when(F.col("w") >= 0.5, 2.0).when(F.col("w") >= 0.3, 1.5).otherwise(1.0)
    chance = 0.1 * (1 + F.col("source") % 3) * F.col("factor") + F.when(F.col("source") % 5 == F.col("target") % 5, 0.3).otherwise(0.0)
    return w.withColumn("factor", factor).select("source", "target", "factor", F.round(F.least(F.lit(1.0), chance), 6).alias("chance"))


@query(f"""WITH {EDGES_SQL}, s AS (SELECT * FROM g WHERE n >= 2), d AS (SELECT source AS a, target AS b FROM s UNION ALL SELECT target, source FROM s),
t AS (SELECT a, b FROM d UNION SELECT x.a, y.b FROM d x JOIN d y ON x.b = y.a UNION SELECT a, a FROM d), c AS (SELECT a, count(*) AS n FROM t GROUP BY a)
SELECT event_id, ['global', 'private', 'dyadic', 'community'][event_id % 4 + 1] AS scope, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE coalesce(n, 1) END::BIGINT AS n_viewers FROM events LEFT JOIN c ON c.a = user_id % 200""")
def visibility_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 200 agents see an event: all, its agent, a pair, or the agent's community of two steps."""
    c = graph.two_hops(edges(spark, sf_dir).where("n >= 2")).groupBy("a").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 200).alias("a"), (F.col("event_id") % 4).alias("k"))
    scope = F.element_at(F.array(*map(F.lit, ("global", "private", "dyadic", "community"))), (F.col("k") + 1).cast("int"))
    n = F.when(F.col("k") == 0, 200).when(F.col("k") == 1, 1).when(F.col("k") == 2, 2).otherwise(F.coalesce("n", F.lit(1)))
    return e.join(c, "a", "left").select("event_id", scope.alias("scope"), n.cast("long").alias("n_viewers"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey))
SELECT c_custkey, c_nationkey || '_' || lower(c_mktsegment) AS team, CASE k WHEN 1 THEN 'organiser' WHEN 2 THEN 'deputy' ELSE 'member' END AS role FROM r WHERE n >= 2""")
def interest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more who share a place and an interest, with roles by position."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    r = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("_", F.col("c_nationkey").cast("string"), F.lower("c_mktsegment")).alias("team"), F.row_number().over(w.orderBy("c_custkey")).alias("k"), F.count("*").over(w).alias("n"))
    return r.where("n >= 2").select("c_custkey", "team", F.when(F.col("k") == 1, "organiser").when(F.col("k") == 2, "deputy").otherwise("member").alias("role"))


@query("""WITH p AS (SELECT l_partkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(a - (n + r) / 2, 6) AS contrast FROM p WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL""")
def contrast_of_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arm against the mean of the two others, for items that all three have."""
    arm = lambda x: F.avg(F.when(F.col("l_returnflag") == x, F.col("l_quantity"))).alias(x.lower())
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(arm("A"), arm("N"), arm("R")).where("a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
    return p.select("l_partkey", F.round(F.col("a") - (F.col("n") + F.col("r")) / 2, 6).alias("contrast"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events WHERE event_type IN ('purchase', 'click')),
h AS (SELECT * FROM r WHERE k <= CASE event_type WHEN 'purchase' THEN 6 ELSE 3 END) SELECT user_id, event_id, event_type FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 6""")
def merged_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six best facts and three best feelings of each user, the first six of both in time order."""
    best = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')").withColumn("k", F.row_number().over(best))
    held = r.where(F.col("k") <= F.when(F.col("event_type") == "purchase", 6).otherwise(3))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("place <= 6").select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT user_id, event_type, ts::DATE AS day, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY ALL)
SELECT user_id, day, event_type, latest FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, latest DESC) <= 5""")
def daily_bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five last bulletins: the latest event of a kind and day."""
    l = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"), F.desc("latest")))
    return l.withColumn("place", place).where("place <= 5").select("user_id", "day", "event_type", "latest")


@query("""WITH h AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '9-5 Mon-Fri' WHEN 1 THEN '22:30-6' WHEN 2 THEN '8:15 - 16:45 weekdays' ELSE 'flexible' END AS said FROM supplier),
p AS (SELECT *, regexp_extract_all(said, '([0-9]{1,2})(?::([0-9]{2}))? *- *([0-9]{1,2})(?::([0-9]{2}))?', 1)[1]::INT AS a, coalesce(nullif(regexp_extract(said, '([0-9]{1,2})(?::([0-9]{2}))? *- *([0-9]{1,2})(?::([0-9]{2}))?', 2), ''), '0')::INT AS am,
  nullif(regexp_extract(said, '([0-9]{1,2})(?::([0-9]{2}))? *- *([0-9]{1,2})(?::([0-9]{2}))?', 3), '')::INT AS b, coalesce(nullif(regexp_extract(said, '([0-9]{1,2})(?::([0-9]{2}))? *- *([0-9]{1,2})(?::([0-9]{2}))?', 4), ''), '0')::INT AS bm FROM h)
SELECT s_suppkey, coalesce(a + am / 60, 9)::DOUBLE AS start, coalesce(CASE WHEN b <= a AND a <= 12 THEN b + 12 ELSE b END + bm / 60, 17)::DOUBLE AS stop, regexp_matches(lower(said), 'mon-fri|weekday') AS weekdays_only FROM p""")
def working_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours read from work schedules: a morning start makes a smaller end one of the afternoon; 9 to 17 if none are named."""
    k = F.col("s_suppkey") % 4
    said = F.when(k == 0, "9-5 Mon-Fri").when(k == 1, "22:30-6").when(k == 2, "8:15 - 16:45 weekdays").otherwise("flexible")
    part = lambda i: F.nullif(F.regexp_extract("said", "([0-9]{1,2})(?::([0-9]{2}))? *- *([0-9]{1,2})(?::([0-9]{2}))?", i), F.lit("")).cast("int")
    a, b = part(1), part(3)
    hour = lambda h, m: h + F.coalesce(m, F.lit(0)) / 60
    later = F.when((b <= a) & (a <= 12), b + 12).otherwise(b)
    h = table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("said"))
    return h.select("s_suppkey", F.coalesce(hour(a, part(2)), F.lit(9.0)).alias("start"), F.coalesce(hour(later, part(4)), F.lit(17.0)).alias("stop"), F.lower("said").rlike("mon-fri|weekday").alias("weekdays_only"))


@query("""SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(median(l_discount), 6) AS median, round(stddev_pop(l_discount), 6) AS sd FROM lineitem GROUP BY l_returnflag""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean, median and population deviation of scores."""
    weighted = F.try_divide(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(weighted, 6).alias("weighted"), F.round(F.median("l_discount"), 6).alias("median"), F.round(F.stddev_pop("l_discount"), 6).alias("sd"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('Answer: ' || '"' || text || '"', '^(?i:answer|response|reply) *: *', ''), '^"(.*)"$', '\\1', 's'), '[ \\t\\n\\r]+', ' ', 'g')) AS cleaned FROM conversations""".replace("\\\\", "\\"))
def label_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a leading label and without quotes around them."""
    said = F.concat(F.lit('Answer: "'), "text", F.lit('"'))
    bare = F.regexp_replace(F.regexp_replace(tx.without_thinking(said), "^(?i:answer|response|reply) *: *", ""), '(?s)^"(.*)"$', "$1")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("cleaned"))
