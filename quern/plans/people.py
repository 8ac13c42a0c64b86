"""Agents and sessions: indexes, contacts, inferred owners and askers, disclosure by attendance, schedules, pools and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import maths
from quern.operators import graph
from quern.plans.registry import query
from quern.sources.tables import EDGES_SQL, MESSAGES_SQL, QUESTIONS_SQL, messages, questions, social_edges, table


@query("""SELECT c_custkey AS agent, row_number() OVER (ORDER BY c_custkey) - 1 AS line FROM customer""")
def agent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's number, from 0, by its place in the agents' list: ranges are counted for themselves and their starts summed up."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.floor(F.col("c_custkey") / 4096).alias("range"))
    starts = c.groupBy("range").agg(F.count("*").alias("n"))
    starts = starts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("agent"))
    return c.withColumn("inside", inside).join(starts, "range").select("agent", (F.col("before") + F.col("inside") - 1).alias("line"))


LAYERS = [0.9, 0.6, 0.35, 0.15]


def contacts(edges: DataFrame) -> DataFrame:
    """owner, contacts (array of other, label by other) from edges (source, target, weight), both ways: close friends, friends and
    acquaintances by the layer of nearest weight; others are no contacts."""
    d = graph.both_ways(edges).select(F.col("a").alias("owner"), F.col("b").alias("other"), graph.nearest_layer(F.col("weight"), LAYERS).alias("layer"))
    label = F.when(F.col("layer") == 1, "close friend").when(F.col("layer") == 2, "friend").when(F.col("layer") == 3, "acquaintance")
    return d.where("layer <= 3").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("other", label.alias("label")))).alias("contacts"))


CONTACTS_SQL = f"""{EDGES_SQL}, w AS (SELECT source, target, n / 3.0::DOUBLE AS w FROM g), d AS (SELECT source AS owner, target AS other, w FROM w UNION ALL SELECT target, source, w FROM w),
l AS (SELECT owner, other, [abs(w - 0.9), abs(w - 0.6), abs(w - 0.35), abs(w - 0.15)] AS gaps FROM d), y AS (SELECT owner, other, list_position(gaps, list_min(gaps)) AS layer FROM l),
c AS (SELECT owner, string_agg(other || ':' || CASE layer WHEN 1 THEN 'close friend' WHEN 2 THEN 'friend' ELSE 'acquaintance' END, ' ' ORDER BY other) AS contacts, count(*) AS n FROM y WHERE layer <= 3 GROUP BY owner)"""


@query(f"WITH {CONTACTS_SQL} SELECT doc_id, CASE WHEN toxic = 1 THEN c.contacts END AS contacts, CASE WHEN toxic = 1 THEN coalesce(c.n, 0) ELSE 0 END AS n_contacts FROM labels LEFT JOIN c ON c.owner = doc_id % 200")
def owner_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission items with their owner's labelled contacts; other items have none."""
    c = contacts(social_edges(spark, sf_dir).withColumn("weight", F.col("n") / 3.0))
    items = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.col("doc_id") % 200).alias("owner"))
    shown = F.array_join(F.transform("contacts", lambda x: F.concat_ws(":", x["other"].cast("string"), x["label"])), " ")
    return items.join(c, "owner", "left").select("doc_id", shown.alias("contacts"), F.coalesce(F.size("contacts"), F.lit(0)).cast("long").alias("n_contacts"))


def named(*candidates: Column) -> Column:
    """The first candidate that names somebody other than the assistant; empty if none does."""
    clean = [F.nullif(F.trim(x), F.lit("")) for x in candidates]
    return F.coalesce(*[F.when(~x.isin("__assistant__", "assistant"), x) for x in clean], F.lit(""))


def question_feature(dimension: Column, own: Column, sensitive: Column, known: Column, anonymous: Column, attribute: Column, scoped: Column, temporal: Column, kind: Column) -> Column:
    """The fine-grained tag of a question, by its dimension and the flags of its ground truth."""
    permission = F.when(F.coalesce(own, F.lit("")) != "", own).when(sensitive, "autonomous_privacy").when(known, "known_requester").when(anonymous, "anonymous_querier").otherwise("permission_compliance")
    recall = F.when(scoped, "perspective_recall").when(temporal, "temporal_recall").otherwise("factual_recall")
    order = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("temporal_"), kind)).otherwise("temporal_reasoning")
    metadata = F.when(attribute.isin("location", "location_id"), "location_recall").when(attribute == "speaker", "speaker_recall").otherwise("metadata_recall")
    return F.when(dimension == "d4_permission", permission).when(dimension == "d6_metadata", metadata).when(dimension == "d7_qa", recall).when(dimension == "d8_temporal", order).otherwise("unknown")


#: First sessions of every owner, and the participants of each session, for lookups.
ASK_SQL = f"""{MESSAGES_SQL}, {QUESTIONS_SQL}, p AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS who, min(ego) AS ego FROM m GROUP BY conv_id)"""


@query(f"""WITH {ASK_SQL}, x AS (SELECT q.question_id, CASE WHEN question_id % 5 = 0 THEN 'assistant' WHEN question_id % 5 = 1 THEN ' ' ELSE NULL END AS a, CASE WHEN question_id % 3 = 0 THEN 'ego_' || q.ego END AS b, CASE WHEN question_id % 2 = 0 THEN 'target_' || q.ego END AS c, p.who FROM q LEFT JOIN p ON p.conv_id = q.excluded),
e AS (SELECT *, coalesce(b, c, '') AS ego FROM x)
SELECT question_id, ego, coalesce(CASE WHEN question_id % 7 = 0 THEN 'given' END, CASE WHEN question_id % 4 = 1 THEN coalesce(list_filter(who, lambda z: z <> 'user')[1], 'user') END, who[1], 'user') AS asker,
CASE question_id % 5 WHEN 0 THEN CASE WHEN question_id % 2 = 0 THEN 'autonomous_privacy' WHEN question_id % 3 = 0 THEN 'known_requester' ELSE 'permission_compliance' END WHEN 1 THEN CASE WHEN question_id % 2 = 0 THEN 'location_recall' ELSE 'metadata_recall' END WHEN 2 THEN CASE WHEN question_id % 3 = 0 THEN 'temporal_recall' ELSE 'factual_recall' END
  WHEN 3 THEN CASE WHEN question_id % 2 = 0 THEN 'temporal_order' ELSE 'temporal_reasoning' END ELSE 'unknown' END AS feature FROM e""")
def inferred_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose memory a question tests, who asks it, and its feature tag, each from the first field that tells."""
    who = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("excluded")).agg(F.array_sort(F.collect_set("role")).alias("who"))
    q, k = questions(spark, sf_dir).select("question_id", "ego", "excluded").join(who, "excluded", "left"), F.col("question_id")
    none = F.lit(None).cast("string")
    ego = named(F.when(k % 5 == 0, "assistant").when(k % 5 == 1, " "), F.when(k % 3 == 0, F.concat(F.lit("ego_"), "ego")), F.when(k % 2 == 0, F.concat(F.lit("target_"), "ego")))
    target = F.when(k % 4 == 1, F.coalesce(F.get(F.filter("who", lambda z: z != "user"), F.lit(0)), F.lit("user")))  # someone of the source session but the target
    asker = F.coalesce(F.when(k % 7 == 0, "given"), target, F.get("who", F.lit(0)), F.lit("user"))
    dimension = F.when(k % 5 == 0, "d4_permission").when(k % 5 == 1, "d6_metadata").when(k % 5 == 2, "d7_qa").when(k % 5 == 3, "d8_temporal").otherwise("d1_conflict")
    tag = question_feature(dimension, none, k % 2 == 0, k % 3 == 0, F.lit(False), F.when(k % 2 == 0, "location"), F.lit(False), k % 3 == 0, F.when(k % 2 == 0, "order"))
    return q.select("question_id", ego.alias("ego"), asker.alias("asker"), tag.alias("feature"))


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT conv_id, conv_id % 40 AS a, (conv_id * 3 + 1) % 40 AS b FROM m GROUP BY ALL), t AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM s), k AS (SELECT conv_id, conv_id % 40 AS x, (conv_id * 7) % 40 AS y FROM m GROUP BY ALL)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'friends_only' END AS level, CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE t.a IS NOT NULL END AS disclose FROM k LEFT JOIN t ON t.a = least(x, y) AND t.b = greatest(x, y)""")
def disclosure_by_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fact may be told: public always, private never, to friends if the two attended a session together."""
    c, k = messages(spark, sf_dir).select("conv_id").distinct(), F.col("conv_id")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    together = c.select(*pair(k % 40, (k * 3 + 1) % 40)).distinct().withColumn("met", F.lit(True))
    asked = c.select("conv_id", *pair(k % 40, (k * 7) % 40)).join(together, ["a", "b"], "left")
    level = F.when(k % 3 == 0, "public").when(k % 3 == 1, "private").otherwise("friends_only")
    return asked.select("conv_id", level.alias("level"), F.when(level == "friends_only", F.coalesce("met", F.lit(False))).otherwise(level == "public").alias("disclose"))


@query(f"""WITH {MESSAGES_SQL} SELECT m.msg_id, CASE WHEN m.conv_id % 4 = 0 THEN '' WHEN m.conv_id % 4 = 1 THEN 'home' ELSE coalesce(e.event_type, 'home') END AS place, m.role <> 'system' AND len(list_filter(string_split_regex(m.text, '\\s+'), lambda x: x <> '')) >= 8 AND m.conv_id % 3 <> 0 AS may_conflict
FROM m LEFT JOIN events e ON e.event_id = m.conv_id * 3""")
def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a session's trigger (none if it is remote), and turns of eight words or more that a conflict can be put in."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") / 3).alias("third"), "event_type")
    m, k = messages(spark, sf_dir), F.col("conv_id")
    place = F.when(k % 4 == 0, "").when(k % 4 == 1, "home").otherwise(F.coalesce("event_type", F.lit("home")))
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return m.join(e, k == F.col("third"), "left").select("msg_id", place.alias("place"), ((F.col("role") != "system") & (words >= 8) & (k % 3 != 0)).alias("may_conflict"))


def familiarity(one: Column, other: Column) -> Column:
    """How well two agents know each other, by the greater of their weights; strangers without one."""
    w = F.greatest(F.coalesce(one, F.lit(0.0)), F.coalesce(other, F.lit(0.0)))
    return F.when(w <= 0, 0.3).otherwise(maths.tier(w, (0.8, 0.5, 0.3), (1.5, 1.2, 1.0, 0.8)))


def graph_meetings(edges: DataFrame, days: int, wanted: int, most: int) -> DataFrame:
    """day, place, source, target: edges by weight (1.3 times within a group) in descending order, dealt over the days in
    turn, so many a day as make `wanted`, `most` at the most; started again where they run out."""
    ranked = edges.withColumn("score", F.round(F.col("weight") * F.when(F.col("same_group"), 1.3).otherwise(1.0), 6))
    best = ranked.orderBy(F.desc("score"), "source", "target").limit(wanted)  # no more than `wanted` are ever met
    order = F.row_number().over(Window.orderBy(F.desc("score"), "source", "target")) - 1
    best = best.withColumn("place", order)
    n = best.agg(F.count("*").alias("n"))
    daily = max(1, min(wanted // days, most))
    slots = edges.sparkSession.range(min(wanted, days * daily)).withColumnRenamed("id", "slot").crossJoin(n).where("n > 0")  # one row is joined
    slots = slots.select("slot", F.floor(F.col("slot") / daily).alias("day"), (F.col("slot") % F.col("n")).alias("place"))
    return slots.join(best, "place").select("slot", "day", "source", "target", "score")


@query(f"""WITH {EDGES_SQL}, r AS (SELECT source, target, round(n / 3.0::DOUBLE * CASE WHEN source % 5 = target % 5 THEN 1.3 ELSE 1.0 END, 6) AS score FROM g), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, target) - 1 AS place FROM r QUALIFY place < 60)
SELECT s.range AS slot, s.range // 4 AS day, source, target, score FROM range(60) s JOIN k ON k.place = s.range % (SELECT count(*) FROM k)""")
def graph_ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty meetings of linked agents over fifteen days, the strongest links first."""
    e = social_edges(spark, sf_dir).select("source", "target", (F.col("n") / 3.0).alias("weight"), (F.col("source") % 5 == F.col("target") % 5).alias("same_group"))
    return graph_meetings(e, 15, 60, 6)


@query(f"""WITH {EDGES_SQL}, w AS (SELECT source, target, n / 3.0::DOUBLE AS w FROM g) SELECT source, target, CASE WHEN greatest(w, w / 2) <= 0 THEN 0.3 WHEN w >= 0.8 THEN 1.5 WHEN w >= 0.5 THEN 1.2 WHEN w >= 0.3 THEN 1.0 ELSE 0.8 END::DOUBLE AS familiarity FROM w""")
def familiarity_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The familiarity of linked agents, by the greater weight of the two directions."""
    w = F.col("n") / 3.0
    return social_edges(spark, sf_dir).select("source", "target", familiarity(w, w / 2).cast("double").alias("familiarity"))


@query("""WITH a AS (SELECT c_custkey, 18 + c_custkey % 70 AS age, c_mktsegment AS occupation, c_custkey % 4 = 0 AS codes FROM customer), s AS (SELECT *, 0.9::DOUBLE - (least(80, age) - 18) * (0.7::DOUBLE / 62) + CASE WHEN contains(lower(occupation), 'machinery') THEN 0.15 ELSE 0 END - CASE WHEN contains(lower(occupation), 'furniture') THEN 0.1 ELSE 0 END + CASE WHEN codes THEN 0.1 ELSE 0 END AS score FROM a)
SELECT c_custkey, round(greatest(0.05, least(1, score)), 4) AS affinity, occupation AS acquaintance_knows, NULL::VARCHAR AS stranger_knows, age AS close_knows FROM s""")
def public_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical affinity by age, occupation and hobbies, and what the tiers of acquaintance know of a person."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (18 + k % 70).alias("age"), F.col("c_mktsegment").alias("occupation"), F.when(k % 4 == 0, "coding").otherwise("chess").alias("hobby"), F.col("c_name").alias("name"))
    tiers = public_tiers(F.col("name"), F.col("age"), F.col("occupation"))
    return p.select("c_custkey", F.round(technical_affinity(F.col("age"), F.col("occupation"), F.col("hobby"), ["machinery"], ["furniture"], ["coding"]), 4).alias("affinity"), tiers.alias("t")).select("c_custkey", "affinity", F.col("t.acquaintance.occupation").alias("acquaintance_knows"), F.col("t.stranger.occupation").alias("stranger_knows"), F.col("t.close.age").alias("close_knows"))


def technical_affinity(age: Column, occupation: Column, hobbies: Column, technical: list[str], manual: list[str], playful: list[str]) -> Column:
    """From 0.9 at 18 down to 0.2 at 80, more for technical work and hobbies, less for manual work, from 0.05 to 1."""
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)).cast("int")
    score = 0.9 - (F.least(F.lit(80), F.greatest(F.lit(18), age)) - 18) * (0.7 / 62) + 0.15 * has(occupation, technical) - 0.1 * has(occupation, manual) + 0.1 * has(hobbies, playful)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), score))


def public_tiers(name: Column, age: Column, occupation: Column) -> Column:
    """What each tier knows: strangers the name, acquaintances the occupation too, close people the age as well."""
    known = lambda a, o: F.struct(name.alias("name"), (age if a else F.lit(None).cast("bigint")).alias("age"), (occupation if o else F.lit(None).cast("string")).alias("occupation"))
    return F.struct(known(True, True).alias("close"), known(False, True).alias("active"), known(False, True).alias("acquaintance"), known(False, False).alias("stranger"))


@query("""WITH h AS (SELECT n_nationkey AS hint, lower(substr(n_name, 1, 4)) AS said FROM nation), e AS (SELECT s_suppkey AS fact, lower(n_name) AS entity, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT h.hint, e.fact, row_number() OVER (PARTITION BY h.hint ORDER BY s_acctbal DESC, fact) AS rank FROM h JOIN e ON contains(e.entity, h.said) OR contains(h.said, e.entity) QUALIFY rank <= 8""")
def entity_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight latest facts of entities whose name holds a hint, or is held by it: hints meet the distinct names, a
    catalogue, and the names that match meet their facts in an equi-join."""
    n = table(spark, sf_dir, "nation")
    names_ = n.agg(F.collect_set(F.lower("n_name")).alias("every"))  # one row
    hints = n.select(F.col("n_nationkey").alias("hint"), F.lower(F.substring("n_name", 1, 4)).alias("said")).crossJoin(names_)
    met = hints.select("hint", F.explode(F.filter("every", lambda x: F.contains(x, F.col("said")) | F.contains(F.col("said"), x))).alias("entity"))
    facts = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("fact"), F.lower("n_name").alias("entity"), "s_acctbal")
    rank = F.row_number().over(Window.partitionBy("hint").orderBy(F.desc("s_acctbal"), "fact"))
    return met.join(facts, "entity").withColumn("rank", rank).where("rank <= 8").select("hint", "fact", F.col("rank").cast("long").alias("rank"))


@query("""WITH d AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 16)) AS a, list_sort(list(DISTINCT (o_orderkey * 5) % 16)) AS b FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, list_concat(list_concat(list_sort(list_intersect(a, b)), list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: NOT list_contains(list_intersect(a, b), x)))), list_filter(range(16), lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x))) AS s FROM d)
SELECT o_custkey, array_to_string(s[1:3], ' ') AS domains FROM s""")
def domain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three domains for two agents: shared ones first, then those of one of them, then any other."""
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 16).alias("a"), F.collect_set((F.col("o_orderkey") * 5) % 16).alias("b"))
    both, every = F.array_sort(F.array_intersect("a", "b")), F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))
    rest = F.array_sort(F.array_except(F.array_union("a", "b"), both))
    s = F.concat(both, rest, F.array_except(every, F.array_union("a", "b")))
    return d.select("o_custkey", F.array_join(F.slice(s, 1, 3), " ").alias("domains"))


@query(f"WITH {MESSAGES_SQL}, {QUESTIONS_SQL} SELECT day::BIGINT AS day FROM m UNION SELECT cutoff_day + 7 FROM q")
def day_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that sessions or questions fall on, each once."""
    return messages(spark, sf_dir).select("day").union(questions(spark, sf_dir).select(F.col("cutoff_day") + 7)).distinct()


@query(f"""WITH {MESSAGES_SQL}, {QUESTIONS_SQL}, s AS (SELECT DISTINCT conv_id, ego FROM m), f AS (SELECT q.question_id, s.conv_id, row_number() OVER (PARTITION BY q.question_id ORDER BY md5(q.question_id || ':' || s.conv_id), s.conv_id) AS k FROM q JOIN s ON s.ego <> q.ego AND s.conv_id <> q.excluded)
SELECT question_id, conv_id FROM f WHERE k <= 5""")
def foreign_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sessions for every question that are neither its owner's nor its evidence, in the order of a hash.

    Owners are few, so each owner's foreign sessions come from the distinct owners. Hashes are counted by their first two digits, and
    only sessions up to the digits at which a question has five are sorted."""
    s = messages(spark, sf_dir).select("conv_id", "ego").distinct()
    q = questions(spark, sf_dir).select("question_id", F.col("ego").alias("own"), "excluded")
    owners = s.select("ego").distinct().agg(F.collect_set("ego").alias("egos"))  # one row

    def foreign(q: DataFrame) -> DataFrame:
        wanted = q.crossJoin(owners).withColumn("ego", F.explode(F.filter("egos", lambda x: x != F.col("own"))))
        f = wanted.join(s, "ego").where("conv_id <> excluded").withColumn("order", F.md5(F.concat_ws(":", "question_id", "conv_id")))
        return f.withColumn("head", F.substring("order", 1, 2))

    counts = foreign(q).groupBy("question_id", "head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("question_id").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where("before < 5").groupBy("question_id").agg(F.max("head").alias("last"))
    k = F.row_number().over(Window.partitionBy("question_id").orderBy("order", "conv_id"))
    return foreign(q.join(last, "question_id")).where("head <= last").withColumn("k", k).where("k <= 5").select("question_id", "conv_id")


def independent_batches(pairs: DataFrame, by: str) -> DataFrame:
    """by, a, b, batch: pairs of each group coloured greedily, those that share most members with others first (then by a,
    b), so that no member meets itself in a batch. A group is one step's pairs and is coloured in one task."""

    def coloured(rows: pd.DataFrame) -> pd.DataFrame:
        counts = pd.concat([rows["a"], rows["b"]]).value_counts()
        rows = rows.assign(degree=rows["a"].map(counts) + rows["b"].map(counts)).sort_values(["degree", "a", "b"], ascending=[False, True, True])
        taken: dict[int, set[int]] = {}
        out = []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            used = taken.setdefault(a, set()) | taken.setdefault(b, set())
            c = next(i for i in range(len(used) + 1) if i not in used)
            taken[a].add(c)
            taken[b].add(c)
            out.append(c)
        return rows.assign(batch=out)[[by, "a", "b", "batch"]]

    return pairs.groupBy(by).applyInPandas(coloured, f"{by} long, a long, b long, batch long")


@query()
def conversation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's pairs in batches in which nobody talks twice."""
    o = table(spark, sf_dir, "orders").select((F.unix_date(F.to_date("o_orderdate"))).cast("long").alias("day"), (F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50 + 50).alias("b")).distinct()
    return independent_batches(o, "day")


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT ego, count(*) AS n_turns, sum(length(text) // 4)::BIGINT AS tokens FROM m GROUP BY ego) SELECT ego, tokens, row_number() OVER (ORDER BY tokens DESC, ego) AS from_top, row_number() OVER (ORDER BY tokens, ego) AS from_bottom FROM s QUALIFY from_top <= 3 OR from_bottom <= 3""")
def top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three agents of most and of fewest estimated tokens."""
    s = messages(spark, sf_dir).groupBy("ego").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
    place = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long")
    return s.select("ego", "tokens", place(F.desc("tokens"), F.asc("ego")).alias("from_top"), place("tokens", "ego").alias("from_bottom")).where("from_top <= 3 OR from_bottom <= 3")


@query("""SELECT 'events' AS what, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'segments', c_mktsegment, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'roles', role, count(*) FROM conversations GROUP BY ALL UNION ALL SELECT 'langs', lang, count(*) FROM documents GROUP BY ALL""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of events, people, turns and documents, one union of counts."""
    count = lambda what, name, c: table(spark, sf_dir, name).groupBy(F.lit(what).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return count("events", "events", "event_type").unionByName(count("segments", "customer", "c_mktsegment")).unionByName(count("roles", "conversations", "role")).unionByName(count("langs", "documents", "lang"))


@query(f"""WITH {MESSAGES_SQL}, e AS (SELECT ego, count(DISTINCT conv_id) AS s, count(*) AS t, sum(length(text) // 4) AS k FROM m GROUP BY ego)
SELECT count(*) AS n_egos, round(avg(s), 4) AS sessions, min(s) AS sessions_min, max(s) AS sessions_max, round(avg(t), 4) AS turns, round(avg(k), 4) AS tokens, sum(k)::BIGINT AS tokens_total, round(sum(k) / 15, 4) AS tokens_a_day FROM e""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and ranges of sessions, turns and tokens an owner, and totals."""
    e = messages(spark, sf_dir).groupBy("ego").agg(F.count_distinct("conv_id").alias("s"), F.count("*").alias("t"), F.sum(F.floor(F.length("text") / 4)).alias("k"))
    return e.agg(F.count("*").alias("n_egos"), F.round(F.avg("s"), 4).alias("sessions"), F.min("s").alias("sessions_min"), F.max("s").alias("sessions_max"), F.round(F.avg("t"), 4).alias("turns"), F.round(F.avg("k"), 4).alias("tokens"), F.sum("k").alias("tokens_total"), F.round(F.sum("k") / 15, 4).alias("tokens_a_day"))


@query("""SELECT doc_id AS id, 'fact' AS kind, source AS said FROM documents UNION ALL SELECT item_id, 'feeling', text FROM benchmark UNION ALL SELECT vec_id, 'public', NULL FROM embeddings""")
def united_loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, feelings and public items as rows of one shape; what one kind lacks is null."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("fact").alias("kind"), F.col("source").alias("said"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("feeling").alias("kind"), F.col("text").alias("said"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("public").alias("kind"))
    return d.unionByName(b).unionByName(v, allowMissingColumns=True)


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, 1::BIGINT AS rank, text AS doc_id, 0.0::DOUBLE AS score FROM q WHERE false")
def no_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline without memory: no hits, in the shape of hits."""
    return questions(spark, sf_dir).select("question_id", F.lit(1).cast("long").alias("rank"), F.col("text").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 30""")
def shuffled_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents in an order drawn by a seed."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("42:"), "doc_id")), "doc_id").limit(30).select("doc_id", "source")


def pseudonyms(agents: DataFrame, seed: int, by: Column) -> DataFrame:
    """agent, by, pseudonym: in each group of `by` agents are numbered in the order of a hash of seed, group and agent."""
    keyed = agents.select("agent", by.alias("by"))
    k = F.row_number().over(Window.partitionBy("by").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "by", "agent"), 256), "agent"))
    return keyed.select("agent", "by", F.concat(F.lit("person_"), k).alias("pseudonym"))


@query("""WITH a AS (SELECT DISTINCT conv_id, role AS agent FROM conversations), g AS (SELECT agent, 'person_' || row_number() OVER (ORDER BY sha256('3:all:' || agent), agent) AS sham FROM (SELECT DISTINCT agent FROM a)),
b AS (SELECT conv_id, agent, 'person_' || row_number() OVER (PARTITION BY conv_id ORDER BY sha256('3:' || conv_id || ':' || agent), agent) AS broken FROM a)
SELECT c.conv_id, c.turn, c.role || ' speaks' AS raw, g.sham || ' speaks' AS sham, b.broken || ' speaks' AS broken FROM conversations c JOIN g ON g.agent = c.role JOIN b ON b.conv_id = c.conv_id AND b.agent = c.role""")
def identity_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their speakers as they are, under one map for all sessions, and under a new map in each session."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    a = c.select("conv_id", F.col("role").alias("agent")).distinct()
    sham = pseudonyms(a.select("agent").distinct(), 3, F.lit("all")).select(F.col("agent").alias("role"), F.col("pseudonym").alias("sham"))
    broken = pseudonyms(a, 3, F.col("conv_id")).select(F.col("by").alias("conv_id"), F.col("agent").alias("role"), F.col("pseudonym").alias("broken"))
    said = lambda x: F.concat(x, F.lit(" speaks")).alias(x)
    return c.join(F.broadcast(sham), "role").join(broken, ["conv_id", "role"]).select("conv_id", "turn", F.concat("role", F.lit(" speaks")).alias("raw"), said("sham"), said("broken"))
