"""Instances read from task files as question items, their agents' numbers, source turns, withheld evidence and named things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import names
from quern.plans.registry import query
from quern.plans.scoring import CLEAN, SPACE
from quern.sources import items, readers
from quern.sources.tables import in_duckdb, portable, scratch, table

#: An instance of every dimension from each turn, its words the facts; numbers decide which fields are there.
ROWS = """SELECT conv_id, turn, CASE WHEN conv_id % 11 <> 3 THEN concat(conv_id, '_', turn) END AS id, CASE WHEN conv_id % 13 = 5 THEN ' ' ELSE concat('Question: ', text) END AS query, (conv_id * 5 + turn) % 12 AS k,
CASE WHEN turn % 3 = 0 THEN text END AS direct, CASE WHEN turn % 5 = 0 THEN 'it was blue' END AS original_detail, CASE WHEN turn % 5 = 1 THEN text END AS original_fact, CASE WHEN conv_id % 2 = 0 THEN concat(text, ' later') END AS contradictory_fact,
concat('s', conv_id * 3 % 150) AS source, concat('s', conv_id * 7 % 150) AS other, CASE WHEN conv_id % 4 > 0 THEN concat('t', turn % 4) END AS source_turn, CASE WHEN conv_id % 3 > 0 THEN role ELSE 'nobody' END AS speaker,
CASE WHEN conv_id % 2 = 0 THEN ' Ann Lee ' END AS referent, CASE turn % 3 WHEN 1 THEN ' Abstain' WHEN 2 THEN 'no_knowledge' ELSE 'answer' END AS reply, CASE turn % 3 WHEN 0 THEN false WHEN 1 THEN true END AS disclosure,
CASE WHEN conv_id % 3 = 0 THEN 'context' ELSE 'place' END AS attribute, CASE WHEN conv_id % 4 = 1 THEN 'a voice' END AS altered, CASE WHEN conv_id % 5 = 0 THEN '__assistant__' WHEN conv_id % 5 < 3 THEN 'bob_ray' END AS absent, turn % 2 = 0 AS anomalous,
CASE WHEN conv_id % 6 = 0 THEN concat(' ', role, ' ') END AS claim, CASE WHEN conv_id % 2 = 1 THEN 'C' END AS letter, role FROM {conversations}"""
DIMENSIONS = ["d1_conflict", "d2_anaphora", "d3_confabulation", "d4_permission", "d5_cloze", "d6_metadata", "d7_qa", "d8_temporal", "d9_negation", "d10_counterfactual", "d11_exception", "d12_other"]
TRIM = lambda x: f"trim({x}, {SPACE})"
#: DuckDB: the first text of a turn's name, the first of a speaker, and all of a session.
SAID_SQL = f"""u AS (SELECT 's' || conv_id AS s, turn, 't' || turn AS t, role, {TRIM("coalesce(text, '')")} AS x FROM conversations),
ut AS (SELECT s, t, arg_min(x, turn) AS x FROM u GROUP BY ALL), us AS (SELECT s, role, arg_min(x, turn) AS x FROM u GROUP BY ALL), uw AS (SELECT s, coalesce(string_agg(x, ' ' ORDER BY turn) FILTER (WHERE x <> ''), '') AS x FROM u GROUP BY s)"""


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, position, turn_id, speaker_id, text of every conversation turn."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("turn").alias("position"), F.concat(F.lit("t"), "turn").alias("turn_id"), F.col("role").alias("speaker_id"), "text")


@query(f"""WITH r AS ({in_duckdb(ROWS, "conversations")}), {SAID_SQL},
i AS (SELECT r.*, {CLEAN.format(x="query")} AS question, coalesce(nullif({TRIM("direct")}, ''), nullif({TRIM("claim")}, ''), 'an event') AS given, CASE WHEN k = 0 THEN coalesce(us.x, w.x, '') ELSE coalesce(ut.x, w.x, '') END AS said, coalesce(o.x, '') AS contra, trim(coalesce(referent, '')) AS who
  FROM r LEFT JOIN ut ON ut.s = source AND ut.t = source_turn LEFT JOIN us ON us.s = source AND us.role = speaker LEFT JOIN uw w ON w.s = source LEFT JOIN uw o ON o.s = other)
SELECT id AS question_id, question, {DIMENSIONS}[k + 1] AS dimension, CASE WHEN k = 4 THEN 'cloze' ELSE 'open_ended' END AS question_type,
  CASE WHEN k = 2 AND turn % 3 = 1 THEN 'abstain' WHEN k = 3 THEN CASE WHEN coalesce(disclosure, true) THEN 'disclose' ELSE 'abstain' END WHEN k IN (0, 2, 8, 9, 10) THEN 'answer' END AS expected_answer_mode,
  CASE WHEN k = 3 THEN CASE WHEN coalesce(disclosure, true) THEN 'ALLOW' ELSE 'DENY_NO_ACCESS' END END AS policy_expected, CASE WHEN k = 4 THEN CASE WHEN letter IS NULL THEN 3 ELSE 1 END END AS n_blanks, CASE WHEN k = 4 THEN source END AS exclude_thread, 't' || turn AS anchor_msg_id,
  CASE WHEN k = 3 AND conv_id % 3 < 2 THEN 'c' || conv_id % 3 END AS contact,
  CASE k WHEN 0 THEN CASE WHEN original_detail IS NOT NULL THEN CASE WHEN speaker = 'nobody' THEN 'Nobody' ELSE upper(left(speaker, 1)) || substr(speaker, 2) END || ' said ' || original_detail || ', but AI Assistant said it was red.'
      WHEN original_fact <> '' AND contradictory_fact <> '' THEN 'Original claim: ' || original_fact || ' Contradictory claim: ' || contradictory_fact WHEN original_fact <> '' THEN original_fact
      WHEN said <> '' AND contra <> '' THEN 'Original claim: ' || said || ' Contradictory claim: ' || contra ELSE coalesce(nullif(said, ''), nullif(contra, ''), given) END
    WHEN 1 THEN CASE WHEN direct <> '' THEN CASE WHEN who <> '' THEN who || ': ' ELSE '' END || direct WHEN said <> '' THEN CASE WHEN who <> '' THEN who || ': ' ELSE '' END || said ELSE given END
    WHEN 2 THEN CASE WHEN turn % 3 = 1 THEN 'abstain' ELSE coalesce(nullif(direct, ''), nullif(said, ''), given) END WHEN 3 THEN coalesce(direct, '') WHEN 4 THEN coalesce(letter, '1B 2A 10D')
    WHEN 5 THEN CASE WHEN attribute = 'context' THEN 'See turn ' || coalesce(source_turn, '') || ' in session ' || source ELSE coalesce(nullif(direct, ''), given) END WHEN 6 THEN coalesce(nullif(direct, ''), nullif(said, ''), given) WHEN 7 THEN coalesce(nullif(direct, ''), given)
    WHEN 8 THEN CASE WHEN turn % 3 = 2 THEN 'No, ' || CASE absent WHEN '__assistant__' THEN 'AI Assistant' WHEN 'bob_ray' THEN 'Bob Ray' ELSE 'the agent' END || ' was not present in that conversation and would not know about it.' ELSE coalesce(nullif(direct, ''), nullif(said, ''), given) END
    WHEN 9 THEN coalesce(coalesce(nullif(direct, ''), nullif(said, '')) || coalesce(' (altered: ' || altered || ')', ''), given) WHEN 10 THEN CASE WHEN anomalous THEN 'No' ELSE 'Yes' END ELSE given END AS answer
FROM i WHERE id IS NOT NULL AND question <> ''""")
def loaded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task files of all dimensions, broken lines among them, read as question items with answers from ground truths or turns."""
    path, k, c = scratch(spark, "instances"), F.col("k"), F.col
    r = portable(spark, sf_dir, ROWS, "conversations")
    only = lambda name, value: F.when(k.isin(*[DIMENSIONS.index(x) for x in DIMENSIONS if x.startswith(name)]), value)
    blanks = F.when(c("letter").isNull(), F.create_map(F.lit("blank_10"), F.lit("x"), F.lit("blank_2"), F.lit("y"), F.lit("blank_1"), F.lit("z")))
    choices = F.create_map(F.lit("blank_10"), F.struct(F.lit("D").alias("answer_letter")), F.lit("blank_1"), F.struct(F.lit("B").alias("answer_letter")))
    truth = F.struct(
        F.when(k.isin(6, 7), c("direct")).alias("answer"), c("direct").alias("value"), F.when(k == 3, c("direct")).alias("fact"), F.lit("an event").alias("event"), F.when(c("direct").isNull() | (F.trim("direct") == ""), c("claim")).alias("response"),
        "original_detail", F.when(c("original_detail").isNotNull(), "it was red").alias("changed_detail"), "original_fact", "contradictory_fact", c("speaker").alias("source_agent"), F.lit("__assistant__").alias("conflicting_agent"), c("other").alias("conflicting_session"), c("source").alias("original_session"),
        c("direct").alias("antecedent_text"), c("source").alias("antecedent_session"), c("source_turn").alias("antecedent_turn"), "referent", c("reply").alias("expected_response"), c("direct").alias("correct_fact"), c("source").alias("source_session"), "source_turn", "attribute", c("absent").alias("absent_agent"),
        c("direct").alias("actual_fact"), c("source").alias("actual_session"), c("source_turn").alias("actual_turn"), c("direct").alias("real_fact"), c("altered").alias("altered_detail"), c("disclosure").alias("expected_disclosure"), c("anomalous").alias("is_anomalous"), only("d5", blanks).alias("blanks"), only("d5", choices).alias("choices"), c("letter").alias("answer_letter"), c("source").alias("session_id"),
    )
    line = F.to_json(F.struct(c("id").alias("instance_id"), "query", F.concat(F.lit("a"), c("conv_id") % 3).alias("ego_agent_id"), F.array(F.struct(F.lit("t0").alias("turn_id")), F.struct(F.concat(F.lit(" t"), "turn").alias("turn_id"))).alias("ego_context"), truth.alias("ground_truth")))
    lines = r.select(F.element_at(F.array(*map(F.lit, DIMENSIONS)), (k + 1).cast("int")).alias("dimension"), F.explode(F.array(line, F.left(line, F.lit(60)), F.lit(""))).alias("value"))
    lines.write.partitionBy("dimension").text(path)
    contacts = spark.createDataFrame([(f"a{i}", {"Ann": f"c{i}"}) for i in range(2)], "agent string, contacts map<string, string>")
    found = items.question_items(items.instances(spark, f"{path}/*/*.txt", "dimension=([^/]+)/"), speeches(spark, sf_dir), contacts)
    return found.select("question_id", "question", "dimension", "question_type", "expected_answer_mode", "policy_expected", "n_blanks", "exclude_thread", "anchor_msg_id", F.col("owner_contacts")["Ann"].alias("contact"), "answer")


@query("""SELECT 'agent_' || c_custkey AS agent, (sum(2 + (c_custkey % 7 = 0)::INT) OVER (ORDER BY c_custkey) - CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END)::BIGINT AS line FROM customer""")
def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each agent in a list of files with blank, broken and repeated lines, which count as lines."""
    path, k = scratch(spark, "agents"), F.col("c_custkey")
    line = F.to_json(F.struct(F.concat(F.lit(" agent_"), k).alias("agent_id")))
    lines = F.filter(F.array(line, F.when(k % 7 == 0, F.lit("")), F.when(k % 7 == 0, line).otherwise("{broken")), lambda x: x.isNotNull())
    table(spark, sf_dir, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select(F.explode(lines)).write.text(path)
    return readers.agent_numbers(spark, path)


@query(f"""WITH {SAID_SQL}, a AS (SELECT item_id, 's' || item_id AS s, CASE WHEN item_id % 3 = 0 THEN 't' || item_id % 5 END AS t, CASE WHEN item_id % 3 < 2 AND item_id % 7 > 0 THEN 'assistant' END AS who FROM benchmark)
SELECT item_id, coalesce(ut.x, us.x, uw.x, '') AS said FROM a LEFT JOIN ut USING (s, t) LEFT JOIN us ON us.s = a.s AND us.role = who LEFT JOIN uw ON uw.s = a.s""")
def source_turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the turn that an instance names says, else its speaker's first turn, else its whole session."""
    k = F.col("item_id")
    a = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("s"), k).alias("session"), F.when(k % 3 == 0, F.concat(F.lit("t"), k % 5)).alias("turn"), F.when((k % 3 < 2) & (k % 7 > 0), "assistant").alias("speaker"))
    return items.source_texts(a, speeches(spark, sf_dir)).select("item_id", "said")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [] ELSE ['s' || conv_id] END AS sessions, CASE WHEN turn % 2 = 0 THEN 'withheld' ELSE 'full' END AS tier, CASE WHEN turn % 2 = 0 THEN [] ELSE ['s' || conv_id, 's0'] END AS meta_sessions, CASE WHEN turn % 2 = 0 THEN '' ELSE 's' || conv_id END AS meta_session, role AS meta_role, text FROM conversations""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of two tiers: one loses every way to its evidence and keeps its other fields and its text."""
    s = F.concat(F.lit("s"), "conv_id")
    i = F.struct(F.array(s).alias("evidence_session_ids"), F.lit("full").alias("context_tier"), "text", F.struct(F.array(s, F.lit("s0")).alias("evidence_sessions"), s.alias("session_id"), F.col("role")).alias("metadata"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", i.alias("i")).withColumn("i", F.when(F.col("turn") % 2 == 0, items.withheld(F.col("i"), "withheld")).otherwise(F.col("i")))
    return c.select("conv_id", "turn", F.col("i.evidence_session_ids").alias("sessions"), F.col("i.context_tier").alias("tier"), F.col("i.metadata.evidence_sessions").alias("meta_sessions"), F.col("i.metadata.session_id").alias("meta_session"), F.col("i.metadata.role").alias("meta_role"), "i.text")


MARK = "replace(replace(replace(text, ' the ', ' Dr. Ann Lee '), ' and ', ' The Old Mill '), ' la ', ' Port Said ')"
BARE = """regexp_replace({x}, '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g')"""


@query(rf"""WITH m AS (SELECT conv_id, turn, {MARK} AS text FROM conversations), r AS (SELECT *, list_filter(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1), lambda x: regexp_split_to_array(x, '\s+')[1] NOT IN {tuple(names.NO_NAME_STARTS)}) AS runs FROM m),
e AS (SELECT conv_id, turn, list_filter(runs, lambda x, i: list_position(runs, x) = i) AS named, list_filter(list_transform(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: length(x) > 4), lambda x: {BARE.format(x="x")}), lambda x: lower(x) NOT IN {tuple(names.TOPIC_STOP_WORDS)})[1:3] AS words FROM r)
SELECT conv_id, turn, named, CASE WHEN len(named) > 0 THEN array_to_string(named[1:2], ' and ') WHEN len(words) > 0 THEN array_to_string(words, ' ') ELSE 'what was discussed' END AS topic FROM e""")
def named_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole turns name, and the topic that the names or the longer words give."""
    t = F.expr(MARK)
    named = names.named_things(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", named.alias("named"), names.topic(t, named).alias("topic"))


@query("""WITH c AS (SELECT 'i' || conv_id AS instance_id, role AS namespace, text AS query, turn % 5 = 4 AS errored, CASE WHEN turn % 5 = 4 THEN [] ELSE [text, 'm' || turn] END AS memories, conv_id, turn FROM conversations),
o AS (SELECT instance_id, arg_max(errored, turn) AS e, arg_max(memories, turn) AS m FROM c GROUP BY ALL), l AS (SELECT namespace, query, arg_max({'e': errored, 'm': memories}, (conv_id, turn)) AS r FROM c WHERE query <> '' GROUP BY ALL),
a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'i' || (conv_id + 1) ELSE 'x' END AS instance_id, CASE WHEN conv_id % 4 = 0 THEN 'nobody' ELSE role END AS namespace, text AS query FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN o.m IS NOT NULL THEN 'instance' WHEN l.r IS NOT NULL THEN 'query' ELSE 'miss' END AS found_by, coalesce(o.e, l.r.e, false) AS errored, coalesce(o.m, l.r.m, []) AS memories FROM a LEFT JOIN o USING (instance_id) LEFT JOIN l USING (namespace, query)""")
def frozen_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns looked up in a frozen cache by instance, then by namespace and query; every row must be of the expected system."""
    path = scratch(spark, "cache")
    c = table(spark, sf_dir, "conversations")
    bad = F.col("turn") % 5 == 4
    line = F.to_json(F.struct(F.concat(F.lit("i"), "conv_id").alias("instance_id"), F.col("role").alias("namespace"), F.col("text").alias("query"), F.lit("mem0").alias("system"), F.when(bad, "timeout").alias("error"), F.when(~bad, F.array("text", F.concat(F.lit("m"), "turn"))).alias("memories")))
    c.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").select(line).write.text(path)
    asked = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("i"), F.col("conv_id") + 1)).otherwise("x").alias("instance_id"), F.when(F.col("conv_id") % 4 == 0, "nobody").otherwise(F.col("role")).alias("namespace"), F.col("text").alias("query"))
    return readers.from_cache(asked, readers.frozen_cache(spark, path, system="mem0")).select("conv_id", "turn", "found_by", "errored", "memories")
