"""Instances of task files as question items: text, gold answer, expected mode and policy by dimension, and what context needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import names
from quern.functions import text as tx

# The fields that may hold a plain answer, in the order in which they count.
ANSWER_FIELDS = ["answer", "correct_answer", "resolved_text", "value", "fact", "response", "event", "claim"]

#: Where a dimension's ground truth names the session, turn and speaker of its source.
SOURCES = {
    "d1_conflict": ("original_session", None, "source_agent"),
    "d2_anaphora": ("antecedent_session", "antecedent_turn", None),
    "d3_confabulation": ("source_session", "source_turn", None),
    "d7_qa": ("source_session", "source_turn", None),
    "d9_negation": ("actual_session", "actual_turn", None),
    "d10_counterfactual": ("source_session", "source_turn", None),
}
TEXTS = [
    *ANSWER_FIELDS, "original_detail", "changed_detail", "original_fact", "contradictory_fact", "source_agent", "conflicting_agent", "conflicting_session", "antecedent_text", "referent", "expected_response", "correct_fact",
    "attribute", "attribute_value", "absent_agent", "actual_fact", "real_fact", "altered_detail", "session_id", "answer_letter", *sorted({x for s in SOURCES.values() for x in s[:2] if x}),
]
TRUTH = "struct<" + ", ".join(f"{x}: string" for x in TEXTS) + ", expected_disclosure: boolean, is_anomalous: boolean, blanks: map<string, string>, choices: map<string, struct<answer_letter: string>>>"
SHAPE = f"instance_id string, query string, difficulty string, evidence_session_ids array<string>, ego_agent_id string, context_tier string, asker_agent_id string, answerer_agent_id string, ego_context array<struct<turn_id: string>>, metadata map<string, string>, ground_truth {TRUTH}, _bad string"
ITEM = ["question_id", "question", "answer", "question_type", "dimension", "difficulty", "expected_answer_mode", "policy_expected", "n_blanks", "exclude_thread", "anchor_msg_id", "ego_context_turn_ids", "evidence_session_ids", "ego_agent_id", "context_tier", "asker_agent_id", "answerer_agent_id", "instance_metadata", "gold_ground_truth"]


def some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def shown_name(slug: Column) -> Column:
    """An agent's name; assistants have one for all."""
    slug = F.coalesce(slug, F.lit(""))
    return F.when(F.startswith(slug, F.lit("assistant_")) | (slug == "__assistant__"), "AI Assistant").otherwise(names.display_name(slug))


def source_texts(requests: DataFrame, turns: DataFrame, session: str = "session", turn: str = "turn", speaker: str = "speaker", other: str | None = None) -> DataFrame:
    """requests with `said`: the text of the turn named; where the session has no such turn or none is named, of the speaker's
    first turn; without either, all texts of the session in order, joined by blanks. Texts are trimmed; a session that is
    not there gives an empty text. With `other`, a session too, all its texts come as `other_said`.

    turns: session_id, position, turn_id, speaker_id, text. Turns become one row per name and one per session before they
    meet requests, so requests for one session are never multiplied by its turns; the requests of a hot session spread by turn.
    Turns of sessions that nobody asks for go first.
    """
    asked = requests.select(F.col(session).alias("session_id"))
    if other:
        asked = asked.unionByName(requests.select(F.col(other).alias("session_id")))
    t = turns.select("session_id", "position", "turn_id", "speaker_id", tx.trimmed(F.coalesce("text", F.lit(""))).alias("text")).join(asked.distinct(), "session_id", "left_semi")
    kinds = F.array(F.struct(F.lit("turn").alias("kind"), F.col("turn_id").alias("name")), F.struct(F.lit("speaker").alias("kind"), F.col("speaker_id").alias("name")))
    first = t.select("session_id", "position", "text", F.inline(kinds)).where("name IS NOT NULL").groupBy("session_id", "kind", "name").agg(F.min(F.struct("position", "text"))["text"].alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("position", "text")))), lambda x: x["text"]), " ")
    whole = t.groupBy("session_id").agg(joined.alias("text"))

    def named(kind: str) -> DataFrame:
        return first.where(F.col("kind") == kind).select(F.col("session_id").alias("__s"), F.col("name").alias("__n"), F.col("text").alias(f"__{kind}"))

    found = requests
    for kind, name in (("turn", turn), ("speaker", speaker)):
        found = found.join(named(kind), (F.col(session) == F.col("__s")) & (F.coalesce(F.col(name), F.lit("")) == F.col("__n")), "left").drop("__s", "__n")
    found = found.join(whole.select(F.col("session_id").alias("__s"), F.col("text").alias("__whole")), F.col(session) == F.col("__s"), "left").drop("__s")
    said = F.coalesce(F.when(some(F.col(turn)), F.col("__turn")), F.when(some(F.col(speaker)), F.col("__speaker")), "__whole", F.lit(""))
    found = found.withColumn("said", said).drop("__turn", "__speaker", "__whole")
    if other:  # requests without one are spread by their own session
        found = found.join(whole.select(F.col("session_id").alias("__s"), F.col("text").alias("other_said")), F.coalesce(F.col(other), F.col(session)) == F.col("__s"), "left").drop("__s")
        found = found.withColumn("other_said", F.coalesce(F.when(F.col(other).isNotNull(), F.col("other_said")), F.lit("")))
    return found


def instances(spark: SparkSession, pattern: str, dimension: str = r"([^/]+?)\.jsonl(?:\.gz)?$") -> DataFrame:
    """The instances of many task files with the dimension that the pattern finds in the file's name; lines that are no
    JSON object, have no id or whose question is empty once cleaned are left out."""
    lines = spark.read.text(pattern).select(F.regexp_extract(F.col("_metadata.file_path"), dimension, 1).alias("dimension"), "value")
    rows = lines.select("dimension", F.get_json_object("value", "$.ground_truth").alias("raw"), F.from_json("value", SHAPE, {"columnNameOfCorruptRecord": "_bad"}).alias("i")).where("i._bad IS NULL")
    rows = rows.select("dimension", "raw", "i.*").drop("_bad").withColumn("query", tx.clean_answer(F.col("query")))
    return rows.where("instance_id <> '' AND query <> ''")


def _direct(d: Column, t: Column) -> Column:
    """Whether the ground truth itself tells the answer, so that no turn is looked up."""
    own = {"d1_conflict": (some(t["original_detail"]) & some(t["changed_detail"])) | some(t["original_fact"]), "d2_anaphora": some(t["antecedent_text"]), "d7_qa": some(t["answer"]), "d10_counterfactual": some(t["real_fact"])}
    reply = tx.trimmed(F.lower(F.coalesce(t["expected_response"], F.lit(""))))
    own["d3_confabulation"] = (reply == "abstain") | some(t["correct_fact"])
    own["d9_negation"] = (reply == "no_knowledge") | some(t["actual_fact"]) | some(t["answer"])
    found = F.lit(True)
    for name, told in own.items():
        found = F.when(d == name, told).otherwise(found)
    return found


def _answer(d: Column, t: Column, raw: Column, said: Column, other: Column) -> Column:
    """The gold text; said and other are null where nothing was looked up, and empty where nothing was found."""
    given = F.coalesce(*[F.nullif(tx.trimmed(t[x]), F.lit("")) for x in ANSWER_FIELDS], raw, F.lit("{}"))
    first = lambda *x: F.coalesce(*[F.nullif(y, F.lit("")) for y in x], given)
    reply, who = tx.trimmed(F.lower(F.coalesce(t["expected_response"], F.lit("")))), tx.trimmed(F.coalesce(t["referent"], F.lit("")))
    text = F.format_string
    both = F.when(some(said) & some(other), text("Original claim: %s Contradictory claim: %s", said, other)).otherwise(first(said, other))
    conflict = F.when(some(t["original_detail"]) & some(t["changed_detail"]), text("%s said %s, but %s said %s.", shown_name(t["source_agent"]), t["original_detail"], shown_name(t["conflicting_agent"]), t["changed_detail"]))
    conflict = conflict.when(some(t["original_fact"]) & some(t["contradictory_fact"]), text("Original claim: %s Contradictory claim: %s", t["original_fact"], t["contradictory_fact"])).when(some(t["original_fact"]), t["original_fact"]).otherwise(both)
    named = lambda x: F.when(who != "", text("%s: %s", who, x)).otherwise(x)
    anaphora = F.when(some(t["antecedent_text"]), named(t["antecedent_text"])).when(some(said), named(said)).when(said.isNull() & (who != ""), who).otherwise(given)
    single = (F.size(F.coalesce(t["blanks"], F.create_map().cast("map<string,string>"))) == 0) & some(t["answer_letter"])
    number = lambda x: F.get(F.split(x, "_"), F.lit(1))
    order = F.array_sort(F.transform(F.map_keys(t["blanks"]), lambda x: F.struct(number(x).cast("int").alias("k"), F.coalesce(F.try_element_at(t["choices"], x)["answer_letter"], F.lit("A")).alias("letter"), number(x).alias("shown"))))
    cloze = F.when(single, t["answer_letter"]).otherwise(F.coalesce(F.array_join(F.transform(order, lambda x: F.concat(x["shown"], x["letter"])), " "), F.lit("")))
    place = F.when(t["attribute"] == "context", text("See turn %s in session %s", F.coalesce(t["source_turn"], F.lit("")), F.coalesce(t["source_session"], F.lit("")))).otherwise(first(t["value"], t["attribute_value"]))
    absent = text("No, %s was not present in that conversation and would not know about it.", F.when(some(t["absent_agent"]), shown_name(t["absent_agent"])).otherwise("the agent"))
    changed = lambda x: F.when(some(t["altered_detail"]), text("%s (altered: %s)", x, t["altered_detail"])).otherwise(x)
    real = F.nullif(F.coalesce(F.nullif(t["real_fact"], F.lit("")), said), F.lit(""))
    found = F.when(d == "d1_conflict", conflict).when(d == "d2_anaphora", anaphora)
    found = found.when(d == "d3_confabulation", F.when(reply == "abstain", "abstain").otherwise(first(t["correct_fact"], said))).when(d == "d4_permission", F.coalesce(t["fact"], F.lit("")))
    found = found.when(d == "d5_cloze", cloze).when(d == "d6_metadata", place).when(d == "d7_qa", first(t["answer"], said)).when(d == "d8_temporal", first(t["answer"]))
    found = found.when(d == "d9_negation", F.when(reply == "no_knowledge", absent).otherwise(first(t["actual_fact"], t["answer"], said)))
    found = found.when(d == "d10_counterfactual", F.when(real.isNotNull(), changed(real)).otherwise(given))
    return found.when(d == "d11_exception", F.when(F.coalesce(t["is_anomalous"], F.lit(True)), "No").otherwise("Yes")).otherwise(given)


def question_items(rows: DataFrame, turns: DataFrame | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """One item (ITEM's columns) for each of instances(). Where the ground truth has no answer of its own, the text of the
    source turn is looked up in turns (see source_texts()), then the first plain answer field counts, then the ground
    truth as compact JSON. With contacts (agent, contacts: a map of name to closeness), permission items also get their
    owner's as owner_contacts. Only instances that need a turn are joined with turns; null ground truths are empty ones.
    """
    d, t = F.col("dimension"), F.col("ground_truth")
    blank = F.lit(None).cast("string")
    rows = rows.withColumn("ground_truth", F.coalesce("ground_truth", F.from_json(F.lit("{}"), TRUTH)))
    answered = rows.withColumns({"said": blank, "other_said": blank})
    if turns is not None:
        pick = {}
        for i, name in enumerate(["session", "turn", "speaker"]):
            value = blank
            for dimension, source in SOURCES.items():
                if source[i]:
                    value = F.when(d == dimension, t[source[i]]).otherwise(value)
            pick[name] = value
        needy = rows.where(~_direct(d, t)).withColumns({**pick, "other": F.when(d == "d1_conflict", t["conflicting_session"])})
        answered = answered.where(_direct(d, t)).unionByName(source_texts(needy, turns, other="other").drop("session", "turn", "speaker", "other"))
    cloze, permission = d == "d5_cloze", d == "d4_permission"
    told = F.coalesce(t["expected_disclosure"], F.lit(True))
    abstain = (d == "d3_confabulation") & (tx.trimmed(F.lower(F.coalesce(t["expected_response"], F.lit("")))) == "abstain")
    mode = F.when(permission, F.when(told, "disclose").otherwise("abstain")).when(abstain, "abstain").when(d.isin("d1_conflict", "d3_confabulation", "d9_negation", "d10_counterfactual", "d11_exception"), "answer")
    n_blanks = F.size(F.coalesce(t["blanks"], F.create_map().cast("map<string,string>")))
    columns = {
        "question_id": F.col("instance_id"), "question": F.col("query"), "answer": _answer(d, t, F.col("raw"), F.col("said"), F.col("other_said")),
        "question_type": F.when(cloze, "cloze").otherwise("open_ended"), "difficulty": F.coalesce("difficulty", F.lit("medium")), "expected_answer_mode": mode,
        "policy_expected": F.when(permission, F.when(told, "ALLOW").otherwise("DENY_NO_ACCESS")), "n_blanks": F.when(cloze, F.when((n_blanks == 0) & some(t["answer_letter"]), 1).otherwise(n_blanks)).cast("long"),
        "exclude_thread": F.when(cloze, F.nullif(t["session_id"], F.lit(""))), "anchor_msg_id": F.nullif(F.trim(F.get("ego_context", F.size("ego_context") - 1)["turn_id"]), F.lit("")),
        "ego_context_turn_ids": F.when(F.size("ego_context") > 0, F.transform("ego_context", lambda x: F.coalesce(x["turn_id"], F.lit("")))), "instance_metadata": F.col("metadata"), "gold_ground_truth": F.col("raw"),
    }
    found = answered.withColumns(columns).select(*ITEM)
    if contacts is not None:
        owned = contacts.select(F.col("agent").alias("__agent"), F.col("contacts").alias("owner_contacts"))
        found = found.join(owned, (F.col("ego_agent_id") == F.col("__agent")) & permission, "left").drop("__agent")
    return found


def withheld(instance: Column, tier: str) -> Column:
    """An instance without the three fields that lead to its evidence (the sessions listed, and those and the session of its
    metadata), in another tier; its other fields stay."""
    none = F.array().cast("array<string>")
    meta = instance["metadata"].withField("evidence_sessions", none).withField("session_id", F.lit(""))
    return instance.withField("evidence_session_ids", none).withField("context_tier", F.lit(tier)).withField("metadata", meta)
