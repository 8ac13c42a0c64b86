"""Whose memory a question tests, and who asks it, from the first field or session that tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that are the assistant's, and the fields that name an owner, in the order in which they are asked.
ASSISTANTS = ["__assistant__", "assistant"]
OWNER_FIELDS = [
    "ego_agent_id", "metadata.ego_agent_id", "metadata.query_agent", "metadata.instance_query_agent", "answerer_agent_id", "metadata.answerer_agent_id",
    "ground_truth.query_agent", "ground_truth.target_agent", "target_agent", "metadata.target_agent",
]
INSTANCE = """instance_id string, ego_agent_id string, answerer_agent_id string, target_agent string,
metadata struct<ego_agent_id: string, query_agent: string, instance_query_agent: string, answerer_agent_id: string, target_agent: string, evidence_sessions: array<string>>,
ground_truth struct<query_agent: string, target_agent: string, source_session: string, attribute: string, value: string>"""


def owner() -> Column:
    """The first of OWNER_FIELDS of an INSTANCE that is not blank and not the assistant's; empty if none is."""
    name = lambda c: F.trim(F.col(c))
    return F.coalesce(*[F.when((name(c) != "") & ~name(c).isin(*ASSISTANTS), name(c)) for c in OWNER_FIELDS], F.lit(""))


def with_askers(instances: DataFrame, sessions: DataFrame) -> DataFrame:
    """instances (INSTANCE, instance_id unique) with asker. sessions: session_id, place (their order, from the least), people (array).

    In turn: the metadata's query_agent; the ground truth's; if it has a target, someone else of the source session, else of
    the first session with the target and someone else, else the target; the first of the source session for values that
    are speakers; the answerer, unless the assistant; the first of the first evidence session that has people; the first
    of the first session, if it has any; else empty. Sessions are looked up by joins: an instance never meets more than
    its own, and of each target's sessions one row is kept.
    """
    gt, meta = (lambda x: F.nullif(F.col(f"ground_truth.{x}"), F.lit(""))), (lambda x: F.nullif(F.col(f"metadata.{x}"), F.lit("")))
    source = sessions.select(F.col("session_id").alias("source_id"), F.col("people").alias("source"))
    spread = sessions.select("place", "people", F.explode(F.array_distinct("people")).alias("who"))
    other = lambda people, name: F.get(F.filter(people, lambda p: p != name), F.lit(0))
    met = spread.withColumn("other", other(F.col("people"), F.col("who"))).where("other IS NOT NULL").groupBy("who").agg(F.min_by("other", "place").alias("other"))
    evidence = instances.select("instance_id", F.posexplode("metadata.evidence_sessions").alias("n", "session_id")).join(sessions, "session_id").where(F.size("people") > 0)
    evidence = evidence.groupBy("instance_id").agg(F.min_by(F.get("people", F.lit(0)), "n").alias("witness"))
    first = sessions.agg(F.min_by("people", "place").alias("first"))  # one row
    rows = instances.join(source, F.col("ground_truth.source_session") == F.col("source_id"), "left").join(met, F.col("ground_truth.target_agent") == F.col("who"), "left").join(evidence, "instance_id", "left").crossJoin(F.broadcast(first))
    target = F.when(gt("target_agent").isNotNull(), F.coalesce(other(F.col("source"), gt("target_agent")), "other", gt("target_agent")))
    speaker = F.when(gt("value").isNotNull() & (gt("attribute") == "speaker"), F.get("source", F.lit(0)))
    answerer = F.when((F.col("answerer_agent_id") != "") & ~F.col("answerer_agent_id").isin(*ASSISTANTS) & ~F.startswith("answerer_agent_id", F.lit("assistant_")), F.col("answerer_agent_id"))
    asker = F.coalesce(meta("query_agent"), gt("query_agent"), target, speaker, answerer, "witness", F.get("first", F.lit(0)), F.lit(""))
    return rows.withColumn("asker", asker).select(*instances.columns, "asker")
