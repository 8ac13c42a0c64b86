"""Memory systems under one protocol: a search over messages and queries gives ranked hits, whatever stands behind it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import retrieval

HITS = ["question_id", "rank", "doc_id", "score"]
#: How prompts are built from hits, and the names of systems that need a service.
JSON_CONTEXT, TEXT_SESSIONS = "json_context", "text_sessions"
REMOTE = ["memos", "mem0", "mem0sdk", "memobase", "memsearch", "zep"]


@dataclass(frozen=True)
class Adapter:
    """search(messages, queries, k, **options) -> HITS, ranks from 1 within a question.

    messages: scope, doc_id, text, session, at (their order in a scope); queries: question_id, scope, text, gold (array of
    sessions), allowed (whether its asker may be told). Messages are what the search reads, so adding some is adding rows,
    and a scope without rows has been reset: no adapter keeps a state of its own. Scores of adapters that do not rank
    by one are 0.
    """

    name: str
    search: Callable[..., DataFrame]
    prompt_style: str = JSON_CONTEXT
    options: dict = field(default_factory=dict)

    def hits(self, messages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return self.search(messages, queries, k, **self.options).select(*HITS)


def by_words(messages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 over the question's scope."""
    return retrieval.bm25(messages.select("scope", "doc_id", "text"), queries.select("question_id", "scope", "text"), k)


def latest(messages: DataFrame, queries: DataFrame, k: int, max_tokens: int = 8192, max_messages: int = 2000) -> DataFrame:
    """The latest messages of the scope, newest first, while their tokens (a fourth of their characters, one at least) fit; the
    newest always. What fits is worked out once a scope: no question meets more than it gets."""
    w = Window.partitionBy("scope").orderBy(F.desc("at"), F.desc("doc_id"))
    cost = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    suffix = messages.select("scope", "doc_id", F.row_number().over(w).cast("long").alias("rank"), F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"))
    suffix = suffix.where((F.col("rank") <= min(k, max_messages)) & ((F.col("spent") <= max_tokens) | (F.col("rank") == 1)))
    return queries.select("question_id", "scope").join(suffix, "scope").withColumn("score", F.lit(0.0))


def evidence(messages: DataFrame, queries: DataFrame, k: int, gated: bool = False, max_messages: int = 2000) -> DataFrame:
    """The messages of the question's gold sessions in their order; gated: only where the asker may be told."""
    q = queries.where("allowed") if gated else queries
    q = q.select("question_id", "scope", F.explode(F.array_distinct("gold")).alias("session"))
    found = q.join(messages.select("scope", "session", "doc_id", "at"), ["scope", "session"])
    return retrieval.ranked(found, "question_id", [F.asc("at"), F.asc("doc_id")], min(k, max_messages)).withColumn("score", F.lit(0.0))


def nothing(messages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return queries.where("false").select("question_id", F.lit(1).cast("long").alias("rank"), F.lit("").alias("doc_id"), F.lit(0.0).alias("score"))


def fused(messages: DataFrame, queries: DataFrame, k: int, depth: int = 50) -> DataFrame:
    """Ranks by BM25 and by recency of the best of BM25, fused."""
    words = by_words(messages, queries, depth)
    recent = words.join(messages.select("doc_id", "at"), "doc_id")
    recent = retrieval.ranked(recent.select("question_id", "doc_id", "at"), "question_id", [F.desc("at"), F.asc("doc_id")])
    return retrieval.reciprocal_ranks([words, recent], k)


#: The names that systems go by.
REGISTRY: dict[str, Adapter] = {
    x.name: x
    for x in [
        Adapter("inmem", by_words),
        Adapter("baseline_simplerag", by_words),
        Adapter("openclaw", by_words),
        Adapter("inmem_text_sessions", by_words, TEXT_SESSIONS),
        Adapter("vanilla", latest),
        Adapter("llm", evidence),
        Adapter("oracle", evidence),
        Adapter("oracle_retrieval", evidence),
        Adapter("oracle_gated", evidence, options={"gated": True}),
        Adapter("baseline_session", nothing),
        Adapter("hybrid_rrf", fused),
    ]
}


def build(system: str, test_mode: bool = False, **options) -> Adapter:
    """The adapter of a name, case and blanks apart, with other options. Systems that need a service are BM25 in test mode, else
    an error, as is an unknown name."""
    name = (system or "").strip().lower()
    found = REGISTRY.get(name)
    if found is None and name in REMOTE and test_mode:
        found = REGISTRY["inmem"]
    if found is None:
        raise ValueError(f"{system!r} needs a service that is not here" if name in REMOTE else f"no memory system is called {system!r}")
    return Adapter(name, found.search, found.prompt_style, {**found.options, **options})
