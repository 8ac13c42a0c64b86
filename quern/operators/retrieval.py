"""Scoped retrieval: BM25, dense, fused, decayed and budgeted rankings as joins, aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import tokens
from quern.sources.tables import kept


#: Documents that a task scores, on average.
DOCS = 4096


def ranked(scores: DataFrame, by: str, order: list[Column], k: int | None = None) -> DataFrame:
    """Adds rank within `by`; with k only the first k rows, which each task cuts to k before the shuffle."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("long"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """question_id, rank, doc_id, score: the k best documents of each query's scope.

    docs: scope, doc_id, text; queries: question_id, scope, text. Terms in over half of a scope's documents get epsilon
    times the scope's mean inverse frequency; repeated query terms count again. Scores are rounded to 6 places, ties go
    to the smaller doc_id. Only positive scores are hits, but a query with a document in its scope has one at least.
    Documents are tokenised once and written under the scratch folder. Document frequencies come from an aggregate that is
    combined where the texts lie. Documents move once more, whole, to tasks of about DOCS: what is asked, with its weights, is
    written and meets them there, so a document's score for a query is summed where it lies, and only each task's k best move.
    """
    lists = kept(docs.select("scope", "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("terms")), "terms")
    scopes = kept(lists.groupBy("scope").agg(F.count("*").alias("n"), F.nullif(F.avg(F.size("terms")), F.lit(0.0)).alias("mean_length"), F.min("doc_id").alias("first")), "scopes")
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    found = lists.select("scope", F.explode(F.array_distinct("terms")).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
    found = kept(found.join(scopes.select("scope", "n"), "scope").select("scope", "term", raw.alias("raw")), "frequencies")
    asked = queries.select("question_id", "scope", F.explode(tokens(F.col("text"))).alias("term")).groupBy("question_id", "scope", "term").agg(F.count("*").alias("times"))
    means = found.groupBy("scope").agg(F.avg("raw").alias("mean"))
    weights = found.join(asked.select("scope", "term"), ["scope", "term"], "left_semi").join(means, "scope").select("scope", "term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    # The empty term, which no text holds, stands for the document that a query has at least. It scores 0.
    least = queries.select("question_id", "scope").withColumns({"term": F.lit(""), "times": F.lit(1).cast("long"), "idf": F.lit(0.0)})
    asked = kept(asked.join(weights, ["scope", "term"]).unionByName(least).join(scopes.select("scope", "mean_length"), "scope"), "asked")
    terms = F.when(F.col("doc_id") == F.col("first"), F.array_append("terms", F.lit(""))).otherwise(F.col("terms"))
    whole = lists.join(scopes.select("scope", "first"), "scope").select("scope", "doc_id", F.size("terms").alias("length"), terms.alias("terms"))
    whole = whole.repartition(1 + lists.count() // DOCS, "doc_id")
    postings = whole.select("scope", "doc_id", "length", F.explode("terms").alias("term")).join(asked.select("scope", "term"), ["scope", "term"], "left_semi")
    postings = postings.groupBy("scope", "doc_id", "length", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    hits = postings.join(asked, ["scope", "term"]).select("question_id", "doc_id", F.coalesce(part, F.lit(0.0)).alias("score"))
    scores = hits.groupBy("question_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    found = ranked(scores, "question_id", [F.desc("score"), F.asc("doc_id")], k)
    return found.where("score > 0 OR rank = 1").select("question_id", "rank", "doc_id", "score")


def bm25_asof(messages: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """bm25() of each query over what its owner had seen by its day, without one session.

    messages: ego, day, conv_id, doc_id, text; queries: question_id, ego, cutoff_day, excluded (a conv_id), text. No message
    is copied per query: messages are tokenised once, frequencies are kept per owner, day and term, and the excluded session's
    terms are taken off. A query's mean inverse frequency is that of a histogram of frequencies, corrected for those terms.
    """
    lists = kept(messages.select("ego", "day", "conv_id", "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("terms")), "terms")
    q = queries.select("question_id", "ego", "cutoff_day", "excluded")
    held = lists.groupBy("ego", "day", "conv_id").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("length"), F.min("doc_id").alias("first"))
    seen = q.join(held, "ego").where("day <= cutoff_day AND conv_id <> excluded").groupBy("question_id").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"), F.min("first").alias("first"))
    q = kept(q.join(seen, "question_id"), "scopes")
    counts = kept(lists.select("ego", "day", "conv_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("ego", "day", "conv_id", "term").agg(F.count("*").alias("c")), "counts")
    days = q.select("ego", "cutoff_day").distinct()
    base = kept(days.join(counts, "ego").where("day <= cutoff_day").groupBy("ego", "cutoff_day", "term").agg(F.sum("c").alias("df")), "frequencies")
    left_out = q.join(counts, "ego").where("conv_id = excluded AND day <= cutoff_day").select("question_id", "term", "c")
    raw = lambda df: F.ln(F.greatest(F.col("n") - df + 0.5, F.lit(0.5))) - F.ln(df + 0.5)  # noqa: E731  the least value is only met by terms that are taken off again
    histogram = base.groupBy("ego", "cutoff_day", "df").agg(F.count("*").alias("terms"))
    sums = q.join(histogram, ["ego", "cutoff_day"]).groupBy("question_id").agg(F.sum(F.col("terms") * raw(F.col("df"))).alias("raw"), F.sum("terms").alias("terms"))
    df, c = F.col("df"), F.col("c")
    less = q.join(left_out, "question_id").join(base, ["ego", "cutoff_day", "term"])
    less = less.groupBy("question_id").agg(F.sum(F.when(df > c, raw(df - c)).otherwise(0.0) - raw(df)).alias("more"), F.count_if(df == c).alias("gone"))
    means = sums.join(less, "question_id", "left").select("question_id", (F.try_divide(F.col("raw") + F.coalesce("more", F.lit(0.0)), F.col("terms") - F.coalesce("gone", F.lit(0)))).alias("mean"))
    asked = queries.select("question_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(q, "question_id").join(base, ["ego", "cutoff_day", "term"]).join(left_out, ["question_id", "term"], "left").withColumn("df", df - F.coalesce("c", F.lit(0))).where("df > 0")
    asked = asked.join(means, "question_id").withColumn("raw", raw(F.col("df"))).withColumn("idf", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")))
    postings = lists.select("ego", "day", "conv_id", "doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked.select("ego", "term").distinct(), ["ego", "term"], "left_semi")
    postings = postings.groupBy("ego", "day", "conv_id", "doc_id", "length", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    hits = asked.join(postings, ["ego", "term"]).where("day <= cutoff_day AND conv_id <> excluded").select("question_id", "doc_id", part.alias("score"))
    least = q.select("question_id", F.col("first").alias("doc_id"), F.lit(0.0).alias("score"))
    scores = hits.unionByName(least).groupBy("question_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    found = ranked(scores, "question_id", [F.desc("score"), F.asc("doc_id")], k)
    return found.where("score > 0 OR rank = 1").select("question_id", "rank", "doc_id", "score")


def reciprocal_ranks(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Fuses ranked lists (question_id, doc_id, rank): sum of 1 / (constant + rank), rounded to 9 places, the k best."""
    every = lists[0].select("question_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("question_id", "doc_id", "rank"))
    fused = every.groupBy("question_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return ranked(fused, "question_id", [F.desc("score"), F.asc("doc_id")], k)


def recency_decayed(hits: DataFrame, age: Column, weight: float = 0.3, half_life: float = 7.0) -> DataFrame:
    """Blends each score, as a share of its query's best, with itself decayed by age in days."""
    share = F.coalesce(F.try_divide("score", F.max("score").over(Window.partitionBy("question_id"))), F.lit(0.0))
    return hits.withColumn("decayed", F.round((1 - weight) * share + weight * share * F.exp(-math.log(2) / half_life * age), 6))


def minmax(value: Column, by: str) -> Column:
    """A value rescaled to [0, 1] inside its group; 0 where all are equal."""
    w = Window.partitionBy(by)
    low = F.min(value).over(w)
    return F.coalesce(F.try_divide(value - low, F.max(value).over(w) - low), F.lit(0.0))


def inner_product(a: Column, b: Column) -> Column:
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def budget_prefix(rows: DataFrame, by: str, order: list[Column], cost: Column, budget: Column) -> DataFrame:
    """Rows of each group in order while their costs fit the budget, stopping at the first that does not; the first row stays."""
    w = Window.partitionBy(by).orderBy(*order)
    upto = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"position": F.row_number().over(w).cast("long"), "spent": upto}).where((F.col("spent") <= budget) | (F.col("position") == 1))
