"""A retrieval index that days are added to: postings of a day are written once, statistics are merged when asked."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.retrieval import ranked

SHAPES = {
    "postings": "scope long, doc_id string, length long, term string, tf long",
    "terms": "scope long, term string, df long",
    "scopes": "scope long, n long, length long, first string",
}


def _part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(f"{SHAPES[name]}, version int").parquet(f"{folder}/{name}")


def version_of(spark: SparkSession, folder: str) -> int:
    """The last whole version; 0 before any. A version counts once its scopes, which are written last, are there."""
    try:
        return _part(spark, folder, "scopes").agg(F.coalesce(F.max("version"), F.lit(0))).collect()[0][0]
    except AnalysisException:
        return 0


def add(docs: DataFrame, folder: str) -> int:
    """Adds documents (scope, doc_id, text; none of them there yet) as the next version and returns it. Only these documents are
    read; what is there is neither read nor written again. What a lost attempt left of the version is overwritten."""
    spark = docs.sparkSession
    version = version_of(spark, folder) + 1
    lists = docs.select("scope", "doc_id", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
    put(lists.select("scope", "doc_id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term")).groupBy("scope", "doc_id", "length", "term").agg(F.count("*").alias("tf")), "postings")
    mine = spark.read.schema(SHAPES["postings"]).parquet(f"{folder}/postings/version={version}")
    put(mine.groupBy("scope", "term").agg(F.count("*").alias("df")), "terms")
    put(lists.groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("length"), F.min("doc_id").alias("first")), "scopes")
    return version


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, version: int | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """question_id, rank, doc_id, score as retrieval.bm25() gives over all documents up to `version` (the last one if null).

    Versions are folders, so those after it are not opened; of the postings, those of asked terms are shuffled."""
    version = version_of(spark, folder) if version is None else version
    upto = lambda name: _part(spark, folder, name).where(F.col("version") <= version)
    scopes = upto("scopes").groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"), F.min("first").alias("first"))
    scopes = scopes.join(queries.select("scope").distinct(), "scope", "left_semi")
    terms = upto("terms").groupBy("scope", "term").agg(F.sum("df").alias("df")).join(scopes.select("scope", "n"), "scope")
    terms = terms.select("scope", "term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    means = terms.groupBy("scope").agg(F.avg("raw").alias("mean"))
    asked = queries.select("question_id", "scope", F.explode(tokens(F.col("text"))).alias("term")).groupBy("question_id", "scope", "term").agg(F.count("*").alias("times"))
    weights = terms.join(asked.select("scope", "term"), ["scope", "term"], "left_semi").join(means, "scope").select("scope", "term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    found = upto("postings").join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    hits = asked.join(weights, ["scope", "term"]).join(found, ["scope", "term"]).join(scopes.select("scope", "mean_length"), "scope").select("question_id", "doc_id", part.alias("score"))
    least = queries.select("question_id", "scope").join(scopes, "scope").select("question_id", F.col("first").alias("doc_id"), F.lit(0.0).alias("score"))
    scores = hits.unionByName(least).groupBy("question_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(scores, "question_id", [F.desc("score"), F.asc("doc_id")], k).where("score > 0 OR rank = 1").select("question_id", "rank", "doc_id", "score")
