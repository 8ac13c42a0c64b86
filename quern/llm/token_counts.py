"""Token counts: an exact length histogram whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths that one bucket of the suffix sums spans.
SPAN = 1024


def token_lengths(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the column `out` (long): ids in the whole text. Null and empty texts have none; rows are kept as they are."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).count
        for texts in batches:
            yield pd.Series([encode(x) if x else 0 for x in texts], dtype="int64")

    return docs.withColumn(out, count(F.col(text)))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per encoded length that occurs: n_tokens, n_docs (repeated rows count each; null and empty texts have length 0)."""
    lengths = token_lengths(docs.select(F.col(text).alias("__text")), "__text", "n_tokens", vocabulary)
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """Adds to each length L of a histogram what a context limit of L gives.

    docs_longer: documents longer than L; tokens_longer: their tokens; tokens_at_limit: tokens left when every document
    is cut at L; docs_total, tokens_total: of the whole corpus. The suffix sums run in two levels, first over buckets of
    SPAN lengths, then inside each, so one task holds SPAN lengths or all buckets but never documents. An empty
    histogram gives no rows. Between two neighbouring lengths L < M, a limit l has the docs_longer of L and
    tokens_at_limit(L) + (l - L) * docs_longer(L) tokens, so the rows answer every limit.
    """
    table = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("bucket"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = table.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    buckets = buckets.select("bucket", *[F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"{x}_after") for x in "dt"], *[F.sum(x).over(every).alias(f"{x}_all") for x in "dt"])
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = table.withColumns({"docs_longer": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "tokens_longer": F.coalesce(F.sum("tokens").over(inside), F.lit(0))}).join(buckets, "bucket")
    longer, held = F.col("docs_longer") + F.col("d_after"), F.col("tokens_longer") + F.col("t_after")
    return sums.select("n_tokens", "n_docs", longer.alias("docs_longer"), held.alias("tokens_longer"), (F.col("t_all") - held + F.col("n_tokens") * longer).alias("tokens_at_limit"), F.col("d_all").alias("docs_total"), F.col("t_all").alias("tokens_total"))


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of documents does not exceed. No documents: no rows."""
    wanted = totals.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    fits = totals.join(F.broadcast(wanted), F.col("docs_total") - F.col("docs_longer") >= F.col("share") * F.col("docs_total"))
    return fits.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
