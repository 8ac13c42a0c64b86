"""Agreement, rank and calibration statistics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.tables import kept


def kappa(pairs: DataFrame, groups: list[str], certain: float | None = None) -> DataFrame:
    """groups, n, agreement, kappa of rows (groups, a, b); kappa is `certain` (null, or 1) where chance agreement is 1."""
    n = pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
    side = lambda c: pairs.groupBy(*groups, F.col(c).alias("x")).agg(F.count("*").alias(f"n_{c}"))
    chance = side("a").join(side("b"), [*groups, "x"]).groupBy(*groups).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("both"))
    share = F.coalesce(F.col("both"), F.lit(0)) / (F.col("n") * F.col("n"))
    found = n.join(chance, groups, "left") if groups else n.crossJoin(chance)
    return found.select(*groups, "n", F.round("agreement", 6).alias("agreement"), F.round(F.when(share < 1, (F.col("agreement") - share) / (1 - share)).otherwise(F.lit(certain).cast("double")), 6).alias("kappa"))


#: Buckets of values that are sorted apart, at about equal shares of the distinct values.
BUCKETS = 50


def sums_below(counts: DataFrame, value: str, by: list[str], n: str, out: str) -> DataFrame:
    """counts (distinct in by and value) with `out`: the sum of n over the smaller values of the group.

    Each bucket of neighbouring values is sorted for itself; only the buckets' totals, BUCKETS a group, are summed in one
    task. Where the buckets end is estimated, which the sums do not depend on."""
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("cuts"))
    rows = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # without groups, one row
    rows = rows.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    totals = rows.groupBy(*by, "bucket").agg(F.sum(n).alias("total"))
    before = F.sum("total").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("total")
    inside = F.sum(n).over(Window.partitionBy(*by, "bucket").orderBy(value)) - F.col(n)
    return rows.withColumn("inside", inside).join(totals.select(*by, "bucket", before.alias("before")), [*by, "bucket"]).withColumn(out, F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def average_ranks(counts: DataFrame, value: str, by: list[str], rank: str) -> DataFrame:
    """by, value, rank: the ranks from 1 of the values of rows counted in n, ties sharing the mean of theirs. Only distinct
    values are sorted."""
    n = sums_below(counts.groupBy(*by, value).agg(F.sum("n").alias("n")), value, by, "n", "below")
    return n.select(*by, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(rank))


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks per group; null where one side is constant. Rows are counted by their pair of
    values before anything is sorted or joined, and these counts, which five steps read, are written once."""
    pairs = kept(rows.groupBy(*by, a, b).agg(F.count("*").alias("n")), "pairs")
    ranks = pairs.join(average_ranks(pairs, a, by, "ra"), [*by, a]).join(average_ranks(pairs, b, by, "rb"), [*by, b])
    total = lambda x: F.sum(F.col("n") * x)
    n, ra, rb = F.sum("n"), F.col("ra"), F.col("rb")
    sums = ranks.groupBy(*by).agg(n.alias("n"), total(ra).alias("a"), total(rb).alias("b"), total(ra * rb).alias("ab"), total(ra * ra).alias("aa"), total(rb * rb).alias("bb"), ((F.max(ra) > F.min(ra)) & (F.max(rb) > F.min(rb))).alias("varied"))
    n, c = F.col("n"), F.col
    low = F.sqrt(n * c("aa") - c("a") * c("a")) * F.sqrt(n * c("bb") - c("b") * c("b"))
    return sums.select(*by, "n", F.round(F.when(c("varied"), (n * c("ab") - c("a") * c("b")) / low), 6).alias("rho"))


def auc(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Chance that a positive row scores over another one, ties half; 0.5 if a side is empty. Ranks come from one
    aggregate over distinct scores, so equal scores do not meet in pairs."""
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("u"))
    wins = sums_below(counts, "s", [], "u", "below").withColumn("wins", F.col("p") * (F.col("below") + F.col("u") / 2.0))
    return wins.agg(F.sum("p").alias("n_positive"), F.sum("u").alias("n_other"), F.round(F.coalesce(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("u")), F.lit(0.5)), 6).alias("auc"))


def majority(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """item, verdict: the vote that more voters gave than any other, null on a tie."""
    n = votes.groupBy(item, vote).agg(F.count("*").alias("n"))
    w = Window.partitionBy(item)
    top = n.withColumn("most", F.max("n").over(w)).where("n = most")
    return top.groupBy(item).agg(F.when(F.count("*") == 1, F.first(vote)).alias("verdict"))


def splice(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows with the columns of updates put over those of equal key; keys that rows lack add nothing."""
    values = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("updated"))
    joined = rows.join(new, key, "left")
    return joined.select(*[F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def quota_sample(rows: DataFrame, bucket: list[str], order: Column, quota: int) -> DataFrame:
    """At most `quota` rows of each bucket, the first in the given (hash) order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*bucket).orderBy(order))).where(F.col("place") <= quota).drop("place")
