"""Mixing sources to target weights: hash-random order inside each source, cut where its running sum meets its budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import prefix_before, whole_row, word_count

#: Rows that one key range of a source holds on average; ranges, not sources, are sorted in one task.
RANGE_ROWS = 2_000


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3) -> DataFrame:
    """One row per source of (source, size): place, source, source_size, n_rows, target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by them. No target
    exceeds `limit` times its source's size: what a source cannot take, the others share by weight. With a level L such
    that the targets min(limit * size, L * weight) add up to the whole, L is the greatest of the levels that follow if
    the first k sources, by limit * size / weight, stand at their limits. No rows give no sources.
    """
    total = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    total = total.withColumn("place", F.row_number().over(names))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    total = total.withColumn("weight", weight).withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("place"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) - full) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return total.select("place", "source", "source_size", "n_rows", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (1, 2, 3), limit: float = 3, seed: str = "mix") -> DataFrame:
    """Struct `row` (docs' columns) of every row, size, source_size, target, taken: how much of it the mix takes.

    A source's budget is its target, rounded. The source is taken whole as often as the budget allows; the rest is cut
    off its rows in the order of a hash of (seed, doc_id), then doc_id, then size, so that its taken sizes add up to the
    budget; the row at the cut gives a part. Null sizes count as 0, null sources are one source, null doc_ids have an
    order too. Repeated rows are taken each for itself (which of them is cut does not show). No rows give no rows.

    The hash is uniform, so equal ranges of it are equal shares of a source: each source has as many ranges as its rows
    need, ranges are sorted each for itself, and only their totals are summed up per source.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    targets = source_targets(rows.select("source", "size"), weights, limit)
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.select("place", F.col("source").alias("name"), "source_size", "target", passes.alias("passes"), (budget - passes * F.col("source_size")).alias("rest"), F.ceil(F.col("n_rows") / RANGE_ROWS).alias("ranges"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("key", key).join(targets, F.col("source").eqNullSafe(F.col("name")))
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 29) * F.col("ranges"), 31))
    rows = prefix_before(rows, ["place"], "range", ["key", "id", "size"], "size", "before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("row", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix as rows of docs, with text sizes in words: each row as often as it is taken whole, then, where the cut
    goes through it, once more with its text up to the cut. Rows without words give nothing and go."""
    found = mix(docs, word_count(F.col(text)), doc_id, source, **how).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    taken = found.withColumn("n", F.explode(copies))
    cut = F.when(F.col("n") == F.col("size"), F.col("row")[text]).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("n").cast("int")), ""))
    return taken.select(*[cut.alias(x) if x == text else F.col("row")[x].alias(x) for x in docs.columns])


#: DuckDB SQL for mix() over documents, sizes in words, with the default weights, limit and seed.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, (SELECT max(level) FROM l) * weight) AS target FROM l),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, b.passes,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('mix:' || d.doc_id), 1, 15))::BIGINT, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken FROM r
"""
