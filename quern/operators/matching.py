"""Matching of targets to unused donors of nearest length, each pool for itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.tables import kept

#: Donors' places that meet a target as one group in the join.
BLOCK = 256
MATCHED = "pool string, target string, donor string, distance long, fit string"


def in_order(rows: DataFrame, order: list[str], counted: str) -> DataFrame:
    """rows with place: the sum of the 0/1 column `counted` over all rows before, in `order`. Key ranges are sorted and numbered
    apart, and only their totals, a row each, are summed in one task."""
    found = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order").withColumn("range", F.shiftright("at", 33))
    totals = found.groupBy("range").agg(F.sum(counted).alias("n"))
    totals = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.sum(counted).over(Window.partitionBy("range").orderBy("at")) - F.col(counted)
    return found.withColumn("inside", inside).join(F.broadcast(totals), "range").withColumn("place", F.col("before") + F.col("inside")).drop("at", "range", "inside", "before")


def length_matched_pools(targets: DataFrame, donors: DataFrame, excluded: DataFrame, caliper: float = 0.1, wide: float = 0.2) -> DataFrame:
    """MATCHED: each target's donor, in pools that share donors with one another but use each once.

    targets: pool, grp, name, length (names differ in a pool); donors: grp, name, length; excluded: pool, name of donors that a
    pool must not use. A pool takes its targets longest first, ties by name; each gets the unused donor of its grp whose
    length is nearest, ties to the one fewer places off in the order of (length, name), then to the one that is not shorter.
    fit: `close` within caliper of the target's length, `wide` within wide, else `far`; `none` where no donor is left, and
    then donor and distance are null. Rows with a null take no part.

    A pool of T targets and E excluded donors can only use donors among the T + E nearest to each of its targets, so these
    alone meet: donors are numbered by length, targets look up the places round theirs, and a pool's task holds 2 T (T + E)
    rows at most, however many donors there are.
    """
    t = targets.dropna().select(F.col("pool").cast("string").alias("pool"), "grp", F.col("name").cast("string").alias("name"), F.col("length").cast("long").alias("length"))
    d = donors.dropna().select(F.lit(None).cast("string").alias("pool"), "grp", F.col("name").cast("string").alias("name"), F.col("length").cast("long").alias("length"))
    both = in_order(t.withColumn("donor", F.lit(0)).unionByName(d.withColumn("donor", F.lit(1))), ["grp", "length", "donor", "name"], "donor")
    out = excluded.select(F.col("pool").cast("string").alias("pool"), F.col("name").cast("string").alias("name")).dropna().distinct()
    reach = t.groupBy("pool").agg(F.count("*").alias("t")).join(out.groupBy("pool").agg(F.count("*").alias("e")), "pool", "left")
    reach = reach.select("pool", (F.col("t") + F.coalesce("e", F.lit(0))).alias("reach"))
    wanted = both.where("donor = 0").select("pool", "grp", F.col("name").alias("target"), "length", "place").join(reach, "pool")
    low, high = F.col("place") - F.col("reach"), F.col("place") + F.col("reach") - 1
    blocks = F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK)))
    there = both.where("donor = 1").select("grp", F.col("name").alias("donor"), F.col("length").alias("has"), F.col("place").alias("theirs"), F.floor(F.col("place") / BLOCK).alias("block"))
    pairs = wanted.withColumn("block", blocks).join(there, ["grp", "block"]).where(F.col("theirs").between(low, high))
    pairs = pairs.join(out.withColumnRenamed("name", "donor"), ["pool", "donor"], "left_anti")
    off = F.when(F.col("theirs") >= F.col("place"), F.col("theirs") - F.col("place")).otherwise(F.col("place") - 1 - F.col("theirs"))
    pairs = pairs.select("pool", "target", "length", "donor", F.abs(F.col("has") - F.col("length")).alias("distance"), off.alias("off"), (F.col("theirs") < F.col("place")).alias("shorter"))
    lone = wanted.select("pool", "target", "length", F.lit(None).cast("string").alias("donor"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("long").alias("off"), F.lit(None).cast("boolean").alias("shorter"))

    def match(pool: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for (length, target), group in sorted(pool.groupby(["length", "target"]), key=lambda x: (-x[0][0], x[0][1])):
            near = group[group["donor"].notna() & ~group["donor"].isin(used)].sort_values(["distance", "off", "shorter"])
            if near.empty:
                rows.append((pool["pool"].iloc[0], target, None, None, "none"))
                continue
            donor, distance = near["donor"].iloc[0], int(near["distance"].iloc[0])
            used.add(donor)
            rows.append((pool["pool"].iloc[0], target, donor, distance, "close" if distance <= caliper * length else "wide" if distance <= wide * length else "far"))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHED.split(", ")]).astype({"distance": "Int64"})

    return pairs.unionByName(lone).groupBy("pool").applyInPandas(match, MATCHED)
