"""Measures of undirected weighted graphs given as edges (source, target, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import kept


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, weight: each edge from either end."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "weight"))


def nearest_layer(weight: Column, bases: list[float]) -> Column:
    """Number (from 1) of the base weight nearest to a weight, the first on ties."""
    gaps = F.array(*[F.abs(weight - F.lit(x)) for x in bases])
    return F.array_position(gaps, F.array_min(gaps))


def two_hops(edges: DataFrame) -> DataFrame:
    """a, b: every node, its neighbours and theirs, itself included."""
    e = both_ways(edges).select("a", "b")
    further = e.alias("x").join(e.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    return e.unionByName(further).unionByName(e.select("a", F.col("a").alias("b"))).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering: triangles are found from the end of lower degree, so hubs open few pairs."""
    e = both_ways(edges).select("a", "b").where("a <> b").distinct()
    degree = e.groupBy("a").agg(F.count("*").alias("degree"))
    d = e.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("degree").alias("degree_b")), "b")
    up = d.where("degree < degree_b OR (degree = degree_b AND a < b)").select("a", "b")
    wedge = up.alias("x").join(up.alias("y"), "a").where("x.b < y.b").select("a", F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = wedge.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("a")).groupBy("a").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    share = F.when(F.col("degree") > 1, 2 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degree.join(per, "a", "left").select(F.col("a").alias("node"), "degree", t.alias("triangles"), share.alias("clustering"))


def distances(edges: DataFrame, sources: DataFrame, scratch: str, most: int = 64) -> DataFrame:
    """source, node, steps: fewest steps from each source (column node) to all nodes it reaches, `most` at the furthest.

    A frontier join per step; each step's finds are written under `scratch`, a folder that all executors share."""
    spark = edges.sparkSession
    e = both_ways(edges).select("a", "b").distinct()
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("steps"))
    frontier = seen
    for step in range(1, most + 1):
        found = frontier.join(e, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti")
        path = f"{scratch}/step={step}"
        found.withColumn("steps", F.lit(step)).write.mode("overwrite").parquet(path)
        frontier = spark.read.parquet(path).select("source", "node", "steps")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, part of every end of an edge (source, target) and of `nodes` (node): part is the least node of its component.

    Each round every node takes the least part among its own, its neighbours' and what that part's node itself has taken,
    so that labels jump along chains; rounds grow as the logarithm of the longest chain in practice. What a round
    found is written, and the driver sees whether anything changed. Null ends take no part."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = kept(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    every = both.select(F.col("a").alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node").where("node IS NOT NULL"))
    parts = kept(every.distinct().withColumn("part", F.col("node")), "parts")
    while True:
        near = both.join(parts, F.col("b") == F.col("node")).groupBy("a").agg(F.min("part").alias("least")).withColumnRenamed("a", "node")
        taken = kept(parts.join(near, "node", "left").select("node", "part", F.least("part", "least").alias("next")), "taken")
        jump = taken.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = kept(taken.join(jump, "next").select("node", F.least("next", "further").alias("part"), (F.least("next", "further") != F.col("part")).alias("moved")), "moved")
        parts = moved.select("node", "part")
        if moved.where("moved").isEmpty():
            return parts


def path_lengths(edges: DataFrame) -> DataFrame:
    """steps, n_pairs: how many ordered pairs of different nodes lie `steps` apart, over all pairs that a path joins.

    Breadth-first from every node at once until nothing is new. A row holds the frontier of 64 sources at one node as the
    bits of a long; a step is one join with the edges. In an undirected graph what a step meets has been met in
    one of the last two steps or not at all, so two frontiers are all that is kept, however far the search goes."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = kept(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    numbered = kept(both.select(F.col("a").alias("node")).distinct().withColumn("i", F.monotonically_increasing_id()), "sources")
    now = kept(numbered.select("node", F.shiftright("i", 6).alias("team"), F.expr("shiftleft(1L, cast(i & 63 as int))").alias("bits")).groupBy("node", "team").agg(F.bit_or("bits").alias("bits")), "frontier")
    before, found, step = now.where("false"), [], 0
    while True:
        step += 1
        met = now.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node"), "team").agg(F.bit_or("bits").alias("met"))
        old = now.unionByName(before).groupBy("node", "team").agg(F.bit_or("bits").alias("old"))
        fresh = met.join(old, ["node", "team"], "left").select("node", "team", F.expr("met & ~coalesce(old, 0L)").alias("bits")).where("bits <> 0")
        before, now = now, kept(fresh, "frontier")
        n = now.agg(F.sum(F.bit_count("bits"))).collect()[0][0]
        if not n:
            break
        found.append((step, n))
    return edges.sparkSession.createDataFrame(found, "steps long, n_pairs long")
