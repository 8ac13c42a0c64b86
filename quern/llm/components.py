"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: Edges that a task replaces at a time by the fewest that link the same nodes.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b: long, none null); root is the component's least node.

    Edges are dealt to tasks of about EDGES each, which replace theirs by stars; where one task holds them all, that is
    the result. Then alternating stars: each round hangs every node under the least node it sees, first for greater
    neighbours, then for smaller ones, until each node hangs under one node that hangs under none. Rounds grow as the
    logarithm of the size; only the edges are written, in the shared folder, and the driver sees one row per round.
    The edges are read twice. No edges: no rows.
    """
    tasks = -(-edges.count() // EDGES) or 1
    stars = edges.select("a", "b").coalesce(tasks).mapInPandas(_stars_of_batches, "a long, b long")
    stars = written(stars if tasks == 1 else stars.distinct(), "edges")
    while tasks > 1 and not _are_stars(stars):
        ends = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least, "least")  # apart from its aggregate, a join can be split where one node is hot
        large = ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        stars = written(small, "small")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of a task's edges, about EDGES of them at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= EDGES:
            yield _stars(pd.concat(held))
            held, n = [], 0
    if held:
        yield _stars(pd.concat(held))


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    """What links the same nodes as edges: each node but the least of its component, under that one."""
    nodes, ends = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # all ends are roots: each hangs under the least it sees
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    under = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[under], "b": nodes[root[under]]})


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under at most one, and those that others hang under hang under none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
