"""Exact top-k search by inner product: segment means and deviations bound scores, coarse to fine, before exact ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a pack; candidates that a bucket holds on average; queries whose bounds are held at once.
PACK, BUCKET, HELD = 2048, 65536, 128
#: Segments at each resolution; bounds of a level are worked out for what the levels before have left.
LEVELS = (4, 16, 32)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a long, in doubles; null if the vector is, or a component is null or not finite."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(x.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the segments that the components fall into, and their means and deviations in each row."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    starts, lengths = edges[:-1], np.diff(edges)
    mean = np.add.reduceat(x, starts, axis=1) / lengths
    spread = np.sqrt(np.maximum(np.add.reduceat(x * x, starts, axis=1) / lengths - mean * mean, 0))
    return lengths, mean, spread


def bounds(queries: np.ndarray, rows: np.ndarray, segments: int) -> np.ndarray:
    """Upper bounds on the inner products.

    In a segment of length l the squared distance of two vectors is at least l times the squared differences of their
    means and of their deviations; with |q - v|^2 = |q|^2 + |v|^2 - 2 q.v that is q.v <= l (mean mean' + dev dev').
    """
    lengths, mean, spread = segment_statistics(queries, segments)
    _, mean2, spread2 = segment_statistics(rows, segments)
    found = np.hstack([mean * lengths, spread * lengths]) @ np.hstack([mean2, spread2]).T
    return found + 1e-9 * np.abs(found) + 1e-3  # more than what rounding takes away


def alive(part: np.ndarray, rough: np.ndarray, own: np.ndarray, score, k: int) -> Iterator[np.ndarray]:
    """After each level, which rows may be among each query's best k; own rows are none of them. score(i, at) gives exact scores.

    A query's threshold is the k-th best exact score of the rows whose coarsest bounds are highest.
    """
    bound = bounds(part, rough, LEVELS[0])
    bound[own] = -np.inf
    few = min(len(rough), 4 * k)
    least = np.full(len(part), -np.inf)
    for i, at in enumerate(np.argpartition(-bound, few - 1, axis=1)[:, :few]):
        at = at[~own[i, at]]
        if len(at) >= k:
            least[i] = np.sort(score(i, at).astype(np.float64))[-k]
    least -= 1e-3 + 1e-9 * np.abs(least)
    left = (bound >= least[:, None]) & ~own
    yield left
    for segments in LEVELS[1:]:
        if left.mean() > 0.05:
            left &= bounds(part, rough, segments) >= least[:, None]
        else:
            for i in range(len(part)):
                at = np.flatnonzero(left[i])
                if len(at):
                    left[i, at] = bounds(part[i : i + 1], rough[at], segments)[0] >= least[i]
        yield left


def exact_kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """Numbers in which sums of products stay exact."""
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    return np.float64 if high < 2**52 else np.int64 if high < 2**62 else object


def survivors(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[float]:
    """The share of pairs of a query and another row that each level leaves."""
    kind = exact_kind(queries, rows)
    own = query_ids[:, None] == ids[None, :]
    left = alive(queries.astype(np.float64), rows.astype(np.float64), own, lambda i, at: rows[at].astype(kind) @ queries[i].astype(kind), k)
    return [float(x.sum() / max(1, (~own).sum())) for x in left]


def top_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best k rows of the block but its own, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    kind = exact_kind(queries, rows)
    rough = rows.astype(np.float64)
    exact_rows, exact_queries = rows.astype(kind), queries.astype(kind)
    for low in range(0, len(queries), HELD):
        part = queries[low : low + HELD].astype(np.float64)
        own = query_ids[low : low + HELD, None] == ids[None, :]
        score = lambda i, at, low=low: exact_rows[at] @ exact_queries[low + i]
        for left in alive(part, rough, own, score, k):
            pass
        for i in range(len(part)):
            at = np.flatnonzero(left[i])
            scores = score(i, at)
            best = np.argsort(-scores, kind="stable")[:k]
            yield int(query_ids[low + i]), ids[at[best]], scores[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer inner products of every query's vector with the
    vectors of other rows, all if there are fewer, ties to smaller vec_id.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null vec_id.
    Vectors of different lengths do not meet. Rows that repeat a query's vec_id are its own; other repeated rows count
    each. A query without other vectors has no rows. Scores are exact (components whose products leave the range of a
    long raise an error when the result is written).

    Vectors are packed where they lie, in two bytes a component where these fit. Candidates are dealt into buckets of about
    BUCKET and move once; the queries, a small share of the rows, are what is sent to every bucket, where their packs
    stream past the candidates that the task holds. A bucket gives k rows a query, and a ranking merges them.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).withColumn("dim", F.size("v"))
    buckets = max(math.ceil(rows.count() / BUCKET), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        count, held = TaskContext.get().partitionId() * 7919, {}
        for batch in chain(batches, [None]):
            if batch is not None:
                for dim, group in batch.groupby("dim"):
                    held.setdefault(int(dim), []).append(group)
            for dim, groups in list(held.items()):
                n = sum(map(len, groups))
                if n and (batch is None or n >= PACK):
                    table = pd.concat(groups, ignore_index=True)
                    held[dim] = []
                    for low in range(0, n, PACK):
                        cut = table.iloc[low : low + PACK]
                        data = np.array(cut["v"].tolist(), np.int64)
                        short = np.abs(data).max() < 2**15
                        yield pd.DataFrame({"deal": [count], "dim": [dim], "width": [2 if short else 8], "ids": [cut["id"].to_numpy(np.int64).tobytes()], "data": [data.astype(np.int16 if short else np.int64).tobytes()]})
                        count += 1

    shape = "deal long, dim int, width int, ids binary, data binary"
    packed = rows.select("id", "dim", "v").mapInPandas(pack, shape).withColumn("bucket", F.pmod("deal", F.lit(buckets))).withColumn("asked", F.lit(False))
    asked = rows.where("q").select("id", "dim", "v").mapInPandas(pack, shape).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).withColumn("asked", F.lit(True))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs come sorted by bucket and dimension, candidates before queries."""
        key, ids, data = None, [], []
        for batch in batches:
            for x in batch.itertuples():
                vectors = np.frombuffer(x.data, np.int16 if x.width == 2 else np.int64).reshape(-1, x.dim).astype(np.int64)
                if key != (x.bucket, x.dim):
                    key, ids, data = (x.bucket, x.dim), [], []
                if not x.asked:
                    ids.append(np.frombuffer(x.ids, np.int64))
                    data.append(vectors)
                elif data:
                    if len(data) > 1:
                        ids, data = [np.concatenate(ids)], [np.concatenate(data)]
                    found = list(top_of_block(np.frombuffer(x.ids, np.int64), vectors, ids[0], data[0], k))
                    counts = [len(y[1]) for y in found]
                    yield pd.DataFrame({"query_id": np.repeat([y[0] for y in found], counts).astype(np.int64), "vec_id": np.concatenate([y[1] for y in found]), "score": np.concatenate([y[2] for y in found]).astype(np.int64)})

    both = packed.unionByName(asked).drop("deal").repartition(buckets, "bucket", "dim").sortWithinPartitions("bucket", "dim", "asked")
    near = both.select("bucket", "dim", "width", "ids", "data", "asked").mapInPandas(cells, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for top_k() over embeddings, queries being the vec_ids divisible by 50.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
