"""Exact dense retrieval: a stated set of queries against all vectors, block by block as matrix products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.tables import kept

#: Vectors a block holds on average, of all vectors and of queries. A product of two blocks has 8 million scores, of which a task
#: holds about SCORES at a time.
VECTORS, QUERIES, SCORES = 16384, 512, 2**20
#: What stands for a missing label inside a block, on either side, so that missing ones are never equal.
NO_LABEL, NO_WANTED = -(2**63), -(2**63) + 1
PACK = "block long, ids binary, labels binary, vectors binary"


def _packed(vectors: DataFrame, size: int, missing: int) -> tuple[DataFrame, int]:
    """Blocks of about `size` vectors as a row each, and how many there may be. Vectors are dealt out by a hash of their ids."""
    n = -(-vectors.count() // size)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part["vector"].to_list()).astype(np.float64)
        return pd.DataFrame({"block": [key[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "labels": [part["label"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", F.coalesce(F.col("label").cast("long"), F.lit(missing)).alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).alias("block")).applyInPandas(pack, PACK), max(n, 1)


def scored_blocks(vectors: DataFrame, queries: DataFrame, reused: bool = False) -> DataFrame:
    """Every block of queries beside every block of vectors (id, label, vector in both), packed, for best() and gold_ranks().

    All vectors move once. Queries are packed once and sent to each block of vectors, in blocks, so that a task holds two
    blocks and a part of their product at a time. With `reused` blocks are written once, for
    those who read them more than once. Null ids and null vectors take no part, a null label equals none; all other vectors must be of one length.
    """
    v, n = _packed(vectors, VECTORS, NO_LABEL)
    q, _ = _packed(queries, QUERIES, NO_WANTED)
    q = q.select(F.col("block").alias("q_block"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "labels", "vectors")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    if reused:
        v, q = kept(v, "blocks"), kept(q, "queries")
    return v.join(q, "block")


def _products(blocks: DataFrame, digest: Callable, shape: str) -> DataFrame:
    """digest(row, questions, wanted labels, ids, labels, scores) of each pair of blocks, a few queries at a time; a vector never
    meets itself."""

    def product(pair: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in pair.to_dict("records"):
            asked, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            wanted, labels = np.frombuffer(row["q_labels"], np.int64), np.frombuffer(row["labels"], np.int64)
            a, b = np.frombuffer(row["q_vectors"]).reshape(len(asked), -1), np.frombuffer(row["vectors"]).reshape(len(ids), -1)
            step = max(1, SCORES // len(ids))
            for some in (slice(i, i + step) for i in range(0, len(asked), step)):
                scores = a[some] @ b.T
                np.round(scores, 6, out=scores)
                scores[asked[some, None] == ids[None, :]] = -np.inf
                found.append(digest(row, asked[some], wanted[some], ids, labels, scores))
        return pd.concat(found)

    return blocks.groupBy("block", "q_block").applyInPandas(product, shape)


def best(blocks: DataFrame, k: int) -> DataFrame:
    """question_id, doc_id, wanted, label, score, rank: the k vectors of greatest inner product (rounded to 6 places) with each
    query but itself, ties to the smaller id. Each pair of blocks gives its k best, ties of the last one included."""

    def digest(row, asked, wanted, ids, labels, scores):
        last = min(k, len(ids))
        least = np.partition(scores, len(ids) - last, axis=1)[:, len(ids) - last]
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        return pd.DataFrame({"question_id": asked[i], "doc_id": ids[j], "wanted": wanted[i], "label": labels[j], "score": scores[i, j]})

    found = _products(blocks, digest, "question_id long, doc_id long, wanted long, label long, score double")
    found = found.withColumns({"label": F.nullif("label", F.lit(NO_LABEL)), "wanted": F.nullif("wanted", F.lit(NO_WANTED))})
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def gold_ranks(blocks: DataFrame, k: int) -> DataFrame:
    """question_id, n, n_gold, n_found (gold among the k best), first_gold: the rank of the best vector of the query's label.

    No pair is sorted: a first pass finds each query's best gold vector, a second one counts the vectors above it."""

    def first(row, asked, wanted, ids, labels, scores):
        gold = (wanted[:, None] == labels[None, :]) & (scores > -np.inf)
        top = np.where(gold, scores, -np.inf).max(axis=1)
        tied = gold & (scores == top[:, None])
        place = np.where(tied, ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        return pd.DataFrame({"question_id": asked, "n": (scores > -np.inf).sum(axis=1), "n_gold": gold.sum(axis=1), "score": top, "doc_id": place})

    held = kept(_products(blocks, first, "question_id long, n long, n_gold long, score double, doc_id long"), "gold")
    nearest = F.min(F.when(F.col("n_gold") > 0, F.struct((-F.col("score")).alias("less"), "doc_id")))
    goals = held.groupBy("question_id").agg(F.sum("n").alias("n"), F.sum("n_gold").alias("n_gold"), nearest.alias("g"))

    def above(row, asked, wanted, ids, labels, scores):
        at = {q: i for i, q in enumerate(row["goals"]["ids"])}
        goal = np.array([row["goals"]["scores"][at[q]] if q in at else np.inf for q in asked])
        place = np.array([row["goals"]["places"][at[q]] if q in at else -1 for q in asked])
        return pd.DataFrame({"question_id": asked, "above": ((scores > goal[:, None]) | ((scores == goal[:, None]) & (ids[None, :] < place[:, None]))).sum(axis=1)})

    q = blocks.select("q_block", "q_ids").dropDuplicates(["q_block"])
    dealt = q.groupBy("q_block").applyInPandas(lambda p: pd.DataFrame({"q_block": p["q_block"].iloc[0], "question_id": np.frombuffer(p["q_ids"].iloc[0], np.int64)}), "q_block long, question_id long")
    lists = dealt.join(goals.where("g IS NOT NULL"), "question_id").groupBy("q_block").agg(F.struct(*[F.transform(F.array_sort(F.collect_list(F.struct("question_id", (-F.col("g.less")).alias("score"), F.col("g.doc_id").alias("doc_id")))), f).alias(name) for name, f in (("ids", lambda x: x["question_id"]), ("scores", lambda x: x["score"]), ("places", lambda x: x["doc_id"]))]).alias("goals"))
    counted = _products(blocks.join(lists, "q_block"), above, "question_id long, above long").groupBy("question_id").agg((F.sum("above") + 1).alias("first_gold"))
    found = best(blocks, k).where("wanted = label").groupBy("question_id").agg(F.count("*").alias("n_found"))
    g = goals.join(counted, "question_id", "left").join(found, "question_id", "left")
    return g.select("question_id", "n_gold", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.when(F.col("n_gold") > 0, F.col("first_gold")).alias("first_gold"), "n")
