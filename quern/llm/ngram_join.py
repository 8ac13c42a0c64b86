"""N-gram Jaccard join: a MinHash forest of sorted prefix tries finds candidates from the deepest prefixes up, word shingles verify them exactly."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import whole_row, written
from quern.llm.components import components

#: Shingles whose minima are taken at a time, and the sets and shingles that one verified block holds of either side.
CHUNK, SETS, SHINGLES = 200_000, 700, 600_000
#: Columns of shared shingles multiplied at a time; shingles in fewer sets are counted pair by pair.
COLUMNS, FEW = 2048, 12
#: Permutations of a tree, each a byte of its labels: the deepest prefix.
DEEPEST = 8


def forest_depth(threshold: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of just the threshold's similarity meets in one of the trees with the wanted
    probability: prefixes are shortened from `deepest` on until 1 - (1 - threshold^depth)^trees reaches it."""
    return next((d for d in range(deepest, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def least_similarity(n: int, threshold: Fraction) -> Fraction | None:
    """The least similarity, from the threshold on, that a set of n shingles can have with a different set; None if there is none.

    With c common shingles the union holds u >= n, u > c, and c / u is least for the greatest u that the threshold allows.
    """
    found = [Fraction(c, u) for c in range(1, n + 1) if (u := int(c / threshold)) >= max(n, c + 1)]
    return min(found, default=None)


def lone_sizes(threshold: Fraction) -> list[int]:
    """The numbers of shingles, from 1 on, of sets that link with no other set."""
    return [n for n in range(1, int(1 / (1 - threshold)) + 1) if least_similarity(n, threshold) is None]


def measured_recall(links: int, once: int, twice: int) -> float:
    """Share of all links found, from how many of them meet in one tree only and how many in two (Chao's estimate of unseen ones)."""
    return links / (links + once * (once - 1) / (2 * (twice + 1))) if links else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of n words, one after another, and how many each text has.

    A text of fewer words has one shingle of all its words; a text without words (or null) has none.
    """
    import xxhash

    split = [x.encode("utf-8", "surrogatepass").split() if x else [] for x in texts]
    flat = [x for words in split for x in words]
    hashed = {x: xxhash.xxh3_64_intdigest(x) for x in set(flat)}
    words = np.fromiter(map(hashed.__getitem__, flat), np.uint64, len(flat))
    sizes = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    at = np.arange(len(words))
    owner = np.repeat(np.arange(len(texts)), sizes)
    room = starts[owner] + sizes[owner] - at  # words from here to the text's end
    code = np.zeros(len(words), np.uint64)
    for j in range(n):
        code = _mixed(code + np.where(j < room, padded[at + j], 0).astype(np.uint64) + np.uint64(j + 1))
    whole = (room >= n) | ((sizes[owner] < n) & (at == starts[owner]))
    code, owner = code[whole], owner[whole]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)]
    return code[new], np.bincount(owner[new], minlength=len(texts))


def labels(codes: np.ndarray, sizes: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One long per set and tree: a byte of the least shingle hash for each of `depth` permutations, the first on top."""
    found = np.zeros((len(sizes), trees), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return found.astype(np.int64)
    starts = (np.cumsum(sizes) - sizes)[some]
    x = (codes >> np.uint64(32)).astype(np.uint32)
    random = np.random.default_rng(20_240_601)
    masks, factors = random.integers(0, 1 << 32, (trees, depth), np.uint32), random.integers(0, 1 << 31, (trees, depth), np.uint32) * np.uint32(2) + np.uint32(1)
    for tree in range(trees):
        for k in range(depth):
            least = np.minimum.reduceat((x ^ masks[tree, k]) * factors[tree, k], starts)
            byte = (least ^ (least >> np.uint32(8)) ^ (least >> np.uint32(16)) ^ (least >> np.uint32(24))) & np.uint32(255)
            found[some, tree] |= byte.astype(np.uint64) << np.uint64(56 - 8 * k)
    return found.view(np.int64)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK words each; a text is never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") // 6
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shared(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The matrix of intersection sizes of the sets."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    row, code = row[order], codes[order]
    new = np.append(True, code[1:] != code[:-1])[: len(code)]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] if len(column) else column
    both = np.zeros((n, n), np.float32)
    rare = (often > 1) & (often <= FEW)
    r, c = row[rare], column[rare]
    for step in range(1, FEW):
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else []
        if len(same):
            both += np.bincount(r[same] * n + r[same + step], minlength=n * n).reshape(n, n).astype(np.float32)
    both += both.T
    r, c = row[often > FEW], column[often > FEW]
    if len(c):
        c = np.unique(c, return_inverse=True)[1]
        for low in range(0, int(c[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(c, (low, low + COLUMNS))
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[r[a:b], c[a:b] - low] = 1
            both += dense @ dense.T
    return both


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meetings(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each prefix length, from 1 on: links of (a, b) that meet in a tree, in just one, and in just two."""
    found = np.zeros((DEEPEST, 3), np.int64)
    for low in range(0, len(a), 1 << 15):
        apart = labels.view(np.uint64)[a[low : low + (1 << 15)]] ^ labels.view(np.uint64)[b[low : low + (1 << 15)]]
        for depth in range(1, DEEPEST + 1):
            trees = (apart >> np.uint64(64 - 8 * depth) == 0).sum(axis=1)
            found[depth - 1] += (trees > 0).sum(), (trees == 1).sum(), (trees == 2).sum()
    return found


def _verified(block: pd.DataFrame, first: int, second: int, threshold: Fraction, tree: int, shift: int) -> pd.DataFrame:
    """New links of one block's sets: between its two parts, or inside its one part, but for those of one `done` group.
    tree: where the block's sets meet, -1 if all its pairs count; else those count that meet in no earlier tree, so that
    each pair counts once. The first row tells in `met` how the links meet (see _meetings())."""
    block = block.drop_duplicates("sid").sort_values("sid", ignore_index=True)
    sizes, done = block["n_shingles"].to_numpy(), block["done"].to_numpy()
    both = shared(np.frombuffer(b"".join(block["shingles"]), np.uint64), sizes)
    union = sizes[:, None] + sizes[None, :] - both.astype(np.int64)
    linked = both.astype(np.int64) * threshold.denominator >= union * threshold.numerator
    linked &= done[:, None] != done[None, :]
    if first != second:
        part = block["part"].to_numpy()
        linked &= part[:, None] != part[None, :]
    label = np.array(block["labels"].tolist(), np.int64)
    if tree > 0 and linked.any():
        prefix = label >> shift
        a, b = np.nonzero(linked)
        linked[a, b] = (prefix[a, :tree] != prefix[b, :tree]).all(axis=1)
    some = np.flatnonzero(linked.any(axis=1))
    sid = block["sid"].to_numpy()[some]
    found = pd.DataFrame({"sid": sid, "links": (linked @ block["n_rows"].to_numpy())[some], "root": block["sid"].to_numpy()[_roots(linked)[some]] if len(some) else sid})
    a, b = np.nonzero(np.triu(linked))
    met = [len(a), *map(int, _meetings(label, a, b).ravel())]
    found["met"] = pd.Series([met if i == 0 else None for i in range(len(found))], dtype=object)
    return found


def _blocks_verified(blocks: DataFrame, threshold: Fraction, shift: int) -> DataFrame:
    """sid, links, root, met of the new links of all blocks; a block is the rows of one (at, tree, i, j)."""

    def ended(key: tuple, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return _verified(pd.concat(parts), key[2], key[3], threshold, key[1], shift)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a block ends where the key changes."""
        key, parts = None, []
        for batch in batches:
            keys = batch[["at", "tree", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high == low:
                    continue
                if key is not None and tuple(keys[low]) != key:
                    yield ended(key, parts)
                    parts = []
                key = tuple(keys[low])
                parts.append(batch.iloc[low:high])
        if parts:
            yield ended(key, parts)

    blocks = blocks.select("at", "tree", "i", "j", "part", "sid", "done", "n_rows", "labels", "n_shingles", "shingles")
    blocks = blocks.repartition("at", "tree", "i", "j").sortWithinPartitions("at", "tree", "i", "j")
    return written(blocks.mapInPandas(verify, "sid long, links long, root long, met array<long>"), "links")


def _prefix(depth: int) -> Column:
    """The trie node of a label: its tree and its first `depth` bytes."""
    return F.xxhash64("tree", F.shiftrightunsigned("label", 64 - 8 * depth))


def _tries(sets: DataFrame, lone: list[int], depth: int) -> DataFrame:
    """sid, tree, label: the sorted labels of all trees, but for those whose first `depth` bytes no other set has, and for
    sets that can link with no other. Equal prefixes lie together, so their groups are combined where they lie."""
    every = sets.where(~F.col("n_shingles").isin(lone)).select("sid", F.posexplode("labels").alias("tree", "label")).withColumn("node", _prefix(depth))
    met = every.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    found = every.join(written(met, "nodes"), "node", "left_semi").select("sid", "tree", "label")
    return written(found.repartitionByRange("tree", "label", "sid").sortWithinPartitions("tree", "label", "sid"), "tries")


def _merged(tries: DataFrame, teams: DataFrame, depth: int) -> DataFrame | None:
    """team, root: the teams of sets that meet at prefixes of `depth` bytes, under their new name; None if none meet."""
    nodes = tries.join(teams.select("sid", "team"), "sid").select("team", _prefix(depth).alias("node"))
    joint = nodes.groupBy("node").agg(F.min("team").alias("m"), F.max("team").alias("n")).where("m < n").select("node", "m")
    joint = written(joint, "joint")  # apart from its aggregate, a join can be split where one node is hot
    edges = written(nodes.join(joint, "node").where("team <> m").select(F.col("team").alias("a"), F.col("m").alias("b")).distinct(), "meetings")
    return None if edges.isEmpty() else written(components(edges).select(F.col("node").alias("team"), "root"), "roots")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, trees: int = 24, recall: float = 0.9999, levels: list[dict] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_shingles, code (a hash of the text), class_key (one per class).

    Two rows are linked if the Jaccard similarity of their sets of n-word shingles is at least `threshold` (words are
    runs of anything but ASCII white space, compared as they are; shingles are compared by 64-bit hashes). n_links counts
    a row's linked rows, copies included; class_id is the least doc_id that links lead to, its own without links. Rows
    without words link with nothing and have their own doc_id for class_id. Repeated rows are copies of each other. Rows
    with a null doc_id take part; a class of only such rows has a null class_id. No rows give no rows.

    Rows with the same shingles become one set. Each set gets a label per tree, and a tree's sorted labels are a prefix
    trie. Sets that share prefixes of DEEPEST bytes make teams, which are verified exactly. How the links found meet at
    each shorter prefix then tells how far to shorten: to the longest prefix at which a pair of just the threshold's
    similarity has the wanted `recall` (see forest_depth()) and at which the recall measured on the links found reaches it
    too (see measured_recall()). Teams that meet there are joined and their new pairs verified, until what is found then
    needs no shorter prefix. Sets so small that no other set can be similar enough stay out. A team too large to verify in one
    piece waits for the last prefixes and is verified prefix by prefix, large prefixes in blocks, so that no task
    holds more than two blocks and no pair becomes a row. Every pair of a verified block is compared, so a link is only
    lost if its sets share no prefix in any tree. `levels`, if given, gets a dict per prefix length used: its links so far,
    how many of them meet there in a tree, and the measured recall.
    """
    limit = Fraction(str(threshold))
    goal, lone = forest_depth(threshold, trees, recall), lone_sizes(limit)
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("code"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high in _chunks(batch["text"].tolist()):
                codes, sizes = shingle_sets(batch["text"].iloc[low:high].tolist(), n)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                for total, x in zip(sums, (codes, _mixed(codes ^ np.uint64(0x9E3779B97F4A7C15))), strict=True):
                    np.add.at(total, owner, x)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[low:high].astype("Int64").to_numpy(), "code": batch["code"].iloc[low:high].to_numpy(), "fp1": sums[0].view(np.int64), "fp2": sums[1].view(np.int64), "n_shingles": sizes.astype(np.int64), "labels": list(labels(codes, sizes, trees, DEEPEST))})

    rows = written(table.mapInPandas(sets, "doc_id long, code long, fp1 long, fp2 long, n_shingles long, labels array<long>"), "rows")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code"))
    distinct = rows.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(head.alias("head"), F.count("*").alias("n_rows"), F.max("labels").alias("labels"))
    distinct = distinct.select("fp1", "fp2", "n_shingles", F.col("head.doc_id").alias("rep"), F.xxhash64("head.doc_id", "head.code").alias("at"), "n_rows", "labels")
    distinct = written(distinct.withColumn("sid", F.monotonically_increasing_id()), "sets")
    names = ["sid", "fp1", "n_rows", "labels"]

    def reread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high in _chunks(batch["text"].tolist()):
                part = batch.iloc[low:high]
                codes, sizes = shingle_sets(part["text"].tolist(), n)
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = np.zeros(len(sizes), np.uint64)
                np.add.at(sums, owner, codes)
                part = part.assign(n_shingles=sizes, shingles=[codes[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)])
                yield part[(sums.view(np.int64) == part["fp1"].to_numpy())].drop(columns=["fp1", "text"])

    def shingles_of(some: DataFrame) -> DataFrame:
        """The sets of `some` (sid) with their shingles, from one text each."""
        wanted = distinct.join(some, "sid", "left_semi").select("at", *names)
        texts = table.select(F.xxhash64("doc_id", "code").alias("at"), "text").groupBy("at").agg(F.first("text").alias("text"))
        shape = "sid long, n_rows long, labels array<long>, n_shingles long, shingles binary"
        return written(texts.join(wanted, "at").select(*names, "text").mapInPandas(reread, shape), "shingles")

    depth, found = DEEPEST, []
    tries = _tries(distinct, lone, goal)
    held = shingles_of(tries.select("sid").distinct())
    teams = held.select("sid", "n_shingles", F.col("sid").alias("team"), F.col("sid").alias("done"))
    while True:
        if depth < goal:  # the measured recall falls short: sets that met none before come in
            tries = _tries(distinct, lone, depth)
            held = shingles_of(tries.select("sid").distinct())
            teams = held.select("sid", "n_shingles").join(teams.drop("n_shingles"), "sid", "left").select("sid", "n_shingles", F.coalesce("team", "sid").alias("team"), F.coalesce("done", "sid").alias("done"))
        roots = _merged(tries, teams, depth)
        if roots is not None:
            grown = teams.join(roots, "team").select("sid", "n_shingles", F.col("root").alias("team"), "done")
            sizes = grown.groupBy("team").agg(((F.count("*") <= SETS) & (F.sum("n_shingles") <= SHINGLES)).alias("small"))
            grown = written(grown.join(sizes, "team"), "grown")
            one = grown.where("small").select("sid", "team", "done").join(held, "sid")
            one = one.select("*", F.col("team").alias("at"), F.lit(-1).alias("tree"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"))
            found.append(_blocks_verified(one, limit, 64 - 8 * depth))
            changed = grown.select("sid", F.col("team").alias("root"), F.when(F.col("small"), F.col("team")).otherwise(F.col("done")).alias("now"))
            teams = teams.join(changed, "sid", "left").select("sid", "n_shingles", F.coalesce("root", "team").alias("team"), F.coalesce("now", "done").alias("done"))
            teams = written(teams, "teams")
        met = _link_counts(found)
        measured = [measured_recall(*met[3 * d - 2 : 3 * d + 1]) for d in range(1, DEEPEST + 1)]
        if levels is not None:
            levels.append({"prefix": depth, "links": met[0], "meeting": met[3 * depth - 2], "recall": measured[depth - 1]})
        wanted = next((d for d in range(goal, 1, -1) if measured[d - 1] >= recall), 1)
        if depth <= wanted:
            break
        depth = wanted

    sizes = teams.groupBy("team").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).where((F.col("n") > SETS) | (F.col("m") > SHINGLES)).where("n > 1").select("team")
    large = written(teams.join(sizes, "team").select("sid", "done"), "large")
    large = tries.select("sid", "tree", _prefix(depth).alias("node")).join(large, "sid").join(held.select("sid", "n_shingles"), "sid")
    per = large.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n_shingles") / SHINGLES)).cast("int").alias("parts"), F.count("*").alias("n_sets")).where("n_sets > 1").drop("n_sets")
    per = written(per, "per")
    large = large.drop("n_shingles").join(per, "node").withColumn("part", F.pmod(F.xxhash64("sid"), "parts").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(held, "sid")
    large = large.select("*", F.col("node").alias("at"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    found.append(_blocks_verified(large, limit, 64 - 8 * depth))

    found = reduce(DataFrame.unionByName, found)
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("sid"), "root")
    known = distinct.select("sid", "fp1", "fp2", "n_shingles", "rep", "n_rows").join(roots, "sid", "left").join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(least, "root").select("fp1", "fp2", "n_shingles", "class_id", F.col("root").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"))
    some = rows.where("n_shingles > 0").select("doc_id", "code", "fp1", "fp2", "n_shingles").join(known, ["fp1", "fp2", "n_shingles"]).select("doc_id", "class_id", "n_links", "n_shingles", "code", "class_key")
    return some.unionByName(rows.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", "code", F.lit(None).cast("long").alias("class_key")))


def _link_counts(found: list[DataFrame]) -> list[int]:
    """Sums of the blocks' `met` over all links found so far: a number for links, then three for each prefix length."""
    if not found:
        return [0] * (3 * DEEPEST + 1)
    met = reduce(DataFrame.unionByName, found).where("met IS NOT NULL").select("met")
    return [x or 0 for x in met.agg(*[F.sum(F.get("met", F.lit(i))) for i in range(3 * DEEPEST + 1)]).first()]


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The row of docs of least doc_id of each class (null last, ties by a hash of the text); rows without words all stay.
    Of rows that repeat doc_id and text one stays, the first by its columns as JSON."""
    found = near_classes(docs, doc_id, text, **how)
    least = found.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "code")).alias("m"))
    heads = least.select("m.doc_id", "m.code").unionByName(found.where("class_key IS NULL").select("doc_id", "code")).select(F.col("doc_id").alias("head"), "code").distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_code"))
    rows = rows.join(heads, F.col("id").eqNullSafe(F.col("head")) & (F.col("text_code") == F.col("code")), "left_semi")
    others = F.to_json(F.struct(*[F.col("row")[x].alias(x) for x in docs.columns if x != text]))
    first = F.row_number().over(Window.partitionBy("id", "text_code").orderBy(others))
    return rows.withColumn("first", first).where("first = 1").select("row.*")


#: DuckDB SQL for near_classes() over documents with unique doc_ids, without code and class_key.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
