"""Overlap of each text with all others of its group, from n-gram counts alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Fixed value: what stands for no match at all in the precision of one length (BLEU's first smoothing method).
EPSILON = 0.1
#: Words whose n-grams a task holds at a time (a block), and n-grams that meet in one part on average.
WORDS, GRAMS = 1_000_000, 4_000_000
#: Bytes of an n-gram's second hash that move with its first one.
MORE = 2
#: Fixed value: stands in front of each word of a text.
MARK = "\1"
#: Multipliers of two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which hangs on all of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order by (a, b) that leaves equal rows as they lie."""
    order = np.argsort(a, kind="stable")
    c, d = a[order], b[order]
    return np.lexsort((b, a)) if ((c[1:] == c[:-1]) & (d[1:] != d[:-1])).any() else order


def _elements(block: pa.Table, sizes: range, low: np.uint64, left_out: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """a, b, text, place, first of the n-grams of a block's texts, by their hashes, but those whose place is left out; the j-th
    time that a text has an n-gram is told apart from the others, and the times of one n-gram in a text lie together, the first in front. a's lowest bits are n - 1."""
    lengths, groups = np.diff(block["a"].offsets.to_numpy()), [block[x].to_numpy().view(np.uint64) for x in ("g", "g2")]
    words = [block[x].flatten().to_numpy().view(np.uint64) for x in ("a", "b")]
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))  # words from here to the end of the text
    hashes, found = [g[text] for g in groups], []
    for n in range(1, sizes.stop):
        size = max(len(text) - n + 1, 0)
        hashes = [_mixed(h[:size] * np.uint64(f) + w[n - 1 :]) for h, w, f in zip(hashes, words, FACTORS, strict=True)]
        if n in sizes:
            place = np.flatnonzero((left[:size] >= n) & ~left_out[n][:size] if n in left_out else left[:size] >= n).astype(np.int32)
            found.append(((hashes[0][place] & ~low) | np.uint64(n - 1), hashes[1][place], place))
    del left, hashes
    a, b, place = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = _order(a, b)
    a, b, place = a[order], b[order], place[order]
    del order
    owner = text[place]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])] if len(a) else np.zeros(0, bool)
    starts, again = np.flatnonzero(first), np.flatnonzero(~first)
    j = (again - starts[np.searchsorted(starts, again, side="right") - 1]).astype(np.uint64)
    a[again] = (_mixed(a[again] + j * np.uint64(FACTORS[0])) & ~low) | (a[again] & low)
    b[again] = _mixed(b[again] ^ (j * np.uint64(FACTORS[1])))
    return a, b, owner, place, first


def _distinct(a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct (a, b) once, sorted, with its text, -1 where more than one row has it; and which of them each row is."""
    order = _order(a, b)
    c, d = a[order], b[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])] if len(a) else np.zeros(0, bool)
    starts, which = np.flatnonzero(new), np.empty(len(a), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    alone = np.diff(np.r_[starts, len(a)]) == 1
    return c[starts], d[starts], np.where(alone, text[order[starts]], -1), which


def _bytes(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned numbers, the so many lowest bytes of each one, the n-th bytes of a column together, compressed."""
    planes = [np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for x, n in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _columns(packed: bytes, rows: int, *sizes: int) -> list[np.ndarray]:
    """What _bytes has packed, in numbers no wider than they need be."""
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=rows * sum(sizes), codec="zstd"), np.uint8).reshape(sum(sizes), rows)
    found, at = [], 0
    for n in sizes:
        width = 1 << (n - 1).bit_length()
        x = np.zeros((rows, width), np.uint8)
        x[:, :n] = planes[at : at + n].T
        found.append(x.view(f"<u{width}").ravel())
        at += n
    return found


def _steps(x: np.ndarray, start: int = 0) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(start))


def _cuts(a: np.ndarray, starts: list[int]) -> np.ndarray:
    return np.r_[np.searchsorted(a, np.array(starts, np.uint64)), len(a)]


def _share(a: np.ndarray, b: np.ndarray, text: np.ndarray, start: int, told: int) -> tuple[int, bytes, int, bytes]:
    """A block's sorted n-grams of a part that begins at the hash start: how many one text has and those packed, with so many bytes of its number, then those of more texts."""
    alone = text >= 0
    one, many = (_bytes((_steps(a[x], start), 8), (b[x], MORE), (text[x], n)) for x, n in ((alone, told), (~alone, 0)))
    return int(alone.sum()), one, int((~alone).sum()), many


def _single(part: pa.Table, start: int, told: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each block's share of a part: which of the n-grams that one text of it has no other text has, all their first hashes, and their texts if told."""
    rows = list(zip(*(part[x].to_pylist() for x in ("n_one", "one", "n_many", "many")), strict=True))
    one = [_columns(x, n, 8, MORE, *[told] * bool(told)) for n, x, _, _ in rows]
    many = [_columns(x, n, 8, MORE) for _, _, n, x in rows]
    firsts = [np.cumsum(x[0], dtype=np.uint64) + np.uint64(start) for x in one + many]
    a, b = np.concatenate(firsts), np.concatenate([x[1] for x in one + many])
    order = _order(a, b)
    a, b = a[order], b[order]
    other = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True] if len(a) else np.ones(1, bool)
    single = np.zeros(len(a), bool)
    single[order] = other[1:] & other[:-1]
    at = 0
    for first, x in zip(firsts, one, strict=False):
        yield single[at : at + len(first)], first, x[-1]
        at += len(first)


def self_bleu(texts: DataFrame, most: int = 4) -> DataFrame:
    """grp, id, n_words, bleu: BLEU of each text (grp, id, words: array of strings) with all others of its group as references.

    A text's count of an n-gram is clipped by the greatest count in any other text. So the j-th time that a text has an
    n-gram is a hit unless no other text has it j times: the n-grams, numbered so, are counted once over all texts, and those
    that one text alone has are its losses. No two texts ever meet. Texts are dealt into blocks of about WORDS words, and an n-gram
    moves at most once, dealt by hash into parts: a block sends a part its distinct n-grams, sorted, as the steps between the
    hashes of their words, packed (62 bits of one hash, MORE bytes of another and n tell n-grams apart). Those of one and two
    words go first, and for each a bit comes back. A longer one that holds a pair of words that no other text has is lost, so it stays; the
    rest go with the numbers of their texts in the block, which come back from the parts for those that are lost. The reference of closest length
    (the shorter of two) is the text's own length if another text has it, else a neighbour among the group's distinct
    lengths. A text without a matching word has 0, as has one without words; the only text of a group has null. ids are
    unique in a group; null words do not count.
    """
    rows = texts.select("grp", "id", F.filter("words", lambda w: w.isNotNull()).alias("words")).withColumn("n_words", F.size("words"))
    n = rows.agg(F.sum("n_words")).collect()[0][0] or 0
    short, levels = min(most, 2), 1 << (most - 1).bit_length()
    low = np.uint64(levels - 1)
    starts, later = ([-(-(i << 64) // k) for i in range(k)] for k in (n * x // GRAMS + 1 for x in (short, most - short)))
    id_type = texts.schema["id"].dataType.simpleString()
    # Words move as one string, each behind a mark, which none holds then; its words' hashes are those of words so written.
    marked = F.transform("words", lambda w: F.replace(F.replace(w, F.lit("\2"), F.lit("\2b")), F.lit(MARK), F.lit("\2a")))
    one = F.when(F.size("words") > 0, F.concat(F.lit(MARK), F.array_join(marked, MARK))).otherwise("")
    dealt = rows.select(F.pmod(F.xxhash64("grp", "id"), F.lit(n // WORDS + 1)).alias("block"), "id", F.xxhash64("grp").alias("g"), F.xxhash64(F.lit(1), "grp").alias("g2"), one.alias("words")).repartition("block")
    split = F.slice(F.split("words", MARK), F.lit(2), F.length("words") + 1)
    hashed = dealt.select("block", "id", "g", "g2", F.xxhash64("words").alias("all"), split.alias("words"))
    hashed = hashed.select("block", "id", "g", "g2", "all", F.transform("words", lambda w: F.xxhash64(w)).alias("a"), F.transform("words", lambda w: F.xxhash64(F.lit(1), w)).alias("b"))

    def in_order(block: pa.Table) -> pa.Table:
        """The same order whenever the block is made: by id, and equal ids by their words."""
        return block.take(pc.sort_indices(block, sort_keys=[(x, "ascending") for x in ("g", "id", "all")])).combine_chunks()

    def shorts(block: pa.Table) -> tuple[np.ndarray, ...]:
        a, b, text, place, first = _elements(block, range(1, short + 1), low, {})
        return *_distinct(a, b, text), place, first

    def first_shares(block: pa.Table) -> pa.Table:
        key = block["block"][0].as_py()
        a, b, text, *_ = shorts(in_order(block).to_batches()[0])
        cuts = _cuts(a, starts)
        found = [(part, key, *_share(a[i:j], b[i:j], text[i:j], starts[part], 0)) for part, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
        return pa.Table.from_pylist([dict(zip(share_names, x, strict=True)) for x in found], share_types)

    def first_losses(part: pa.Table) -> pa.Table:
        lost = [pa.scalar(np.packbits(single).tobytes()) for single, _, _ in _single(part, starts[part["part"][0].as_py()], 0)]
        return pa.table([part["block"], part["part"], part["n_one"], pa.array(lost, pa.binary())], ["block", "part", "n", "lost"])

    def later_shares(block: pa.Table, bits: pa.Table) -> pa.Table:
        key = block["block"][0].as_py()
        block = in_order(block).to_batches()[0]
        a, _, text, which, place, first = shorts(block)
        lost = np.zeros(len(a), bool)
        lost[text >= 0] = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x["lost"], np.uint8), count=x["n"]).astype(bool) for x in bits.sort_by("part").to_pylist())])
        count = np.bincount(text[lost] * np.int64(levels) + (a[lost] & low).astype(np.int64), minlength=block.num_rows * levels)
        foreign = np.zeros(int(np.diff(block["a"].offsets.to_numpy()).sum()), bool)  # pairs of words from a place on that no other text has
        pairs = (a[which] & low) == 1
        foreign[place[pairs]] = lost[which[np.flatnonzero(first)]][np.cumsum(first) - 1][pairs]
        del a, text, which, place, first, lost, pairs
        lengths = np.diff(block["a"].offsets.to_numpy())
        owner, left = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(foreign))
        left_out = {}
        for size in range(short + 1, most + 1):
            k = max(len(foreign) - size + 1, 0)
            left_out[size] = np.logical_or.reduce([foreign[i : i + k] for i in range(size - 1)])
            count += np.bincount(owner[:k][left_out[size] & (left[:k] >= size)] * levels + size - 1, minlength=len(count))
        found = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        if most > short:
            found = _distinct(*_elements(block, range(short + 1, most + 1), low, left_out)[:3])[:3]
        cuts, home = _cuts(found[0], later), key % len(later)  # home: the part that brings back whose the numbers are
        named = {"g": block["g"].to_pylist(), "id": block["id"].to_pylist(), "known": count.tolist()}
        sent = [(part, key, *_share(*(x[i:j] for x in found), later[part], 4)) for part, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j or part == home]
        return pa.Table.from_pylist([dict(zip(share_names, x, strict=True)) | (named if x[0] == home else {}) for x in sent], named_types)

    def losses(part: pa.Table) -> pa.Table:
        found = []
        for single, first, text in _single(part, later[part["part"][0].as_py()], 4):
            which = np.sort(text[single] * np.uint64(levels) + (first[single] & low))
            found.append((len(which), _bytes((_steps(which), 4))))
        return pa.table([part["block"], pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()), *(part[x] for x in ("g", "id", "known"))], ["block", "n", "lost", "g", "id", "known"])

    def by_text(block: pa.Table) -> pa.Table:
        (named,) = np.flatnonzero(np.asarray(block["g"].is_valid()))
        g, ids, count = (block[x][int(named)].values for x in ("g", "id", "known"))
        count = count.to_numpy().copy()
        for k, packed in zip(block["n"].to_pylist(), block["lost"].to_pylist(), strict=True):
            np.add.at(count, np.cumsum(_columns(packed, k, 4)[0], dtype=np.int64), 1)
        return pa.table([g, ids, *(pa.array(count[level::levels]) for level in range(most))], ["g", "id", *counts])

    share_names, counts = ["part", "block", "n_one", "one", "n_many", "many"], [f"lost_{level + 1}" for level in range(most)]
    share_types = pa.schema([(x, pa.int64() if x not in ("one", "many") else pa.binary()) for x in share_names])
    named_types = pa.schema([*share_types, ("g", pa.list_(pa.int64())), ("id", pa.list_(to_arrow_type(texts.schema["id"].dataType))), ("known", pa.list_(pa.int64()))])
    share, named = "part long, block long, n_one long, one binary, n_many long, many binary", f"g array<long>, id array<{id_type}>, known array<long>"
    bits = hashed.groupBy("block").applyInArrow(first_shares, share).groupBy("part").applyInArrow(first_losses, "block long, part long, n long, lost binary")
    grams = hashed.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(later_shares, f"{share}, {named}").repartition(len(later), "part")
    lost = grams.groupBy("part").applyInArrow(losses, f"block long, n long, lost binary, {named}")
    lost = lost.groupBy("block").applyInArrow(by_text, f"g long, id {id_type}, " + ", ".join(f"{x} long" for x in counts)).groupBy("g", "id").agg(*[F.sum(x).alias(x) for x in counts])
    by_length = Window.partitionBy("grp").orderBy("n_words")
    lengths = rows.groupBy("grp", "n_words").agg(F.count("*").alias("k")).withColumns({"low": F.lag("n_words").over(by_length), "high": F.lead("n_words").over(by_length)})
    nearer = F.when(F.col("high").isNull() | (F.col("n_words") - F.col("low") <= F.col("high") - F.col("n_words")), F.col("low")).otherwise(F.col("high"))
    lengths = lengths.select("grp", "n_words", F.when(F.col("k") > 1, F.col("n_words")).otherwise(nearer).alias("closest"))
    rows = rows.select("grp", "id", "n_words", F.xxhash64("grp").alias("g")).join(lost, ["g", "id"], "left").join(lengths, ["grp", "n_words"])
    hits = [F.greatest(F.col("n_words") - (n - 1), F.lit(0)) - F.coalesce(F.col(f"lost_{n}"), F.lit(0)) for n in range(1, most + 1)]
    logs = []
    for n in range(1, most + 1):
        hit = hits[n - 1]
        logs.append(F.log(F.when(hit > 0, hit).otherwise(F.lit(EPSILON)) / F.greatest(F.col("n_words") - (n - 1), F.lit(1))))
    brevity = F.when(F.col("n_words") > F.col("closest"), 0.0).otherwise(1 - F.col("closest") / F.col("n_words"))
    bleu = F.when(F.col("closest").isNull(), None).when(hits[0] == 0, 0.0).otherwise(F.exp(brevity + sum(logs[1:], logs[0]) / most))
    return rows.select("grp", "id", "n_words", bleu.alias("bleu"))
