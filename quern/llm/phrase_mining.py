"""Phrase collocations: position bitmaps of words, extended by shift, AND and popcount, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import written

#: Pieces end at these characters; words in them are parted by blanks and tabs.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
#: Positions of a shard, bitmap bytes that are extended at once, and bits of the filter of frequent phrases (8 MB).
SHARD, CHUNK, FILTER_BITS = 2_000_000, 200_000, 26
_END, _NONE = 0, 1


class _Words(dict):
    """Numbers of one language's words, in which all languages share `names`."""

    def __init__(self, lang: str, names: list) -> None:
        super().__init__({b"\n": _END, b"": _NONE})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append((self.lang, word))
        return number


class Shard:
    """Some documents' words as numbers at positions; between pieces lies a position without a word."""

    def __init__(self) -> None:
        self.names: list = [None, None]
        self.words: dict[str, _Words] = {}
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = _Words(lang, self.names)
        parts = (text.lower().translate(_CLEAN) + b"\n").replace(b"\n", b" \n ").split(b" ")
        run = np.fromiter(map(self.words[lang].__getitem__, parts), np.int32, len(parts))
        self.runs.append(run[run != _NONE])
        self.size += len(self.runs[-1])

    def tokens(self) -> np.ndarray:
        return np.concatenate(self.runs) if self.runs else np.zeros(0, np.int32)

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits for each word of each language."""
        whole = ((f"{len(lang)}:{lang}").encode() + word for lang, word in self.names[2:])
        return np.fromiter((0, 0, *(xxhash.xxh3_64_intdigest(x, seed) for x in whole)), np.uint64, len(self.names))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each run of equal ones starts in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.diff(keys[order], prepend=-1))


class Bitmaps:
    """Bitmaps of all words over a shard's positions, of which only bytes with a bit are kept: word, block (a byte's
    place), bits by word; and the same bytes by block, for meeting all words of a block at once."""

    def __init__(self, tokens: np.ndarray, known: np.ndarray) -> None:
        at = np.flatnonzero((tokens > _NONE) & known[tokens])
        keys = (tokens[at].astype(np.int64) << 32) | (at >> 3)
        order, starts = _runs(keys)
        keys = keys[order][starts]
        self.word, self.block = keys >> 32, keys & 0xFFFFFFFF
        self.bits = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))[order], starts) if len(at) else np.zeros(0, np.uint8)
        by_block = np.argsort(self.block, kind="stable")
        self.there, self.there_bits = self.word[by_block], self.bits[by_block]
        self.first = np.searchsorted(self.block[by_block], np.arange((len(tokens) >> 3) + 3))

    def extended(self, owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, word, block, bits: the owners' bitmaps moved on by one position, ANDed with the words' they meet."""
        over = np.flatnonzero(bits & 128)
        owner, block, bits = np.concatenate([owner, owner[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([bits << 1, np.ones(len(over), np.uint8)])
        low = self.first[block]
        n = self.first[block + 1] - low
        mine = np.repeat(np.arange(len(n)), n)
        theirs = np.arange(len(mine)) + np.repeat(low - (np.cumsum(n) - n), n)
        both = bits[mine] & self.there_bits[theirs]
        some = np.flatnonzero(both)
        mine, theirs = mine[some], theirs[some]
        return owner[mine], self.there[theirs], block[mine], both[some]


def grown(maps: Bitmaps, size: int, kept, phrases: np.ndarray, owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of `size` words (rows of word numbers) and their popcounts. `owner` numbers `phrases`, whose bitmaps are
    extended a bounded chunk at a time and depth first; kept(phrases) drops those that cannot be frequent. A phrase may
    come in several chunks, whose popcounts add up."""
    for start in range(0, len(owner), CHUNK):
        part = slice(start, start + CHUNK)
        mine, word, at, both = maps.extended(owner[part], block[part], bits[part])
        if not len(mine):
            continue
        keys = mine * np.int64(1 << 32) + word
        order, starts = _runs(keys)
        longer = np.column_stack([phrases[mine[order[starts]]], word[order[starts]]])
        if longer.shape[1] == size:
            good = kept(longer[:, 1:]) if size > 2 else np.ones(len(longer), bool)
            counts = np.add.reduceat(np.bitwise_count(both[order]).astype(np.int64), starts)
            yield longer[good], counts[good]
            continue
        good = kept(longer)
        number = np.cumsum(good) - 1
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        order, group = order[good[group]], group[good[group]]
        yield from grown(maps, size, kept, longer[good], number[group], at[order], both[order])


def _slots(columns: list[np.ndarray]) -> np.ndarray:
    """Places of phrases, given as columns of hashes, in the filter."""
    key = np.zeros(len(columns[0]), np.uint64)
    for i, h in enumerate(columns):
        turn = np.uint64(21 * i % 64)
        key ^= (h << turn) | (h >> (np.uint64(64) - turn)) if turn else h
    return key >> np.uint64(64 - FILTER_BITS)


def _slot(columns: list[str]) -> Column:
    """_slots() as a column."""
    key = F.lit(0).cast("long")
    for i, name in enumerate(columns):
        turn, h = 21 * i % 64, F.col(name)
        key = key.bitwiseXOR(F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)) if turn else h)
    return F.shiftrightunsigned(key, 64 - FILTER_BITS)


def frequent_filter(phrases: DataFrame, columns: list[str]) -> np.ndarray:
    """2^FILTER_BITS bits, of which the phrases' are set: 8 MB for any number of phrases. It lets all of these pass, and
    some others, whose counts then tell."""
    found = phrases.select(_slot(columns).alias("slot")).groupBy(F.expr("shiftrightunsigned(slot, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _passes(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    slot = _slots(columns)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            shard.add(lang, text.as_py())
            if shard.size >= SHARD:
                yield shard
                shard = Shard()
    yield shard


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, h1, n of every word; texts: lang, text (binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            n = np.bincount(shard.tokens(), minlength=len(shard.names))[2:]
            names = shard.names[2:]
            columns = [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()).cast(pa.string()), pa.array(shard.hashes(seed)[2:].view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "h1", "n"])

    found = texts.mapInArrow(count, "lang string, word string, h1 long, n long")
    return found.groupBy("lang", "word", "h1").agg(F.sum("n").alias("n"))


def phrase_counts(texts: DataFrame, size: int, seed: int, filters: list) -> DataFrame:
    """h1 .. h{size}, n of the phrases of `size` words whose shorter parts pass `filters` (broadcasts, by length from 1)."""
    names = [f"h{i + 1}" for i in range(size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            h = shard.hashes(seed)
            known = _passes(filters[0].value, [h])
            maps = Bitmaps(shard.tokens(), known)
            kept = lambda x: _passes(filters[x.shape[1] - 1].value, [h[x[:, i]] for i in range(x.shape[1])])
            every = np.arange(len(h), dtype=np.int64)[:, None]
            for found, n in grown(maps, size, kept, every, maps.word, maps.block, maps.bits):
                yield pa.RecordBatch.from_arrays([*(pa.array(h[found[:, i]].view(np.int64)) for i in range(size)), pa.array(n)], [*names, "n"])

    found = texts.mapInArrow(count, ", ".join(f"{x} long" for x in [*names, "n"]))
    # a shard sends each phrase once or a few times, so summing again before the shuffle would only fill memory
    return found.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 3, support: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases of 2 to `most_words` words by score.

    Texts in lower case (A-Z only) fall into pieces at PIECE_ENDS and these into words at blanks and tabs; null texts are
    empty, a null lang is `und`. n counts a lang's words, a, l and r the occurrences of a phrase (of `support` at least)
    and of the parts left and right of its lowest-scoring cut, ties to the shorter left part. The score is
    floor(10^6 a^2 / (l r)). A phrase inside a longer one that has `share` hundredths of its occurrences is dropped. Ranks go by
    score, a (both falling) and phrase in byte order. Repeated rows count each for itself; no rows give no phrases.

    Each length is a pass over all texts: shards of SHARD positions grow phrases from bitmaps and sum popcounts, then
    shards are summed by the words' hashes. Two words of one hash show in the table of words, and another seed is taken.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    for seed in range(64):
        words = written(word_counts(texts, seed), "words")
        if words.groupBy("h1").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(f"k > 1 AND n >= {support}").isEmpty():
            break
    spark = docs.sparkSession
    levels = [words.where(F.col("n") >= support).select("h1", "n")]
    filters = []
    for size in range(2, most_words + 1):
        filters.append(spark.sparkContext.broadcast(frequent_filter(levels[-1], [f"h{i + 1}" for i in range(size - 1)])))
        levels.append(written(phrase_counts(texts, size, seed, filters).where(F.col("n") >= support), f"phrases-{size}"))
    found = None
    for size in range(2, most_words + 1):
        names = [f"h{i + 1}" for i in range(size)]
        rows = levels[size - 1].withColumnRenamed("n", "a")
        cuts = []
        for k in range(1, size):
            left = levels[k - 1].select(*[F.col(f"h{i + 1}") for i in range(k)], F.col("n").alias(f"l{k}"))
            right = levels[size - k - 1].select(*[F.col(f"h{i + 1}").alias(f"h{k + i + 1}") for i in range(size - k)], F.col("n").alias(f"r{k}"))
            rows = rows.join(left, names[:k]).join(right, names[k:])
            score = F.expr(f"cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div cast(cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)) as decimal(38,0))")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.select(*names, "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        inside = None
        for longer in range(size + 1, most_words + 1):
            for at in range(longer - size + 1):
                part = levels[longer - 1].select(*[F.col(f"h{at + i + 1}").alias(f"h{i + 1}") for i in range(size)], F.col("n").alias("longest"))
                inside = part if inside is None else inside.unionByName(part)
        if inside is not None:
            inside = inside.groupBy(*names).agg(F.max("longest").alias("longest"))
            rows = rows.join(inside, names, "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).drop("longest")
        spelled = words.where(F.col("n") >= support)
        for i, name in enumerate(names):
            rows = rows.join(spelled.select(F.col("h1").alias(name), F.col("word").alias(f"w{i}"), *([F.col("lang")] if not i else [])), name)
        rows = rows.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(size)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for op13's rows over documents.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM p),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS size FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, b.a AS l, e.a AS r, ((1000000::HUGEINT * k.a * k.a) // (b.a::HUGEINT * e.a))::BIGINT AS score FROM k
  JOIN f b ON b.lang = k.lang AND b.phrase = array_to_string(k.w[:k.k], ' ') JOIN f e ON e.lang = k.lang AND e.phrase = array_to_string(k.w[k.k + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS longest FROM (SELECT lang, array_to_string(w[:2], ' ') AS part, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE size = 3) GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, phrase) AS rank, phrase, m.a, l, r, n, score
FROM m JOIN n USING (lang) LEFT JOIN i ON i.lang = m.lang AND i.part = m.phrase AND m.size = 2
WHERE i.part IS NULL OR 100 * longest < 50 * m.a QUALIFY rank <= 2000
"""
