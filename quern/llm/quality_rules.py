"""Quality rules: limits on what a text repeats of itself, from its suffix array and longest common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import whole_row

SYMBOLS = "#*$%&|<>"
#: Code points of text whose suffixes are sorted together (a longer text is sorted alone, whole): bounds memory only.
CHUNK = 1_000_000
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def longest_repeats(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words that starts there and elsewhere in the same text.

    words, texts: the word's and the text's number at each position; each text's positions lie together. The suffixes
    are sorted by doubling; a round only touches suffixes that are still tied. The ranks of each round then give the
    longest common prefix of neighbours in the suffix array, and the deepest interval of common prefixes that holds a
    suffix is the greater of the prefixes shared with its two neighbours.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    last = np.append(texts[1:] != texts[:-1], True)
    ends = np.flatnonzero(last)[np.cumsum(last) - last]  # the last position of each one's text
    key = texts.astype(np.int64) * (int(words.max()) + 1) + words
    suffixes = np.argsort(key, kind="stable")
    heads = np.append(True, np.diff(key[suffixes]) != 0)

    def tied(heads: np.ndarray) -> np.ndarray:
        return ~(heads & np.append(heads[1:], True))

    rank = np.empty(n, np.int32)
    rank[suffixes] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, h, slots = [rank], 1, np.flatnonzero(tied(heads))
    while len(slots):
        at = suffixes[slots]
        after = np.where(at + h <= ends[at], rank[np.minimum(at + h, n - 1)].astype(np.int64), -1)
        group = rank[at].astype(np.int64)
        order = np.argsort(group * (n + 1) + after, kind="stable")
        at, after, group = at[order], after[order], group[order]
        suffixes[slots] = at  # groups keep their slots
        heads = np.append(True, (np.diff(group) != 0) | (np.diff(after) != 0))
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]
        levels.append(rank)
        slots, h = slots[tied(heads)], 2 * h
    one, two, common = suffixes[:-1].astype(np.int64), suffixes[1:].astype(np.int64), np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][one] == levels[0][two])
    for k in range(len(levels) - 1, -1, -1):
        i, j = one[live] + common[live], two[live] + common[live]
        inside = (i <= ends[one[live]]) & (j <= ends[two[live]])
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        common[live[same]] += 1 << k
    found = np.zeros(n, np.int64)
    found[suffixes[1:]] = common
    found[suffixes[:-1]] = np.maximum(found[suffixes[:-1]], common)
    return found


def _covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """True at positions inside a repeated run of at least `least` words."""
    change, starts = np.zeros(len(repeats) + 1, np.int64), np.flatnonzero(repeats >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + repeats[starts], -1)
    return np.cumsum(change[:-1]) > 0


def repetition(texts: list[str | None], min_repeat: int = 10) -> pd.DataFrame:
    """FEATURES of each text (null: none of anything)."""
    split = [x.encode("utf-8", "surrogatepass").split() if x else [] for x in texts]  # bytes split at ASCII white space alone
    sizes = np.array([len(x) for x in split], np.int64)
    flat = [x for words in split for x in words]
    number = {x: i for i, x in enumerate(set(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(texts)), sizes)
    repeats = longest_repeats(words, owner)
    total = lambda x: np.bincount(owner, x, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, repeats)
    lines = [[y for y in x.split("\n") if y.strip(" \t\r\v\f")] if x else [] for x in texts]
    return pd.DataFrame({
        "n_words": sizes,
        "word_chars": [len(x) - sum(map(x.count, " \t\n\r\v\f")) if x else 0 for x in texts],
        "n_symbols": [sum(map(x.count, SYMBOLS)) if x else 0 for x in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": total(_covered(repeats, 3)),
        "covered_words": total(_covered(repeats, min_repeat)),
        "longest_repeat": longest,
    })


def score(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_repeat: int = 10, max_covered: float = 0.2, max_longest: int = 150) -> DataFrame:
    """Structs `row` (docs' columns) and `quality`: FEATURES, base_failed, kept.

    A text fails the base with fewer than min_words words, or if words in 3-word windows found twice or more are over
    max_repeat_percent of its words. It is kept if it passes the base, repeated runs of at least min_repeat words cover
    at most the share max_covered of its words, and no run of over max_longest words occurs twice. Null and empty texts
    have no words and fail. As words covered by runs of min_repeat words are among those in 3-word windows found twice,
    max_covered only tells beyond the base if it is below max_repeat_percent. Rows are judged each for itself, so repeated rows get the same verdict.
    """

    @F.pandas_udf(FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, held, chars = [], [], 0
            for x in batch:
                held.append(x)
                chars += len(x or "")
                if chars >= CHUNK:
                    done.append(repetition(held, min_repeat))
                    held, chars = [], 0
            yield pd.concat([*done, repetition(held, min_repeat)], ignore_index=True)

    f = F.col("features")
    failed = (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_percent * f["n_words"])
    kept = ~failed & (f["covered_words"] <= max_covered * f["n_words"]) & (f["longest_repeat"] <= max_longest)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    rows = docs.select(whole_row(docs).alias("row"), features(F.col(text)).alias("features"))
    return rows.select("row", F.struct(*[f[x].alias(x) for x in names], failed.alias("base_failed"), kept.alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of docs that score() keeps, with their own columns."""
    return score(docs, text, **limits).where("quality.kept").select("row.*")


#: DuckDB SQL for score() over documents with unique doc_ids, without longest_repeat: a run of over 150 words that occurs
#: twice is a window of 151 words that does, and runs of 10 words or more cover what repeated windows of 10 words do.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
g AS (SELECT doc_id, i, CASE WHEN i + 2 <= len(w) THEN md5(array_to_string(w[i:i + 2], ' ')) END AS g3, CASE WHEN i + 9 <= len(w) THEN md5(array_to_string(w[i:i + 9], ' ')) END AS g10,
        CASE WHEN i + 150 <= len(w) THEN md5(array_to_string(w[i:i + 150], ' ')) END AS g151 FROM p),
r AS (SELECT doc_id, i, (g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1)::INT AS r3, (g10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g10) > 1)::INT AS r10,
        (g151 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g151) > 1)::INT AS r151 FROM g),
c AS (SELECT doc_id, max(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, max(r10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r151 FROM r),
s AS (SELECT doc_id, sum(c3) AS n_repeat_words, sum(c10) AS covered_words, max(r151) AS too_long FROM c GROUP BY doc_id),
f AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_words, 0)::BIGINT AS covered_words, coalesce(too_long, 0) AS too_long
      FROM t LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_words <= 0.2::DOUBLE * n_words AND too_long = 0 AS kept, covered_words FROM b
"""
