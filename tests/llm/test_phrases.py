"""Collocations, against counting by loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import phrase_mining
from quern.llm.phrase_mining import Bitmaps, collocations, grown


def expected(docs, most=3, support=10, share=50, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    rows = []
    for lang, f in counts.items():
        found = []
        good = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        for p, a in good.items():
            inside = [q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * good[q] >= share * a for q in inside):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def docs():
    rng = random.Random(5)
    words = ["New", "york", "CITY", "is", "big", "und", "ÄÖ", "é", "a", "b\x00", "😀"]
    made = [(" ".join(rng.choices(words, weights=[9, 9, 6, 5, 4, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 60))).replace("is", rng.choice([".", "is", "\tis ", "\n", ",x"])), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    return [*made, ("a a a a a a a a a a a a a a", "xx"), (None, "en"), ("", None), (" .,;:!?\n\x0b\x0c\r\t", "fr"), ("word " * 3000, "long"), ("same text here. " * 12, "rep"), ("same text here. " * 12, "rep")]


@pytest.mark.parametrize("most,shard,chunk", [(3, 2_000_000, 200_000), (3, 100, 7), (4, 300, 11)])
def test_equals_loops(spark, monkeypatch, most, shard, chunk):
    monkeypatch.setattr(phrase_mining, "SHARD", shard)
    monkeypatch.setattr(phrase_mining, "CHUNK", chunk)
    table = spark.createDataFrame([(*d, 1, "x") for d in docs()], "text string, lang string, h1 long, word string").repartition(3)
    got = sorted(tuple(r) for r in collocations(table, most_words=most, support=5).collect())
    assert got == expected(docs(), most, 5)


def test_top_and_ties(spark):
    table = [(f"w{i} v{i}. " * 10, "en") for i in range(30)]
    got = [tuple(r) for r in collocations(spark.createDataFrame(table, "text string, lang string"), top=7).orderBy("rank").collect()]
    assert got == expected(table, top=7) and [r[2] for r in got] == sorted(f"w{i} v{i}" for i in range(30))[:7]


def test_hash_collision_takes_another_seed(spark, monkeypatch):
    real = phrase_mining.Shard.hashes
    monkeypatch.setattr(phrase_mining.Shard, "hashes", lambda self, seed: real(self, seed) & np.uint64(1) if seed == 0 else real(self, seed))
    table = [("one two three. " * 20, "en"), ("vier fünf. " * 15, "de")]
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(table, "text string, lang string")).collect()) == expected(table)


def test_bitmaps_shift_over_bytes():
    tokens = np.array([2, 3] * 20 + [0] + [3, 2], np.int32)
    maps = Bitmaps(tokens, np.ones(4, bool))
    every = np.arange(4, dtype=np.int64)[:, None]
    found = Counter()
    for phrases, counts in grown(maps, 2, None, every, maps.word, maps.block, maps.bits):
        for p, n in zip(phrases.tolist(), counts.tolist(), strict=True):
            found[tuple(p)] += n
    assert found == {(2, 3): 20, (3, 2): 20}


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
