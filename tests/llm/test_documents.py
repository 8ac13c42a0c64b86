"""Token counts, quality rules, packing, mixing and line dedup on small tables, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, packing, quality_rules, source_mix, token_counts
from quern.llm.tokens import encoder, vocabulary_path

SHAPE = "doc_id long, text string, source string, row string, size long, code long, target string, quality string"
LONG = " ".join(f"w{i * i % 9973}" for i in range(9000))
HARD = [
    (1, "one two three\nfour", "b", "x", 1, 2, "t", "q"),
    (2, None, "b", None, None, None, None, None),
    (3, "", None, "x", 1, 2, "t", "q"),
    (4, " \n\t ", "a", "x", 1, 2, "t", "q"),
    (None, "no id here", "a", "x", 1, 2, "t", "q"),
    (5, LONG, "a", "x", 1, 2, "t", "q"),
    (6, "the same\nthing", "c", "x", 1, 2, "t", "q"),
    (6, "the same\nthing", "c", "x", 1, 2, "t", "q"),
    (7, "Ünïcödé nbsp \x1c odd <|endoftext|> don't ΑΣ́", "c", "x", 1, 2, "t", "q"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def words(text):
    return (text or "").encode().split()


def test_encoders_equal_the_libraries():
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    mine = encoder(packing.VOCABULARY)
    for _, text, *_ in HARD:
        assert list(mine(text or "")) == direct.encode(text or "", add_special_tokens=False).ids
    ranks = encoder(token_counts.VOCABULARY)
    assert isinstance(ranks.encoding, tiktoken.Encoding) and public_tokenizers.PATTERN
    assert ranks.count("Hello world") == 2


def test_context_totals(spark, hard, none):
    lengths = [encoder(token_counts.VOCABULARY).count(t or "") for _, t, *_ in HARD]
    rows = token_counts.context_totals(token_counts.length_histogram(hard)).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.n_tokens)
        assert r.tokens_at_limit == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
    quantiles = {r.share: r.n_tokens for r in token_counts.length_quantiles(token_counts.context_totals(token_counts.length_histogram(hard)), [0.5, 1.0]).collect()}
    assert quantiles == {0.5: sorted(lengths)[4], 1.0: max(lengths)}
    assert token_counts.context_totals(token_counts.length_histogram(none)).count() == 0


def brute_repeats(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def test_longest_repeats():
    rng = random.Random(1)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice((1, 2, 5))) for _ in range(rng.randrange(25))] for _ in range(4)]
        flat = np.array([x for t in texts for x in t], np.int64)
        owner = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
        assert list(quality_rules.longest_repeats(flat, owner)) == [y for t in texts for y in brute_repeats(t)]


def test_quality_rules(spark, hard, none):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    passage = " ".join(f"p{i}" for i in range(160))
    table = hard.unionByName(spark.createDataFrame([
        (10, clean, "a", "", 0, 0, "", ""), (11, "spam spam eggs " * 60, "a", "", 0, 0, "", ""),
        (12, f"{passage}\n{clean}\n{clean[::-1]}\n{passage}", "a", "", 0, 0, "", ""), (13, "a#b | <c>\na#b | <c>\n\nx", "a", "", 0, 0, "", "")], SHAPE))
    found = {r.row.doc_id: r.quality for r in quality_rules.score(table).collect() if r.row.doc_id != 6}
    assert found[10].kept and not found[10].base_failed
    assert found[11].base_failed and not found[11].kept
    assert found[12].longest_repeat == 160 and not found[12].base_failed and not found[12].kept
    assert (found[13].n_words, found[13].word_chars, found[13].n_symbols, found[13].n_dup_lines, found[13].n_repeat_words) == (7, 15, 8, 1, 6)
    for i in (2, 3, 4):
        assert found[i].n_words == 0 and found[i].base_failed and not found[i].kept
    assert found[5].n_words == 9000 and found[5].kept
    assert sorted(x.doc_id for x in quality_rules.keep_good(table).collect()) == [5, 10]
    assert quality_rules.keep_good(table).columns == table.columns
    assert quality_rules.score(none).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_packing(spark, hard, none, parts):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    pieces = packing.pack(hard.repartition(parts), size=256, open_windows=3, slack=4).collect()
    whole = Counter((i, tuple(direct.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in HARD)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for window in windows.values():
        window.sort(key=lambda p: p.offset)
        assert [p.offset for p in window] == list(np.cumsum([0] + [p.length for p in window])[:-1])
        n = sum(p.length for p in window)
        assert n <= 256 and (n >= 252 or n & (n - 1) == 0)
    for (i, ids), copies in whole.items():
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i and p.doc_tokens == len(ids))
        assert sum(n for _, n, _ in own) == copies * len(ids)
        for start, n, crc in own:
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
    assert packing.pack(none).count() == 0


def brute_mix(rows, weights=(1, 2, 3), limit=3):
    sizes = Counter()
    for source, n in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > limit * sizes[x]}
        if not full:
            target |= share
            break
        target |= {x: limit * sizes[x] for x in full}
        left -= sum(limit * sizes[x] for x in full)
        open_ -= full
    return sizes, target


def test_mix(spark, hard, none):
    rng = random.Random(3)
    more = [(100 + i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "b", "é", "z", "zz", None]) if i % 3 else "a", "r", 0, 0, "", "") for i in range(300)]
    table = hard.where("doc_id <> 5 or doc_id is null").unionByName(spark.createDataFrame(more, SHAPE))
    rows = source_mix.mix(table, F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).collect()
    sizes, target = brute_mix([(r.row.source, r.size) for r in rows])
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(target[r.row.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.row.source] += r.taken
    for source, n in taken.items():
        assert n == int(target[source] + 0.5)
    again = source_mix.mix(table.repartition(7), F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).collect()
    key = lambda rows: Counter((r.row.doc_id, r.row.text, r.taken) for r in rows)
    assert key(rows) == key(again)
    out = source_mix.mixed(table)
    assert out.columns == table.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert source_mix.mix(none, F.col("size")).count() == 0


def brute_dedup(docs, least=50):
    """docs: (doc_id, text) in order; deletes later repeats of maximal common runs of lines."""
    lines = {i: (t.split("\n") if t is not None else []) for i, t in docs}
    worded = {i: [k for k, x in enumerate(v) if words(x)] for i, v in lines.items()}
    places = [(i, p) for i in lines for p in range(len(worded[i]))]
    line = lambda place: lines[place[0]][worded[place[0]][place[1]]]
    gone = {i: set() for i in lines}
    order = {place: k for k, place in enumerate(places)}
    for later in places:
        for earlier in places[: order[later]]:
            n = size = 0
            while later[1] + n < len(worded[later[0]]) and earlier[1] + n < len(worded[earlier[0]]) and line((later[0], later[1] + n)) == line((earlier[0], earlier[1] + n)):
                size += len(words(line((later[0], later[1] + n))))
                n += 1
            if size >= least:
                gone[later[0]].update(range(later[1], later[1] + n))
    out = {}
    for i, v in lines.items():
        drop, under = set(), False
        position = {k: p for p, k in enumerate(worded[i])}
        for k in range(len(v)):
            if k in position:
                under = position[k] in gone[i]
            if under:
                drop.add(k)
        out[i] = ("\n".join(x for k, x in enumerate(v) if k not in drop), len(drop))
    return out


def test_line_dedup_against_pairs(spark):
    rng = random.Random(4)
    pool = [" ".join(f"l{i}w{j}" for j in range(rng.choice((1, 3, 12, 30, 70)))) for i in range(12)] + ["", " "]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))))
    docs += [(100, "tick\n" * 200), (101, "tick\n" * 30 + "\n\n" + "tock " * 60), (102, None), (103, "")]
    table = spark.createDataFrame([(i, t, "s", "s", 0, 0, "", "") for i, t in docs], SHAPE)
    found = {r.row.doc_id: r for r in line_dedup.dedup_lines(table).collect()}
    wanted = brute_dedup(docs)
    for i, text in docs:
        if text is None:
            assert found[i].clean_text is None and found[i].n_lines == 0
        else:
            assert (found[i].clean_text, found[i].n_deleted) == wanted[i], i
            assert found[i].n_lines == len(text.split("\n"))


def test_line_dedup_edges(spark, hard, none):
    rows = line_dedup.dedup_lines(hard).collect()
    assert len(rows) == len(HARD) and all(r.clean_text == r.row.text and r.n_deleted == 0 for r in rows)
    passage = " ".join(f"q{i}" for i in range(60))
    table = spark.createDataFrame([(i, f"{head}\n{passage}", "", "", 0, 0, "", "") for i, head in ((None, "first"), (1, "second"), (2, "third"), (2, "third"))], SHAPE)
    found = Counter((r.row.doc_id, r.clean_text) for r in line_dedup.dedup_lines(table).collect())
    assert found == Counter({(None, f"first\n{passage}"): 1, (1, "second"): 1, (2, "third"): 2})
    only = spark.createDataFrame([(1, passage, "", "", 0, 0, "", ""), (2, passage, "", "", 0, 0, "", "")], SHAPE)
    assert [r.doc_id for r in line_dedup.without_repeats(only).collect()] == [1]
    assert line_dedup.without_repeats(only).columns == only.columns
    assert line_dedup.dedup_lines(none).count() == 0


def test_coverage_alone_rejects(spark):
    """Texts that pass the base: runs of 10 words or more may cover a fifth of the words, not more."""
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, f"{say('r', 12)} {say('x', 76)} {say('r', 12)}"), (2, f"{say('r', 10)} {say('x', 80)} {say('r', 10)}"), (3, f"{say('r', 9)} {say('x', 30)} {say('r', 9)} y {say('r', 3)}")]
    found = {r.row.doc_id: r.quality for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(x.base_failed for x in found.values())
    assert [(found[i].covered_words, found[i].kept) for i in (1, 2, 3)] == [(24, False), (20, True), (0, True)]


def test_fingerprints_are_window_minima(spark):
    """Fewer rows than windows leave the scan, every window holds its fingerprint, and equal windows share it."""
    rng = random.Random(31)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared = [say(rng.randrange(3, 20)) for _ in range(9)]
    docs = [(i, "\n".join([*(say(rng.randrange(1, 30)) for _ in range(8)), *shared, "", *(say(9) for _ in range(4))])) for i in range(12)]
    lines = line_dedup.worded_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").cache()
    prints = Counter((r.doc_id, r["at"], r.mark) for r in line_dedup.fingerprints(lines, 50).collect())
    runs = [(r.doc_id, r.h, x) for r in lines.withColumn("x", line_dedup.windows(50)).collect() for x in r.x]
    assert max(prints.values()) == 1 and 0 < len(prints) < len(runs)
    marks = defaultdict(set)
    for doc, h, x in runs:
        part = h[x.s - 1 : x.s - 1 + x.len]
        assert h[x["at"] - 1] == min(part) and x.s <= x["at"] < x.s + x.len and (doc, x["at"], min(part)) in prints
        marks[tuple(part)].add((min(part), x["at"] - x.s))
    assert all(len(x) == 1 for x in marks.values())
    lines.unpersist()
