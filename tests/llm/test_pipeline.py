"""The pipeline against a brute-force version of its stages, and the entry's optional parts."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from test_documents import brute_dedup, brute_mix, brute_repeats, words
from test_pairs import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import packing
from quern.llm.tokens import vocabulary_path

ROOT = Path(__file__).resolve().parents[2]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage, docs = say(70), []
    for i in range(30):
        body = [say(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 5 == 0:
            body.insert(1, passage)
        docs.append((i, "\n".join(body), "en", rng.choice(["a", "a", "b", "c", None])))
    for i in range(30, 36):
        own = docs[i - 30][1].replace(docs[i - 30][1].split()[3], "changed", 1)
        docs.append((i, own.replace("\n", " "), "en", "a"))
    docs += [(40, docs[7][1], "en", "b"), (41, "junk junk junk " * 40, "en", "b"), (42, None, "en", "c"), (43, "", None, "c"), (44, passage, "en", "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]


def brute(docs):
    kept = []
    for i, text, _, source, _ in docs:
        w = words(text)
        covered = {n: set() for n in (3, 10)}
        longest = brute_repeats(w)
        for n, places in covered.items():
            for p, x in enumerate(longest):
                if x >= n:
                    places.update(range(p, p + x))
        if len(w) >= 50 and 100 * len(covered[3]) <= 50 * len(w) and len(covered[10]) <= 0.2 * len(w) and max(longest) <= 150:
            kept.append((i, text, source))
    clean = brute_dedup([(i, t) for i, t, _ in kept])
    kept = [(i, clean[i][0], s) for i, _, s in kept if not clean[i][1] or words(clean[i][0])]
    heads = {i for i, c, _ in brute_classes([(i, t) for i, t, _ in kept]) if i == c}
    kept = [x for x in kept if x[0] in heads]
    sizes, target = brute_mix([(s, len(words(t))) for _, t, s in kept])
    out = []
    for source, total in sizes.items():
        budget = int(target[source] + 0.5)
        own = sorted((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16), i, t) for i, t, s in kept if s == source)
        rest = budget % total
        for _, i, t in own:
            out += [(i, t)] * (budget // total)
            n = min(rest, len(words(t)))
            if n == len(words(t)):
                out.append((i, t))
            elif n:
                end = 0
                for x in t.split()[:n]:
                    end = t.index(x, end) + len(x)
                out.append((i, t[:end]))
            rest -= n
    return out


def test_pipeline(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, SHAPE).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    direct = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    wanted = Counter(tuple([i, *direct.encode(t, add_special_tokens=False).ids, 2]) for i, t in brute(docs))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for key, n in wanted.items():
        ids = np.array(key[1:], "<u4")
        own = [p for p in pieces if p.doc_id == key[0] and p.doc_tokens == len(ids)]
        assert sum(p.length for p in own) == n * len(ids), key[0]
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    assert sum(p.length for p in pieces) == sum(n * (len(k) - 1) for k, n in wanted.items())


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(), SHAPE)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), "").count() == 0


def test_a_mix_of_nothing(spark):
    """Sources without words take nothing, and nobody divides by their sizes."""
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "b", 2)], SHAPE)
    assert corpus_pipeline.mixed_sources(spark, docs, "").count() == 0


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
