"""Matched pools, renamed people, growing indexes, resumed stages and indexed grids, against loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import identity, matching, postings, retrieval
from quern.sources import stages


def matched(pools, donors, excluded, caliper=0.1, wide=0.2):
    found = []
    for pool, targets in pools.items():
        used = set()
        for grp, name, length in sorted(targets, key=lambda t: (-t[2], t[1])):
            order = sorted((n, d) for g, d, n in donors if g == grp)
            place = sum(n < length for n, _ in order)
            near = [(abs(n - length), i - place if i >= place else place - 1 - i, i < place, d) for i, (n, d) in enumerate(order) if d not in used and (pool, d) not in excluded]
            if not near:
                found.append((pool, name, None, None, "none"))
                continue
            distance, _, _, donor = min(near)
            used.add(donor)
            found.append((pool, name, donor, distance, "close" if distance <= caliper * length else "wide" if distance <= wide * length else "far"))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_contested_donors(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(1)
    donors = [(rng.choice("xy"), f"d{i}", rng.choice([5, 9, 10, 11, 30, 31, 50])) for i in range(60)] + [("z", "lone", 7)]
    pools = {f"p{k}": [(rng.choice("xy"), f"t{k}_{i}", rng.choice([8, 10, 29, 40])) for i in range(rng.randint(1, 12))] for k in range(8)}
    pools["empty"] = [("w", "nobody", 3), ("z", "t1", 7), ("z", "t2", 7)]
    pools["all"] = [("x", f"a{i}", 10) for i in range(40)]
    excluded = {(p, rng.choice(donors)[1]) for p in pools for _ in range(6)}
    t = spark.createDataFrame([(p, *t) for p, ts in pools.items() for t in ts] + [("p1", "x", None, 3)], "pool string, grp string, name string, length long")
    got = matching.length_matched_pools(t, spark.createDataFrame([*donors, ("x", "null", None)], "grp string, name string, length long"), spark.createDataFrame(list(excluded), "pool string, name string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == matched(pools, donors, excluded)


def test_no_targets(spark):
    none = spark.createDataFrame([], "pool string, grp string, name string, length long")
    assert matching.length_matched_pools(none, none.select("grp", "name", "length"), none.select("pool", "name")).collect() == []


def renamed(text, forms):
    if text is None or not forms:
        return text
    pattern = "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True))
    return re.sub(rf"(?<!\w)(?:{pattern})(?!\w)", lambda m: forms[m[0]], text)


def test_overlapping_names(spark):
    forms = {"ann": "P1", "ann_lee": "P2", "Ann Lee": "P2", "Ann": "P1", "Lee": "P3", "Lee Smith": "P4", "a.b": "P5", r"x\Ey": "P6", "$1": "P7", "Zoë": "P8"}
    texts = ["ann ann_lee Ann Lee", "Ann Lee Smith", "Annie Ann, Lee Smith!", "a.b axb a.bc", r"x\Ey $1 \1", "éAnn Annü Zoë Zoëtje", "", None, "Ann", "AnnLee Ann", "ann-lee Ann\nLee"]
    names = [("s", f, o.lower(), o) for f, o in forms.items()] + [("s", "ann", "p9", "P9"), (None, "Ann", "p", "P"), ("t", "Ann", "q", "Q$0")]
    table = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)] + [("t", 99, "Ann ann"), ("u", 100, "Ann")], "session string, id long, text string")
    got = {r.id: r.renamed for r in identity.renamed(table, spark.createDataFrame(names, "session string, form string, agent string, other string")).collect()}
    assert got == {**{i: renamed(t, forms) for i, t in enumerate(texts)}, 99: "Q$0 ann", 100: "Ann"}


def test_surface_forms(spark):
    rows = spark.createDataFrame([("ann_lee",), ("al_bo_cy",), ("solo",)], "slug string").select("slug", identity.surface_forms(F.col("slug")).alias("f")).collect()
    assert {r.slug: r.f for r in rows} == {"ann_lee": ["ann_lee", "Ann Lee", "Ann", "Lee"], "al_bo_cy": ["al_bo_cy", "Al Cy"], "solo": ["solo", "Solo Solo", "Solo"]}


def test_index_versions_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    words = "red green blue one two three four tea ann".split()
    docs = [(rng.randint(0, 2), f"d{i:03}", " ".join(rng.choices(words, k=rng.randint(0, 9))), i // 20) for i in range(60)] + [(1, "d900", None, 2)]
    queries = spark.createDataFrame([(i, i % 3, " ".join(rng.choices(words, k=3))) for i in range(9)] + [(90, 7, "red"), (91, 1, "")], "question_id long, scope long, text string")
    table, folder = spark.createDataFrame(docs, "scope long, doc_id string, text string, day long"), f"file://{tmp_path}/index"
    assert postings.version_of(spark, folder) == 0
    for day in range(3):
        assert postings.add(table.where(F.col("day") == day).drop("day"), folder) == day + 1
        spark.range(3).write.mode("append").parquet(f"{folder}/postings/version={day + 2}")  # what a lost attempt at the next one left
        for version in (day + 1, 1):
            upto = table.where(F.col("day") < version).drop("day")
            want = retrieval.bm25(upto, queries).collect()
            assert sorted(postings.search(spark, folder, queries, version=version).collect()) == sorted(want)
    plan = postings.search(spark, folder, queries, version=2)._jdf.queryExecution().toString()
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(version", plan)) >= 3  # later versions' folders stay shut


def test_stages_resume(spark, tmp_path):
    folder, ran = f"file://{tmp_path}/s", []

    def go(rows, version="1", fail=False):
        docs = spark.createDataFrame(rows, "id long, n long").repartition(2)
        one = stages.staged(spark, folder, "one", {"docs": docs}, lambda docs: docs.select("id", (F.col("n") % 10).alias("n")), version)
        two = stages.staged(spark, folder, "two", {"one": one}, lambda one: one.agg(F.sum("n" if not fail else "gone").alias("n")))
        ran.append((one.ran, two.ran))
        return two.df.collect()[0][0]

    assert go([(1, 2), (2, 3), (2, 3)]) == 8
    assert go([(2, 3), (1, 2), (2, 3)]) == 8  # another order
    assert go([(2, 3), (1, 12), (2, 3)]) == 8  # the second stage finds what it had
    assert go([(2, 3), (1, 4), (2, 3)]) == 10
    assert go([(1, 2), (2, 3), (2, 3)], version="2") == 8
    with pytest.raises(Exception):
        go([(5, 5)], fail=True)
    assert go([(5, 5)]) == 5  # half done: the first stage is there, the second runs again
    assert ran == [(True, True), (False, False), (True, False), (True, True), (True, False), (False, True)]
    assert stages.records(spark, folder).count() == 8


def test_digests(spark):
    table = lambda rows, shape="a long, b string": spark.createDataFrame(rows, shape)
    one = stages.digest(table([(1, "x"), (None, None)]))
    assert one == stages.digest(table([(None, None), (1, "x")])) != stages.digest(table([(1, None), (None, "x")]))
    assert len({one, stages.digest(table([(1, "x"), (None, None)] * 2)), stages.digest(table([])), stages.digest(table([(1, "x"), (None, None)], "a long, c string"))}) == 4


def test_only_listed_cells_are_opened(spark, tmp_path):
    cell = lambda *d: json.dumps({"details": [{"question_id": q, "correct": c} for q, c in d]}, indent=1)
    for name, text in {"a/1/r.json": cell(("q1", "True"), ("q2", "no")), "a/2/r.json": cell(("q3", "1")), "b/1/r.json": cell(("q4", "true")), "c/1/r.json": cell(("q5", "1")), "d/1/r.json": cell(("q6", "1"))}.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    for name, text in {"a": '{"judges": {"j": {"status": "running"}, "k": {"status": "done"}}}', "b": "{cut", "c": "{}"}.items():
        (tmp_path / name / "progress.json").write_text(text)
    rows = [("main", "a/1/r.json"), ("main", "a/2"), ("ablation", "b/1/"), ("latency", "c/1"), ("main", "none"), ("main", None), ("main", "x/y.json"), ("other", "d/1/r.json")]
    index = spark.createDataFrame(rows, "kind string, json_path string")
    names = lambda files: sorted(r.file.split(f"{tmp_path}/")[1] for r in files.collect())
    glob = f"{tmp_path}/*/progress.json"
    assert names(stages.cell_files(spark, str(tmp_path), index, ["main", "ablation"])) == ["a/1/r.json", "a/2/r.json", "b/1/r.json"]
    assert names(stages.cell_files(spark, str(tmp_path), index, ["main", "ablation"], "j", glob)) == ["b/1/r.json"]
    files = stages.cell_files(spark, f"file://{tmp_path}/", index, ["main", "ablation", "latency"], "k", glob)
    (tmp_path / "d/1/r.json").write_text("x" * 10)  # not listed, so not read
    assert sorted((r.json_path, r.question_id, r.correct) for r in stages.indexed_cells(spark, files).collect()) == [("a/1/r.json", "q1", True), ("a/1/r.json", "q2", False), ("a/2", "q3", True), ("b/1", "q4", True), ("c/1", "q5", True)]
    assert stages.indexed_cells(spark, stages.cell_files(spark, str(tmp_path), index, ["nothing"])).collect() == []
