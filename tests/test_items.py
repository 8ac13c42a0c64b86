"""Instances as question items, source turns, line numbers and named things, against rules written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import names
from quern.sources import items, readers

TURNS = [("s1", 0, "t0", "ann", " one "), ("s1", 1, "t1", "bob", ""), ("s1", 2, "t2", "bob", "two"), ("s1", 10, "t3", "ann", "three"), ("s2", 0, "t0", "cy", None), (None, 0, "t0", "ann", "lost")]
SHAPE = "session_id string, position long, turn_id string, speaker_id string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, SHAPE)


def test_source_texts(spark, turns):
    asked = [
        (1, "s1", "t2", "ann", "two"), (2, "s1", "t1", None, ""), (3, "s1", "t9", "bob", ""), (4, "s1", "t9", "zed", "one two three"), (5, "s1", None, "ann", "one"), (6, "s1", "", "", "one two three"),
        (7, "s2", None, None, ""), (8, "none", "t0", "ann", ""), (9, None, "t0", "ann", ""), (10, "s1", "t2", "ann", "two"),
    ]
    rows = spark.createDataFrame([x[:4] for x in asked], "k long, session string, turn string, speaker string")
    assert {r.k: r.said for r in items.source_texts(rows, turns).collect()} == {x[0]: x[4] for x in asked}
    both = items.source_texts(rows.withColumn("other", F.when(F.col("k") > 5, "s1")), turns, other="other").collect()
    assert {r.k: r.other_said for r in both} == {x[0]: "one two three" if x[0] > 5 else "" for x in asked}
    assert items.source_texts(rows.limit(0), turns).count() == 0
    assert {r.said for r in items.source_texts(rows, turns.limit(0)).collect()} == {""}


CASES = [
    # dimension, ground truth, answer with turns, answer without, mode
    ("d1_conflict", {"original_detail": "blue", "changed_detail": "red", "source_agent": "ann_lee", "conflicting_agent": "assistant_1"}, "Ann Lee said blue, but AI Assistant said red.", None, "answer"),
    ("d1_conflict", {"original_detail": "blue", "original_fact": "a", "contradictory_fact": "b"}, "Original claim: a Contradictory claim: b", None, "answer"),
    ("d1_conflict", {"original_fact": "a"}, "a", None, "answer"),
    ("d1_conflict", {"original_session": "s1", "source_agent": "bob", "conflicting_session": "s1", "value": "v"}, "one two three", "v", "answer"),
    ("d1_conflict", {"original_session": "s1", "source_agent": "ann", "conflicting_session": "s1", "value": "v"}, "Original claim: one Contradictory claim: one two three", "v", "answer"),
    ("d1_conflict", {"original_session": "s9", "claim": " c "}, "c", None, "answer"),
    ("d2_anaphora", {"antecedent_text": "it", "referent": " Ann "}, "Ann: it", None, None),
    ("d2_anaphora", {"antecedent_session": "s1", "antecedent_turn": "t3", "referent": "Ann"}, "Ann: three", "Ann", None),
    ("d2_anaphora", {"antecedent_session": "s9", "referent": "Ann", "fact": "f"}, "f", "Ann", None),
    ("d3_confabulation", {"expected_response": " ABSTAIN ", "correct_fact": "x"}, "abstain", None, "abstain"),
    ("d3_confabulation", {"source_session": "s1", "source_turn": "t0"}, "one", '{"source_session":"s1","source_turn":"t0"}', "answer"),
    ("d4_permission", {"fact": "f"}, "f", None, "disclose"),
    ("d4_permission", {"fact": "f", "expected_disclosure": False}, "f", None, "abstain"),
    ("d4_permission", {}, "", None, "disclose"),
    ("d5_cloze", {"answer_letter": "C"}, "C", None, None),
    ("d5_cloze", {"blanks": {"blank_10": "x", "blank_2": "y"}, "choices": {"blank_10": {"answer_letter": "B"}}, "answer_letter": "C"}, "2A 10B", None, None),
    ("d5_cloze", {}, "", None, None),
    ("d6_metadata", {"attribute": "context", "source_turn": "t1", "source_session": "s1"}, "See turn t1 in session s1", None, None),
    ("d6_metadata", {"value": "", "attribute_value": "w"}, "w", None, None),
    ("d7_qa", {"answer": " a "}, " a ", None, None),
    ("d7_qa", {"source_session": "s1", "source_turn": "t2", "claim": "c"}, "two", "c", None),
    ("d8_temporal", {"claim": "c", "event": "e"}, "e", None, None),
    ("d9_negation", {"expected_response": "no_knowledge", "absent_agent": "ann_lee"}, "No, Ann Lee was not present in that conversation and would not know about it.", None, "answer"),
    ("d9_negation", {"expected_response": "no_knowledge"}, "No, the agent was not present in that conversation and would not know about it.", None, "answer"),
    ("d9_negation", {"actual_session": "s1", "actual_turn": "t3"}, "three", '{"actual_session":"s1","actual_turn":"t3"}', "answer"),
    ("d10_counterfactual", {"real_fact": "r", "altered_detail": "d"}, "r (altered: d)", None, "answer"),
    ("d10_counterfactual", {"source_session": "s1", "source_turn": "t2", "altered_detail": "d", "claim": "c"}, "two (altered: d)", "c", "answer"),
    ("d10_counterfactual", {"source_session": "s9", "altered_detail": "d", "claim": "c"}, "c", None, "answer"),
    ("d11_exception", {}, "No", None, "answer"),
    ("d11_exception", {"is_anomalous": False}, "Yes", None, "answer"),
    ("d12_new", {"correct_answer": "c", "value": "v"}, "c", None, None),
    ("d12_new", {}, "{}", None, None),
    ("d12_new", None, "{}", None, None),
]


def test_question_items(spark, turns, tmp_path):
    for d in {c[0] for c in CASES}:
        lines = [json.dumps({"instance_id": f"i{i}", "query": "Question: why?", "ground_truth": c[1], "ego_agent_id": "a"}) for i, c in enumerate(CASES) if c[0] == d]
        lines += ["", "{broken", json.dumps({"query": "no id"}), json.dumps({"instance_id": "x", "query": " "}), json.dumps({"instance_id": "y"})]
        (tmp_path / f"{d}.jsonl").write_text("\n".join(lines))
    rows = items.instances(spark, f"{tmp_path}/*.jsonl")
    got = {r.question_id: r for r in items.question_items(rows, turns).collect()}
    bare = {r.question_id: r for r in items.question_items(rows).collect()}
    assert set(got) == set(bare) == {f"i{i}" for i in range(len(CASES))}
    for i, (dimension, _, answer, without, mode) in enumerate(CASES):
        r = got[f"i{i}"]
        assert (r.question, r.dimension, r.answer, r.expected_answer_mode, r.difficulty) == ("why?", dimension, answer, mode, "medium"), CASES[i]
        assert bare[f"i{i}"].answer == (answer if without is None else without), CASES[i]
        assert (r.policy_expected is not None) == (dimension == "d4_permission") and (r.question_type == "cloze") == (dimension == "d5_cloze")
    contacts = spark.createDataFrame([("a", {"Ann": "friend"})], "agent string, contacts map<string, string>")
    owned = items.question_items(rows, turns, contacts).where("owner_contacts IS NOT NULL")
    assert {r.dimension for r in owned.collect()} == {"d4_permission"} and owned.count() == 3
    assert items.question_items(rows.limit(0), turns).count() == 0


def test_context_fields(spark, tmp_path):
    whole = {"instance_id": "i", "query": "q", "difficulty": "hard", "ego_context": [{"turn_id": "t1"}, {}, {"turn_id": " t2 "}], "metadata": {"query_agent": "bob", "n": 3}, "evidence_session_ids": ["s1"], "context_tier": "full", "ground_truth": {"session_id": "s4", "answer_letter": "B", "blank_word": "x"}}
    (tmp_path / "d5_cloze.jsonl").write_text(json.dumps(whole))
    r = items.question_items(items.instances(spark, f"{tmp_path}/*.jsonl")).first()
    assert (r.anchor_msg_id, r.ego_context_turn_ids, r.exclude_thread, r.n_blanks) == ("t2", ["t1", "", " t2 "], "s4", 1)
    assert (r.difficulty, r.instance_metadata, r.evidence_session_ids, r.context_tier) == ("hard", {"query_agent": "bob", "n": "3"}, ["s1"], "full")
    assert json.loads(r.gold_ground_truth) == whole["ground_truth"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a.txt": [f"line {i} " + "x" * (i % 50) for i in range(500)], "b.txt": [""] * 20 + ["end"], "c.txt": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((r.line, r.value) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(texts["a.txt"] + texts["b.txt"]))


def test_agent_numbers(spark, tmp_path):
    (tmp_path / "agents.jsonl").write_text('{"agent_id": "ann"}\n\n{broken\n{"agent_id": " bob "}\n{"agent_id": ""}\n{"name": "x"}\n{"agent_id": "ann"}\n')
    assert {(r.agent, r.line) for r in readers.agent_numbers(spark, str(tmp_path)).collect()} == {("ann", 6), ("bob", 3)}


THINGS = [
    ("I met Dr. Ann Lee and Ann Lee at Port Said.", ["Ann Lee", "Port Said"]),
    ("The Old Mill. Old  Mill\nRoad", ["Old  Mill\nRoad"]),
    ("xAnn Lee, Éann Lee, Ann LeeX", ["Ann Lee"]),
    ("Ann lee. Bob", []),
    ("", []),
    (None, []),
]


def test_named_things(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(THINGS)], "i long, t string")
    got = rows.select("i", names.named_things(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [x for _, x in THINGS]


def test_withheld(spark):
    made = "named_struct('evidence_session_ids', array('s'), 'context_tier', 'full', 'text', 'x', 'metadata', named_struct('evidence_sessions', array('s'), 'session_id', 's', 'agent', 'ann')) AS i"
    r = spark.range(1).selectExpr(made).select(items.withheld(F.col("i"), "t0").alias("i")).first().i.asDict(True)
    assert r == {"evidence_session_ids": [], "context_tier": "t0", "text": "x", "metadata": {"evidence_sessions": [], "session_id": "", "agent": "ann"}}


def test_frozen_cache(spark, tmp_path):
    row = lambda i, n, q, m, **more: json.dumps({"instance_id": i, "namespace": n, "query": q, "memories": m, "system": "mem0", "extractor_model": "e", **more})
    (tmp_path / "cache.jsonl").write_text("\n".join([row("a", "n", "q", ["old"]), "", row("a", "n", "q2", ["new"]), row("", "n", "q", None), row("b", "", "q", ["x"], error="late")]))
    cache = readers.frozen_cache(spark, str(tmp_path), system="mem0", extractor_model="e")
    asked = spark.createDataFrame([("a", "n", "q"), ("z", "n", "q2"), ("z", "n", "q"), ("b", "m", "q"), ("z", "", "q"), (None, None, None)], "instance_id string, namespace string, query string")
    got = sorted(((r.instance_id or "", r.namespace or "", r.query or ""), r.memories, r.errored, r.found_by) for r in readers.from_cache(asked, cache).collect())
    assert got == [
        (("", "", ""), [], False, "miss"), (("a", "n", "q"), ["new"], False, "instance"), (("b", "m", "q"), ["x"], True, "instance"),
        (("z", "", "q"), [], False, "miss"), (("z", "n", "q"), [], True, "query"), (("z", "n", "q2"), ["new"], False, "query"),
    ]
    for expected in ({"system": "zep"}, {"config": "A"}):
        with pytest.raises(Exception, match="cache mismatch: expected"):
            readers.frozen_cache(spark, str(tmp_path), **expected).collect()
    (tmp_path / "cut.jsonl").write_text("{broken")
    with pytest.raises(Exception, match="no JSON in line"):
        readers.frozen_cache(spark, str(tmp_path)).collect()
