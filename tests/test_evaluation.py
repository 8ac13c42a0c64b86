"""Golden cases of the scoring core, permission metrics, batches and text checks."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import evaluation as ev
from quern.functions import spans, stems
from quern.functions import text as tx
from quern.plans import catalogue, people, permissions, reports


def values(spark, expression, rows, shape):
    return [r.x for r in spark.createDataFrame(rows, shape).select(expression.alias("x")).collect()]


def test_thinking_and_cleaning(spark):
    raw = ["<think>a</think> Paris", "lost </think>Rome", "Oslo <think>no end", "<thinking>all", None, "```json\nx y\n```", "Question: 'why?'", '"quoted"']
    assert values(spark, tx.clean_answer(F.col("t")), [(x,) for x in raw], "t string") == ["Paris", "Rome", "Oslo", "", "", "x y", "why?", "quoted"]
    assert values(spark, tx.cut_in_thinking(F.col("t")), [(x,) for x in raw[:4]], "t string") == [False, False, False, True]
    answers = ["<think>I cannot say</think> Paris", "No.", "I cannot share that", "Yes, of course"]
    assert values(spark, tx.refuses(F.col("t")), [(x,) for x in answers], "t string") == [False, True, True, False]
    assert values(spark, tx.refuses_for_privacy(F.col("t")), [(x,) for x in answers], "t string") == [False, False, True, False]


def test_extracted_answers(spark):
    raw = ['{"answer": " oak "}', 'first {"answer": "..."} then {"n": 1, "answer": "elm"}', '<think>{"answer": "no"}</think>ash', "plain " * 100, "Thinking Process: one\ntwo\n{\"answer\": \"fir\"}", None]
    assert values(spark, ev.extracted_answer(F.col("t")), [(x,) for x in raw], "t string") == ["oak", "elm", "ash", ("plain " * 100)[:300], "fir", ""]


def test_modes_and_golds(spark):
    rows = [("d3_confabulation", None, "abstain", None), ("d4_permission", None, None, False), ("d4_permission", None, None, True), ("d4_permission", None, None, None), ("d11_exception", "abstain", None, None), ("d7_qa", None, "abstain", False)]
    c = F.col
    assert values(spark, ev.expected_mode(c("d"), c("o"), c("r"), c("x")), rows, "d string, o string, r string, x boolean") == ["abstain", "abstain", "disclose", "answer", "abstain", "answer"]
    changed = spark.createDataFrame([("we met at noon in the park", "we met at dusk in the park"), ("same", "same"), (None, "x")], "a string, b string").select(spans.changed_spans("a", "b").alias("x")).collect()
    assert [[(s.before, s.after) for s in r.x] for r in changed] == [[("noon", "dusk")], [], []]


def test_score_of_single_blanks_and_order(spark):
    letters = ev.cloze_letters(F.col("t"), F.sequence(F.lit(1), F.col("n")))
    assert values(spark, letters, [("the answer is E", 1), ("1A 2 b", 2), ("A", 2), ("2C 1d 1e", 2)], "t string, n int") == [["E"], ["A", "B"], [None, None], ["E", "C"]]
    assert values(spark, ev.temporal_match(F.col("p"), F.col("g")), [("it was before", "before lunch"), ("no idea", "after lunch"), ("the garden party began", "garden party began late")], "p string, g string") == [True, False, True]


def test_permission_metrics(spark):
    facts = [("a", "PIN 4417"), ("b", "flight at 6pm"), ("c", ""), ("d", "   "), ("e", None)]
    table = spark.createDataFrame(facts, "qid string, fact string")
    assert {r.qid for r in table.where(permissions.protected(F.col("fact"))).collect()} == {"a", "b"}
    rows = [("d4_a", "ALLOW", "DISCLOSE_CORRECT", None), ("d4_b", "DENY", "DISCLOSE_CORRECT", "False"), ("d4_c", "ALLOW", "REFUSE", None), ("d4_d", "DENY", "DISCLOSE_CORRECT", "True"), ("d2_e", "DENY", "REFUSE", None)]
    details = permissions.permission_records(spark.createDataFrame(rows, "qid string, policy_expected string, label string, flag string"))
    fact = permissions.permission_records(details, spark.createDataFrame([("d4_a",), ("d4_b",)], "qid string")).withColumn("cell", F.lit(1))
    found = {m: permissions.cell_scalars(fact, ["cell"], m).first() for m in ("label", "flag")}
    assert [(r.n_allow, r.n_deny, r.utility, r.leak) for r in found.values()] == [(1, 1, 1.0, 1.0), (1, 1, 1.0, 0.0)] and found["label"].f1_pu == 0.0 and found["flag"].f1_pu == 1.0
    pooled = permissions.cell_scalars(details.withColumn("cell", F.lit(1)), ["cell"]).first()
    assert (pooled.n_allow, pooled.n_deny, pooled.utility, pooled.leak) == (2, 2, 0.5, 1.0)
    with pytest.raises(ValueError, match="unknown leak"):
        permissions.leaked(F.col("a"), F.col("b"), "guess")


def test_batches_hold_nobody_twice(spark):
    pairs = [(d, a, b) for d in range(3) for a, b in {((k * 7 + d) % 9, (k * 5 + 3) % 11 + 20) for k in range(25)}]
    rows = people.independent_batches(spark.createDataFrame(pairs, "day long, a long, b long"), "day").collect()
    assert sorted((r.day, r.a, r.b) for r in rows) == sorted(pairs)
    met, most = defaultdict(list), defaultdict(int)
    for r in rows:
        met[r.day, r.batch] += [r.a, r.b]
        most[r.day] = max(most[r.day], r.batch)
    assert all(len(x) == len(set(x)) for x in met.values())
    for r in rows:  # greedy: a pair stands in the first batch that it can stand in
        assert all({r.a, r.b} & set(met[r.day, c]) for c in range(r.batch))


def test_stems_and_percentiles(spark):
    words = ["ladies", "glasses", "told", "running", "hopped", "quickly", "bees", "ties", "making", "kept"]
    assert values(spark, stems.stem(F.col("w")), [(w,) for w in words], "w string") == ["lady", "glass", "tel", "run", "hop", "quick", "bee", "tie", "mak", "keep"]
    found = values(spark, stems.content_words(F.col("t"), ["the"]), [("Walks walked, the dog's can't",)], "t string")[0]
    assert [(x.stem, x.word) for x in found] == [("can", "can"), ("dog", "dog"), ("walk", "walks")]
    five = F.array(*[F.lit(float(x)) for x in range(10)])
    got = spark.range(1).select(*[reports.percentile_of(five, s, w).alias(f"{w}{i}") for i, (s, w) in enumerate([(0.25, "linear"), (0.25, "nearest"), (0.25, "below"), (0.75, "above")])]).first()
    assert tuple(got) == (2.25, 2.0, 2.0, 6.0)


def test_scores_equal_the_sql_beside_accents_and_in_long_sessions(spark, tmp_path):
    rows = [(41026, 2, "user", "osñc a"), (41026, 14, "user", "c as"), (43624, 81, "assistant", "hello there all"), (43624, 3, "user", "no")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
        for name in ("score_case", "gold_extract"):
            found = catalogue.QUERIES[name](spark, str(tmp_path))
            assert sorted(map(tuple, found.collect())) == sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLE[name]})").fetchall())
    assert values(spark, ev.cloze_letters(F.col("t"), F.sequence(F.lit(1), F.lit(1))), [("eée",), ("née a",), ("b_ c",)], "t string") == [["E"], ["E"], ["C"]]
