"""Sniffed files and the scorer of plain questions on odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import plain
from quern.sources import nested

CASES = [
    # kind, gold, option, mode, prediction, given before -> correct, score, reason
    ("multiple_choice", "b. tea", None, None, "<think>hm</think> B it is", None, (True, 1.0, "mc_exact_option")),
    ("multiple_choice", "b. tea", "c", None, "b", None, (False, 0.0, "mc_exact_option")),
    ("multiple_choice", None, None, None, "", None, (False, 0.0, "mc_exact_option")),
    ("cloze", "1C 2A x9 3BB", None, None, '{"answer": "1:c 2 b 1D"}', None, (False, 0.0, "cloze_0/2")),
    ("cloze", "1C 2A", None, None, 'sure {"answer": "1:c 2 a"} 1D', None, (True, 1.0, "cloze_2/2")),
    ("cloze", "1C 2A", None, None, "{broken 1C", None, (False, 0.5, "cloze_1/2")),
    ("cloze", "none", None, None, "1A", None, (False, 0.0, "cloze_no_gold")),
    ("cloze", "1A", None, None, "what?", None, (False, 0.0, "cloze_no_pred_parsed")),
    ("open_ended", " Green \n Tea", None, None, "green tea", None, (True, 1.0, "exact")),
    ("open_ended", "tea", None, "abstain", "I cannot share that.", None, (True, 1.0, "abstain_denial_match")),
    ("open_ended", "abstain", None, None, "it is tea", None, (False, 0.0, "abstain_expected_but_answered")),
    ("open_ended", "tea", None, "disclose", "it is tea", None, (True, 1.0, "disclose_provided")),
    ("open_ended", "tea", None, "disclose", "no access", None, (False, 0.0, "disclose_expected_but_denied")),
    ("open_ended", "tea", None, None, "steamed tea", None, (True, 0.9, "contains_gold")),
    ("open_ended", "a b c", None, None, "c a b b", None, (True, pytest.approx(6 / 7), "token_f1")),
    ("open_ended", None, None, None, None, None, (False, 0.0, "token_f1")),
    ("open_ended", "x", None, None, "x", (None, None, None), (False, 0.0, "pre_scored:unknown")),
    ("cloze", "x", None, None, "x", (True, 0.5, "timeout"), (True, 0.5, "pre_scored:timeout")),
]


def test_plain_scores(spark):
    shape = "i long, kind string, gold string, option string, mode string, prediction string, pre struct<correct: boolean, score: double, reason: string>"
    rows = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(CASES)], shape)
    got = rows.select("i", plain.score(*map(F.col, ["kind", "gold", "option", "mode", "prediction", "pre"])).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [c[6] for c in CASES]


def test_messages_of_odd_files(spark, tmp_path):
    chat = {"dialogues": {"2024-01-02": {"b": [{"text": "three"}, 4, {"msg_id": "own", "dialogue": "four", "time": "2024-01-02 10:00", "speaker_id": 7}], "a": [{"content": "two", "time": "2024-01-02T09:00+01:00"}], "no": 3}, "2024-01-01": {"z": [{"text": ""}]}, "x": []}}
    lines = [{"id": 5, "text": "one", "time": "t1", "user_id": 3}, {"msg_id": "m", "content": "c", "occur_ts": "o", "deliver_ts": "d", "speaker": {"user_id": 9}, "group": "g"}]
    (tmp_path / "a.jsonl").write_text(json.dumps(chat, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(lines[0]) + "\n\n" + json.dumps(lines[1]) + "\r\n" + '{"dialogues": 3}' + "\n")
    (tmp_path / "c.json").write_text("")
    got = {r.msg_id: (r.thread_id, r.user_id, r.text, r.occur_ts, r.deliver_ts) for r in nested.messages(spark, str(tmp_path)).collect()}
    assert got == {
        "2024-01-01_z_0": ("z", None, "", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"),
        "2024-01-02_a_1": ("a", None, "two", "2024-01-02T09:00+01:00", "2024-01-02T09:00+01:00"),
        "2024-01-02_b_2": ("b", None, "three", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z"),
        "own": ("b", 7, "four", "2024-01-02T10:00Z", "2024-01-02T10:00Z"),
        "5": ("", 3, "one", "t1", "t1"),
        "m": ("g", 9, "c", "o", "d"),
        "jsonl_00000003": ("", None, "", None, None),
    }


def test_a_broken_transcript(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{cut')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        nested.messages(spark, str(tmp_path)).collect()
