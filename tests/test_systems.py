"""Memory systems by name, and the chains that tell owners and askers."""

import pytest

from quern.operators import adapters, askers

SESSIONS = [("s0", 0, []), ("s1", 1, ["ann"]), ("s2", 2, ["bob", "ann"]), ("s3", 3, ["cy", "bob"])]


def instance(i, meta=(None,) * 6, truth=(None,) * 5, ego=None, answerer=None, target=None):
    return (i, ego, answerer, target, meta, truth)


def meta(**k):
    return tuple(k.get(x) for x in ("ego_agent_id", "query_agent", "instance_query_agent", "answerer_agent_id", "target_agent", "evidence_sessions"))


def truth(**k):
    return tuple(k.get(x) for x in ("query_agent", "target_agent", "source_session", "attribute", "value"))


CASES = {
    "meta": (instance("meta", meta(query_agent="m"), truth(query_agent="t")), "m", "m"),
    "truth": (instance("truth", truth=truth(query_agent="t", target_agent="ann")), "t", "t"),
    "source": (instance("source", truth=truth(target_agent="ann", source_session="s2")), "ann", "bob"),
    "elsewhere": (instance("elsewhere", truth=truth(target_agent="bob", source_session="s1")), "bob", "ann"),
    "any": (instance("any", truth=truth(target_agent="cy", source_session="none")), "cy", "bob"),
    "alone": (instance("alone", truth=truth(target_agent="zed")), "zed", "zed"),
    "speaker": (instance("speaker", truth=truth(attribute="speaker", value="v", source_session="s3"), answerer="x"), "x", "cy"),
    "speaker of none": (instance("speaker of none", truth=truth(attribute="speaker", value="v", source_session="s0"), answerer="x"), "x", "x"),
    "answerer": (instance("answerer", ego=" assistant ", answerer="x"), "x", "x"),
    "assistant": (instance("assistant", meta(evidence_sessions=["s0", "none", "s3", "s1"]), answerer="__assistant__"), "", "cy"),
    "nothing": (instance("nothing", meta(target_agent=" last ")), "last", ""),
}


def test_owners_and_askers(spark):
    rows = spark.createDataFrame([x[0] for x in CASES.values()], askers.INSTANCE)
    found = askers.with_askers(rows, spark.createDataFrame(SESSIONS, "session_id string, place long, people array<string>"))
    assert {r.instance_id: (r.owner, r.asker) for r in found.select("instance_id", askers.owner().alias("owner"), "asker").collect()} == {k: x[1:] for k, x in CASES.items()}


def test_names():
    assert adapters.build(" InMem ").search is adapters.by_words and adapters.build("inmem_text_sessions").prompt_style == adapters.TEXT_SESSIONS
    assert adapters.build("zep", test_mode=True).search is adapters.by_words and adapters.build("oracle_gated", max_messages=3).options == {"gated": True, "max_messages": 3}
    for name in ("zep", "", None, "unheard"):
        with pytest.raises(ValueError):
            adapters.build(name)


def test_systems(spark):
    m = spark.createDataFrame([(1, "a", "x" * 40, "s1", 1), (1, "b", None, "s1", 2), (1, "c", "y" * 80, "s2", 3), (2, "d", "z", "s1", 1)], "scope long, doc_id string, text string, session string, at long")
    q = spark.createDataFrame([(10, 1, "x", ["s1", "s2", "s1"], False), (11, 1, "x", ["s2", "no"], True), (12, 9, "x", [], True)], "question_id long, scope long, text string, gold array<string>, allowed boolean")
    hits = lambda name, k=9, **o: sorted((r.question_id, r["rank"], r.doc_id) for r in adapters.build(name, **o).hits(m, q, k).collect())
    assert hits("vanilla", max_tokens=21) == [(10, 1, "c"), (10, 2, "b"), (11, 1, "c"), (11, 2, "b")]
    assert hits("vanilla", max_tokens=1) == [(10, 1, "c"), (11, 1, "c")]
    assert hits("oracle") == [(10, 1, "a"), (10, 2, "b"), (10, 3, "c"), (11, 1, "c")] and hits("oracle", 1) == [(10, 1, "a"), (11, 1, "c")]
    assert hits("oracle_gated") == [(11, 1, "c")] and hits("baseline_session") == []
