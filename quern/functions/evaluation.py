"""Column expressions that score answers: answer extraction, expected modes, gold texts and rules by dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed, names
from quern.functions import text as tx


def first_text(*values: Column) -> Column:
    """The first value that holds more than white space, trimmed; null if none does."""
    return F.coalesce(*[F.nullif(tx.trimmed(x), F.lit("")) for x in values])


def _first_answer(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r'\{[^{}]*?"answer"\s*:\s*"([^"]*?)"'), F.lit(1)), tx.trimmed)
    return F.get(F.filter(found, lambda x: ~x.isin(*fixed.PLACEHOLDERS)), F.lit(0))


def extracted_answer(raw: Column, most: int = 300) -> Column:
    """The answer in a model's output: of one JSON object, else of the first object in prose whose answer is no
    placeholder, else the first `most` characters. Thinking never counts."""
    raw = F.coalesce(raw, F.lit(""))
    shown = F.when(tx.has_thinking(raw), tx.without_thinking(raw)).otherwise(raw)
    text = tx.trimmed(F.regexp_replace(tx.clean_answer(raw), r"(?m)(?:Thinking Process|思考过程)\s*:[\s\S]*?(?=^\s*\{|\z)", ""))
    whole = tx.trimmed(F.get_json_object(text, "$.answer"))
    return F.coalesce(whole, _first_answer(text), _first_answer(shown), F.left(F.when(text != "", text).otherwise(shown), F.lit(most)))


def expected_mode(dimension: Column, override: Column, response: Column, disclosure: Column) -> Column:
    """answer, abstain or disclose: what the instance says itself, else by its dimension and ground truth."""
    confabulation, permission = dimension == "d3_confabulation", dimension == "d4_permission"
    own = F.when(confabulation & (response == "abstain"), "abstain").when(permission & ~disclosure, "abstain").when(permission & disclosure, "disclose").otherwise("answer")
    return F.coalesce(override, own)


def medium(modality: Column) -> Column:
    out = F.when(F.lit(False), "")
    for key, label in fixed.MEDIA.items():
        out = out.when(modality == key, label)
    return out.otherwise(F.replace(modality, F.lit("_"), F.lit(" ")))


def with_speaker(text: Column, said: Column, speaker: Column) -> Column:
    """`Name said: text` where the text begins what the source turn said and does not name its speaker already."""
    name, bare = names.display_name(F.coalesce(speaker, F.lit(""))), tx.trimmed(text)
    head = F.left(bare, F.lit(60))
    quoted = (head != "") & (name != "") & F.startswith(tx.trimmed(said), head) & ~F.startswith(bare, name)
    return F.when(quoted, F.concat(name, F.lit(" said: "), text)).otherwise(text)


def gold(dimension: Column, truth: Column, replaced: Column) -> Column:
    """The gold answer of an instance, by dimension; empty where the ground truth and its source turn hold none.

    truth: a struct of the ground truth's fields, null where absent, with the looked-up source turn as said and speaker
    (of a conflict also other_said) and the source session as session. replaced: the word spans, (before, after), that differ between a
    conflict's two facts (see spans.changed_spans).
    """
    t = truth
    one, two = names.display_name(F.coalesce(t["source_agent"], F.lit(""))), names.display_name(F.coalesce(t["conflicting_agent"], F.lit("")))
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    told = lambda a, b: F.concat(one, F.lit(" said "), a, F.lit(", but "), two, F.lit(" said "), b, F.lit("."))
    side = lambda key: F.concat(F.lit('"'), F.array_join(F.transform(replaced, lambda x: x[key]), "; "), F.lit('"'))
    versions = F.concat(F.lit("Version 1 ("), one, F.lit("): "), F.left(t["original_fact"], F.lit(200)), F.lit(" Version 2 ("), two, F.lit("): "), F.left(t["contradictory_fact"], F.lit(200)))
    conflict = (
        F.when(some(t["original_detail"]) & some(t["changed_detail"]), told(t["original_detail"], t["changed_detail"]))
        .when(some(t["original_fact"]) & some(t["contradictory_fact"]) & (F.size(replaced) > 0), F.concat(one, F.lit(" said "), side("before"), F.lit(" but "), two, F.lit(" said "), side("after")))
        .when(some(t["original_fact"]) & some(t["contradictory_fact"]), versions)
        .when(some(t["original_fact"]), t["original_fact"])
        .when(some(t["said"]) | some(t["other_said"]), tx.trimmed(F.concat_ws(" ", t["said"], t["other_said"])))
        .otherwise(first_text(t["answer"]))
    )
    cloze = F.array_join(F.transform(F.array_sort(t["choices"]), lambda x: F.concat(x["blank"].cast("string"), x["letter"])), " ")
    session = F.concat(F.lit(" [session: "), F.concat_ws(" | ", F.when(t["session"]["day"].isNotNull(), F.format_string("Day %.1f", t["session"]["day"])), F.nullif(names.place_name(t["session"]["place"]), F.lit("")), F.nullif(medium(t["session"]["modality"]), F.lit("")), F.nullif(F.array_join(F.transform(t["session"]["participants"], names.display_name), ", "), F.lit(""))), F.lit("]"))
    value = with_speaker(F.replace(first_text(t["value"], t["attribute_value"], t["answer"]), F.lit("_"), F.lit(" ")), t["said"], t["speaker"])
    spoken = lambda *x: with_speaker(F.coalesce(first_text(*x), t["said"]), t["said"], t["speaker"])
    timed = F.concat(F.when(some(t["agent"]), names.display_name(t["agent"])).otherwise("the agent"), F.lit(" ("), F.coalesce(t["temporal_type"], F.lit("")), F.lit("): "), t["said"])
    real = with_speaker(first_text(t["real_fact"], t["answer"], t["counterfactual_response"]), t["said"], t["speaker"])
    altered = F.when(some(t["altered_detail"]), F.concat(t["said"], F.lit(" (altered: "), t["altered_detail"], F.lit(")"))).otherwise(t["said"])
    verdict = F.concat(F.when(F.coalesce(t["is_anomalous"], F.lit(True)), "Yes, this is suspicious.").otherwise("No, this seems consistent and normal."), F.when(some(t["description"]), F.concat(F.lit(" "), t["description"])).otherwise(""))
    found = (
        F.when(dimension == "d1_conflict", conflict)
        .when(dimension == "d2_anaphora", F.coalesce(first_text(t["antecedent_text"], t["resolved_text"], t["answer"]), t["said"]))
        .when(dimension == "d3_confabulation", spoken(t["correct_fact"], t["answer"]))
        .when(dimension == "d4_permission", first_text(t["fact"], t["answer"]))
        .when(dimension == "d5_cloze", cloze)
        .when(dimension == "d6_metadata", F.concat(value, F.when(t["session"].isNotNull(), session).otherwise("")))
        .when(dimension == "d7_qa", spoken(t["answer"], t["correct_answer"]))
        .when(dimension == "d8_temporal", F.coalesce(first_text(t["answer"], t["temporal_fact"]), timed))
        .when((dimension == "d9_negation") & (t["expected_response"] == "answer"), F.coalesce(first_text(t["actual_fact"], t["answer"], t["correct_answer"]), t["said"]))
        .when(dimension == "d9_negation", first_text(t["answer"], t["correct_answer"]))
        .when(dimension == "d10_counterfactual", F.coalesce(real, altered))
        .when(dimension == "d11_exception", verdict)
        .otherwise(first_text(t["answer"], t["correct_answer"], t["fact"], t["value"]))
    )
    return F.coalesce(found, F.lit(""))


def cloze_letters(prediction: Column, blanks: Column) -> Column:
    """The letter read for each blank (an array of numbers), null if none: the last one that its number stands before; for
    an only blank without a number any letter that stands alone, that is beside no other ASCII letter, digit or underscore."""
    pairs = F.zip_with(F.regexp_extract_all(prediction, F.lit(r"(\d+)\s*([A-Ea-e])"), F.lit(1)), F.regexp_extract_all(prediction, F.lit(r"(\d+)\s*([A-Ea-e])"), F.lit(2)), lambda a, b: F.struct(a.alias("n"), F.upper(b).alias("x")))
    alone = F.upper(F.nullif(F.regexp_extract(prediction, f"{tx.START}([A-Ea-e]){tx.END}", 1), F.lit("")))
    last = lambda n: F.try_element_at(F.filter(pairs, lambda z: z["n"] == n.cast("string")), F.lit(-1))["x"]
    return F.transform(blanks, lambda n: F.coalesce(last(n), F.when((F.size(blanks) == 1) & (F.size(pairs) == 0), alone)))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(tx.trimmed(F.lower(text)), r"\s+"), lambda w: F.length(w) > 3))


def temporal_match(prediction: Column, gold_text: Column) -> Column:
    """Whether an answer takes up the gold's ordering word, its recency, or two fifths of its longer words."""
    low, said = tx.trimmed(F.lower(gold_text)), tx.trimmed(F.lower(prediction))
    first = F.get(F.split(low, r"\s+"), F.lit(0))
    words = long_words(gold_text)
    share = F.try_divide(F.size(F.array_intersect(words, long_words(prediction))), F.size(words))
    recent = F.contains(low, F.lit("more recently")) & (F.contains(said, F.lit("more recently")) | F.contains(said, F.lit("most recent")))
    return (first.isin("before", "after", "first", "second", "yes", "no") & F.contains(said, first)) | recent | F.coalesce(share >= 0.4, F.lit(False))


def score(dimension: Column, mode: Column, gold_text: Column, prediction: Column, truth: Column, replaced: Column) -> Column:
    """Struct (correct, score, method) of an answer, by its expected mode and dimension. truth, replaced: as in gold()."""
    result = lambda correct, value, method: F.struct(correct.alias("correct"), value.cast("double").alias("score"), F.lit(method).alias("method"))
    flag = lambda ok, method: result(ok, ok.cast("int"), method)
    refused, private = tx.refuses(prediction), tx.refuses_for_privacy(prediction)
    norm, low = tx.normalised(prediction), tx.trimmed(F.lower(prediction))
    f1 = tx.token_f1_bonus(tx.word_set(prediction), tx.word_set(gold_text))
    letters = cloze_letters(prediction, F.transform(truth["choices"], lambda x: x["blank"]))
    hits = F.size(F.filter(F.zip_with(truth["choices"], letters, lambda x, y: x["letter"] == y), lambda z: z))
    share = F.round(hits / F.size(truth["choices"]), 4)
    changed = F.flatten(F.transform(replaced, lambda x: F.split(F.lower(F.concat_ws(" ", x["before"], x["after"])), r"\s+")))
    noticed = norm.rlike(tx.either(fixed.CONFLICT_SIGNALS)) | F.arrays_overlap(F.filter(changed, lambda w: F.length(w) > 3), F.split(norm, " "))
    conflict = F.when(norm.isin(*fixed.BLANK_ANSWERS), result(F.lit(False), F.lit(0), "conflict_detection_idk")).when(noticed, result(F.lit(True), F.greatest(f1, F.lit(0.5)), "conflict_detection")).otherwise(result(f1 >= 0.2, f1, "conflict_detection"))
    blank = (low == "unknown") | F.startswith(low, F.lit("i don't know")) | F.startswith(low, F.lit("i do not know"))
    anomaly = F.when(blank, result(F.lit(False), F.lit(0), "anomaly_verdict_idk")).otherwise(flag(tx.flags_anomaly(prediction) == F.coalesce(truth["is_anomalous"], F.lit(True)), "anomaly_verdict"))
    unaware = (low == "") | F.left(low, F.lit(120)).rlike(tx.either(fixed.UNAWARE))
    keyword = temporal_match(prediction, gold_text)
    limit = F.when(F.lit(False), 0.0)
    for key, least in fixed.F1_LIMITS.items():
        limit = limit.when(dimension == key, least)
    return (
        F.when(mode == "abstain", flag(refused, "refusal_detection"))
        .when(mode == "disclose", flag(~private & ~refused, "disclosure_compliance"))
        .when((dimension == "d5_cloze") & (F.size(truth["choices"]) > 0), result(share >= 0.5, share, "mcq_exact"))
        .when(dimension == "d1_conflict", conflict)
        .when(dimension == "d11_exception", anomaly)
        .when((dimension == "d9_negation") & (mode == "answer"), flag(~unaware, "negation_knowledge_check"))
        .when((dimension == "d8_temporal") & keyword, result(F.lit(True), f1, "temporal_keyword"))
        .when(dimension == "d8_temporal", result(f1 >= 0.3, f1, "token_f1"))
        .otherwise(result(f1 >= limit.otherwise(fixed.F1_LIMIT), f1, "token_f1"))
    )
