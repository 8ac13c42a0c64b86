"""The scorer of questions without a dimension: options, blanks, refusals and overlap of words, one struct per answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as tx

# What a text that holds its gold counts, and the overlap from which on an answer is right.
HOLDS, ENOUGH = 0.9, 0.65


def squeezed(text: Column) -> Column:
    """Lower case, white space to single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def blanks(gold: Column) -> Column:
    """(number, letter) of a gold like `1C 2A`; other words are passed over."""
    words = F.filter(F.split(F.trim(gold), r"\s+"), lambda w: w.rlike("^[0-9]+[A-Za-z]$"))
    return F.transform(words, lambda w: F.struct(F.substring(w, 1, F.length(w) - 1).alias("n"), F.upper(F.right(w, F.lit(1))).alias("letter")))


def told_letters(prediction: Column) -> Column:
    """(number, letter A to D) that an answer tells, in its order; of an answer that is, or holds, an object with `answer`, that."""
    inner = lambda text: F.try_variant_get(F.try_parse_json(text), "$.answer", "string")
    whole = F.nullif(inner(prediction), F.lit(""))
    held = F.nullif(inner(F.regexp_extract(prediction, r"(?s)\{.*\}", 0)), F.lit(""))
    said = F.coalesce(whole, held, prediction)
    pattern = F.lit(r"([0-9]+)\s*:?\s*([A-Da-d])")
    return F.zip_with(F.regexp_extract_all(said, pattern, F.lit(1)), F.regexp_extract_all(said, pattern, F.lit(2)), lambda n, x: F.struct(n.alias("n"), F.upper(x).alias("letter")))


def score(kind: Column, gold: Column, option: Column, mode: Column, prediction: Column, pre: Column) -> Column:
    """Struct (correct, score, reason). kind: multiple_choice, cloze or another; option: the right letter, else the gold's first;
    mode: abstain, disclose or another; pre: a struct (correct, score, reason) that stands if it is not null. Nulls are empty."""
    result = lambda ok, value, reason: F.struct(ok.alias("correct"), value.cast("double").alias("score"), reason.alias("reason"))
    flag = lambda ok, yes, no: result(ok, ok.cast("int"), F.when(ok, yes).otherwise(no))
    gold, said = F.trim(F.coalesce(gold, F.lit(""))), tx.without_thinking(F.trim(F.coalesce(prediction, F.lit(""))))
    first = lambda c: F.upper(F.substring(c, 1, 1))
    right = first(F.trim(F.coalesce(F.nullif(option, F.lit("")), gold)))

    def cloze(want: Column, told: Column) -> Column:
        last = lambda n: F.try_element_at(F.filter(told, lambda t: t["n"] == n), F.lit(-1))["letter"]
        hits = F.size(F.filter(want, lambda w: last(w["n"]) == w["letter"]))
        found = result(hits == F.size(want), hits / F.size(want), F.concat(F.lit("cloze_"), hits.cast("string"), F.lit("/"), F.size(want).cast("string")))
        nothing = lambda reason: result(F.lit(False), F.lit(0), F.lit(reason))
        return F.when(F.size(want) == 0, nothing("cloze_no_gold")).when(F.size(told) == 0, nothing("cloze_no_pred_parsed")).otherwise(found)

    def plain(x: Column) -> Column:
        want, have = x["want"], x["have"]
        f1 = tx.multiset_f1(F.array_remove(F.split(have, " "), ""), F.array_remove(F.split(want, " "), ""))
        refused = tx.refuses(have)
        return (
            F.when((want == have) & (want != ""), result(F.lit(True), F.lit(1), F.lit("exact")))
            .when((mode == "abstain") | (want == "abstain"), flag(refused, "abstain_denial_match", "abstain_expected_but_answered"))
            .when(mode == "disclose", flag(~refused, "disclose_provided", "disclose_expected_but_denied"))
            .when((want != "") & F.contains(have, want), result(F.lit(True), F.lit(HOLDS), F.lit("contains_gold")))
            .otherwise(result(f1 >= ENOUGH, f1, F.lit("token_f1")))
        )

    other = tx.once(F.struct(squeezed(gold).alias("want"), squeezed(said).alias("have")), plain)
    letters = tx.once(F.struct(blanks(gold).alias("want"), told_letters(said).alias("told")), lambda x: cloze(x["want"], x["told"]))
    given = result(F.coalesce(pre["correct"], F.lit(False)), F.coalesce(pre["score"], F.lit(0.0)), F.concat(F.lit("pre_scored:"), F.coalesce(pre["reason"], F.lit("unknown"))))
    found = F.when(kind == "multiple_choice", flag((right != "") & (first(said) == right), "mc_exact_option", "mc_exact_option")).when(kind == "cloze", letters).otherwise(other)
    return F.when(pre.isNotNull(), given).otherwise(found)
