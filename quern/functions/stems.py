"""Stemmed content words, and checks that a question does not give its fact away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as tx


def stem(word: Column) -> Column:
    """A lower-case word without plural, then irregular forms put right, then without one of ing, ed, ly, a doubled last
    letter, a last e, and with y for a last i. Different words may share a stem, which only makes checks stricter."""
    singular = F.regexp_replace(F.regexp_replace(word, "^(.{2,})ies$", "$1y"), "^(.{2,}[^s])s$", "$1")
    table = F.create_map(*[F.lit(x) for pair in fixed.IRREGULAR.items() for x in pair])
    regular = F.coalesce(F.try_element_at(table, singular), singular)
    bare = F.regexp_replace(F.regexp_replace(regular, "^(.{3,}?)(?:ing|ed|ly)$", "$1"), r"^(.{2,})(.)\2$", "$1$2")
    return F.regexp_replace(F.regexp_replace(bare, "^(.{3,})e$", "$1"), "^(.{3,})i$", "$1y")


def _bare_words(text: Column) -> Column:
    """Lower-case words without clitics, negations put right."""
    low = F.regexp_replace(F.lower(text), "[’‘]", "'")
    negated = F.create_map(*[F.lit(x) for pair in fixed.NEGATIONS.items() for x in pair])
    bare = lambda w: F.regexp_replace(F.coalesce(F.try_element_at(negated, w), w), "(?:" + "|".join(fixed.CLITICS) + ")$", "")
    return F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9]+(?:'[a-z]+)*"), F.lit(0)), bare)


def content_words(text: Column, stop: list[str]) -> Column:
    """Array of (stem, word) of a short text: its words that are no stop words, the first one of each stem, by stem. For
    long texts see stem_rows()."""
    words = F.array_distinct(F.filter(_bare_words(text), lambda w: (F.length(w) >= 2) & ~w.isin(stop)))
    pairs = F.filter(F.transform(words, lambda w: F.struct(stem(w).alias("stem"), w.alias("word"))), lambda x: ~x["stem"].isin(stop))
    stems = F.transform(pairs, lambda x: x["stem"])
    return F.array_sort(F.filter(pairs, lambda x, i: F.array_position(stems, x["stem"]) == i + 1))


def stem_rows(rows: DataFrame, keys: list[str], text: str, stop: list[str]) -> DataFrame:
    """keys, stem, word: the content words of each row's text, the first one of each stem."""
    words = rows.select(*keys, F.posexplode(_bare_words(F.col(text))).alias("i", "word")).where((F.length("word") >= 2) & ~F.col("word").isin(stop))
    first = words.groupBy(*keys, "word").agg(F.min("i").alias("i")).withColumn("stem", stem(F.col("word"))).where(~F.col("stem").isin(stop))
    return first.groupBy(*keys, "stem").agg(F.min_by("word", "i").alias("word"))


def query_problems(question: Column, fact: Column, target: Column, stop: list[str], allowed: list[str], most: float = 0.5) -> Column:
    """Array of (check, detail) for every check that a question fails: it shares content words with the fact, is too like
    it, cues secrecy, does not name its target, holds a placeholder, or asks nothing."""
    q, f = content_words(question, stop), content_words(fact, stop)
    shared = F.filter(q, lambda x: F.exists(f, lambda y: x["stem"] == y["stem"]) & ~x["stem"].isin(allowed))
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "")
    low = F.regexp_replace(F.lower(question), "’", "'")
    problem = lambda ok, check, detail: F.when(ok, F.array(F.struct(F.lit(check).alias("check"), detail.alias("detail")))).otherwise(F.array().cast("array<struct<check:string,detail:string>>"))
    return F.concat(
        F.transform(shared, lambda x: F.struct(F.lit("content").alias("check"), x["word"].alias("detail"))),
        problem(tx.jaccard(words(question), words(fact)) > most, "jaccard", F.lit("too like the fact")),
        *[problem(low.rlike(r"\b" + cue), "banned", F.lit(cue)) for cue in fixed.SECRECY_CUES],
        problem(~F.contains(F.concat(F.lit(" "), F.regexp_replace(question, r"\W", " "), F.lit(" ")), F.concat(F.lit(" "), target, F.lit(" "))), "form", F.lit("does not name the target")),
        problem(question.rlike(r"[{}]"), "form", F.lit("unfilled placeholder")),
        problem(~F.contains(question, F.lit("?")), "form", F.lit("not a question")),
    )


def keeps_a_cue(question: Column, cues: list[str], stop: list[str]) -> Column:
    """Whether a question holds one of the topic's cue words, by stem; without cue words it does."""
    if not cues:
        return F.lit(True)
    wanted = F.array(*[stem(F.lit(x.lower())) for x in cues])
    return F.arrays_overlap(F.transform(content_words(question, stop), lambda x: x["stem"]), wanted)


def repaired_json(text: Column) -> Column:
    """JSON of a model put right as far as that is safe: trailing commas go, single quotes become double ones where there are
    more of them, control characters become spaces."""
    fixed_commas = F.regexp_replace(text, r",\s*([}\]])", "$1")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    quotes = F.when(count(fixed_commas, '"') < count(fixed_commas, "'"), F.replace(fixed_commas, F.lit("'"), F.lit('"'))).otherwise(fixed_commas)
    return F.regexp_replace(quotes, r"[\x00-\x1f]+", " ")


def string_leaves(text: Column) -> Column:
    """Array of the values of all strings in a JSON text, keys apart, in order."""
    found = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(found, lambda x: ~F.endswith(x, F.lit(":"))), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters, one at least for a text that is not empty."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0)


def truncated(text: Column, tokens: int) -> Column:
    """The start of a text that holds so many estimated tokens."""
    return F.left(text, F.lit(4 * tokens))
