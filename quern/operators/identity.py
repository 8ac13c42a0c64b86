"""Other names for the people in texts: every form of a name, the longest first, in one pass over a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a name's neighbours must not be.
INSIDE = r"[\p{L}\p{N}_]"
#: Fixed value: forms of fewer characters are too common to be names.
SHORTEST = 3


def surface_forms(slug: Column) -> Column:
    """The forms that a name like ann_lee takes: itself, Ann Lee, Ann and Lee, without repeats and short ones."""
    parts = F.split(slug, "_")
    first, last = F.initcap(F.element_at(parts, 1)), F.initcap(F.element_at(parts, -1))
    return F.filter(F.array_distinct(F.array(slug, F.concat_ws(" ", first, last), first, last)), lambda x: F.length(x) >= SHORTEST)


def name_maps(names: DataFrame) -> DataFrame:
    """session, pattern, other of names (session, form, agent, other): a pattern of a session's forms, longest first, and the
    map from form to other name. A form that several agents have is the least agent's. As large as a session's people."""
    one = names.dropna().groupBy("session", "form").agg(F.min(F.struct("agent", "other")).alias("x"))
    forms = F.transform(F.sort_array(F.collect_list(F.struct((-F.length("form")).alias("n"), "form"))), lambda x: F.concat(F.lit(r"\Q"), F.replace(x["form"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    whole = F.concat(F.lit(f"(?<!{INSIDE})(?:"), F.array_join(forms, "|"), F.lit(f")(?!{INSIDE})"))
    return one.groupBy("session").agg(whole.alias("pattern"), F.map_from_entries(F.collect_list(F.struct("form", "x.other"))).alias("other"))


def remapped(text: Column, pattern: Column, other: Column) -> Column:
    """A text with the names that `pattern` finds, from left to right and the longest first, replaced by `other`'s. A text
    without a map stays as it is; a null text stays null."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    put = F.concat(F.transform(found, lambda x: F.coalesce(F.element_at(other, x), x)), F.array(F.lit("")))
    return F.when(pattern.isNull(), text).otherwise(F.array_join(F.zip_with(gaps, put, lambda a, b: F.concat(a, b)), ""))


def renamed(texts: DataFrame, names: DataFrame, out: str = "renamed") -> DataFrame:
    """texts (session, text and more) with `out`: the text with the session's names replaced."""
    maps = name_maps(names)
    return texts.join(maps, "session", "left").withColumn(out, remapped(F.col("text"), F.col("pattern"), F.col("other"))).drop("pattern", "other")
