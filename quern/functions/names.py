"""Column expressions over identifiers, labels and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that end a conversation, and words that say nothing of a topic.
ENDINGS = ["goodbye", "bye", "see you", "talk later", "gotta go", "nice talking", "catch you later", "take care", "ttyl", "g2g", "cya", "nite"]
TOPIC_STOP_WORDS = ["the", "a", "an", "is", "was", "are", "were", "that", "this", "with", "from", "have", "has", "been", "they", "them", "their", "about", "just", "also", "would", "could", "should", "really", "very", "much", "some", "into", "will", "your"]

# Words that begin no name, though they may be capitalised.
NO_NAME_STARTS = [
    "I", "The", "A", "An", "It", "If", "But", "And", "Or", "So", "Just",
    "You", "Your", "He", "She", "We", "They", "My", "His", "Her", "Our",
    "That", "This", "There", "Here", "How", "What", "When", "Where", "Why",
    "Can", "Could", "Would", "Should", "Have", "Has", "Had", "Do", "Does",
    "Not", "No", "Yes", "Oh", "Ah", "Well", "Now", "Then", "Also", "Very",
    "Really", "Maybe", "Perhaps", "Honestly", "Seriously", "Anyway",
    "Thanks", "Thank", "Please", "Sorry", "Sure", "Right", "Okay",
    "Go", "Come", "Get", "Let", "Make", "Take", "Keep", "Find", "Tell",
    "After", "Before", "Because", "Since", "Although", "However",
    "Count", "Perfect", "Makes", "Coffee", "Numbers",
]


def display_name(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def first_name(slug: Column) -> Column:
    return F.initcap(F.substring_index(slug, "_", 1))


def place_name(place: Column) -> Column:
    return display_name(F.regexp_replace(place, "^loc_", ""))


def ends_conversation(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, ENDINGS)), lambda x: F.contains(low, x))


def named_things(text: Column) -> Column:
    """Runs of two or more capitalised words that begin a word, each once, in order of first mention; a title such as `Dr.` before
    them is no part of them, and runs that begin with one of NO_NAME_STARTS do not count. A null text has none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda x: ~F.get(F.split(x, r"\s+"), F.lit(0)).isin(*NO_NAME_STARTS)))


def topic(text: Column, named: Column) -> Column:
    """Up to two named things of over two letters, else up to three longer words, else a stock phrase."""
    things = F.slice(F.filter(named, lambda x: F.length(x) > 2), 1, 2)
    bare = lambda w: F.regexp_replace(w, r"^[.,!?;:'\"]+|[.,!?;:'\"]+$", "")
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) > 4) & ~bare(F.lower(w)).isin(*TOPIC_STOP_WORDS))
    picked = F.transform(F.slice(words, 1, 3), bare)
    return F.when(F.size(things) > 0, F.array_join(things, " and ")).when(F.size(picked) > 0, F.array_join(picked, " ")).otherwise("what was discussed")


def reason_key(reason: Column) -> Column:
    """A reason without its detail, counts masked."""
    key = F.coalesce(F.nullif(F.trim(F.substring_index(F.coalesce(reason, F.lit("")), ":", 1)), F.lit("")), F.lit("(none)"))
    return F.regexp_replace(key, r"\d+/\d+", "k/n")


def image_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[IMAGE:\s*([^\]]*)\]"), F.lit(1))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")
