"""Queries that put the scalar expressions to work over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import maths, names, text, time
from quern.plans.registry import query
from quern.sources.tables import table

SAYINGS = [
    "I don't have that in our chat.", "She never mentioned it.", "There is no record of it in our conversation history.", "I can't share that, it is private information.",
    "That would need consent.", "For privacy reasons, no.", "Fine, it is at noon.", "It is beyond my knowledge", "I am not comfortable to say", "No such details exist",
]


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"""WITH a AS (SELECT conv_id, turn, text || ' ' || [{", ".join(map(_q, SAYINGS))}][((conv_id + 3 * turn) % 10 + 1)::INT] AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(said, {_q("(?i)" + "|".join(text.INFORMATION_ABSENT))}) THEN 'info_absent' WHEN regexp_matches(said, {_q("(?i)" + "|".join(text.PRIVACY_NAMED))}) THEN 'privacy' ELSE 'other' END AS provenance FROM a""")
def refusal_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether refusals come from missing information or from privacy."""
    saying = F.element_at(F.array(*map(F.lit, SAYINGS)), ((F.col("conv_id") + 3 * F.col("turn")) % 10 + 1).cast("int"))
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), saying).alias("said"))
    return a.select("conv_id", "turn", text.provenance_of_refusal(F.col("said")).alias("provenance"))


@query("""WITH t AS (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN (event_id / 100.0::DOUBLE)::VARCHAR WHEN 1 THEN strftime(ts + INTERVAL 1 YEAR, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN '-1.5' ELSE 'soon' END AS said, 'on 2024-02-' || lpad((event_id % 31 + 1)::VARCHAR, 2, '0') || ' or 2024/03/05' AS note FROM events),
n AS (SELECT *, TRY_CAST(said AS DOUBLE) AS number, CASE WHEN event_id % 4 = 1 THEN floor(epoch(said::TIMESTAMP))::BIGINT END AS seconds, value % 24 AS h FROM t)
SELECT event_id, coalesce(CASE WHEN number >= 0 THEN floor(number) ELSE ceil(number) END, floor((seconds - 1735689600) / 86400))::BIGINT AS day, coalesce(number, seconds::DOUBLE, 0) AS epoch,
(CASE WHEN TRY_CAST(substr(note, 4, 10) AS DATE) IS NOT NULL THEN 2 ELSE 1 END)::INTEGER AS n_dates,
CASE WHEN h < 9 THEN 'early in the morning' WHEN h < 11 THEN 'mid-morning' WHEN h < 13 THEN 'around midday' WHEN h < 15 THEN 'early afternoon' WHEN h < 18 THEN 'in the afternoon' WHEN h < 21 THEN 'in the evening' ELSE 'late at night' END AS label,
(CASE WHEN floor(h)::INT % 12 = 0 THEN 12 ELSE floor(h)::INT % 12 END)::VARCHAR || CASE WHEN floor((h - floor(h)) * 60) > 0 THEN ':' || lpad(floor((h - floor(h)) * 60)::INT::VARCHAR, 2, '0') ELSE '' END || CASE WHEN h < 12 THEN 'am' ELSE 'pm' END AS clock FROM n""")
def time_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, times and labels read from events."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    iso = F.date_format(F.col("ts") + F.expr("INTERVAL 1 YEAR"), "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, (F.col("event_id") / 100.0).cast("string")).when(k == 1, iso).when(k == 2, "-1.5").otherwise("soon")
    note = F.concat(F.lit("on 2024-02-"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0"), F.lit(" or 2024/03/05"))
    t = e.select("event_id", said.alias("said"), note.alias("note"), (F.col("value") % 24).alias("h"))
    s = F.col("said")
    return t.select("event_id", time.day_of(s).cast("long").alias("day"), time.epoch_of(s).alias("epoch"), F.size(time.dates_in(F.col("note"))).alias("n_dates"), time.time_of_day(F.col("h")).alias("label"), time.clock(F.col("h")).alias("clock"))


@query("""WITH t AS (SELECT doc_id, source, lang, text FROM documents)
SELECT doc_id, upper(left(lang, 1)) || substr(lang, 2) || ' ' || upper(left(source, 1)) || substr(source, 2) AS display, regexp_replace(split_part('cloze_' || doc_id % 5 || '/5:x', ':', 1), '[0-9]+/[0-9]+', 'k/n') AS reason, contains(lower(text), 'bye') OR contains(lower(text), 'see you') OR contains(lower(text), 'nite') OR contains(lower(text), 'talk later') OR contains(lower(text), 'gotta go') OR contains(lower(text), 'nice talking') OR contains(lower(text), 'catch you later') OR contains(lower(text), 'take care') OR contains(lower(text), 'ttyl') OR contains(lower(text), 'g2g') OR contains(lower(text), 'cya') AS ends,
array_to_string(string_split_regex(trim(text), '\\s+')[1:5], ' ') AS opening FROM t""".replace("\\\\", "\\"))
def name_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, reasons, endings and openings of documents."""
    t = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    reason = F.concat(F.lit("cloze_"), F.col("doc_id") % 5, F.lit("/5:x"))
    return t.select("doc_id", names.display_name(F.concat_ws("_", "lang", "source")).alias("display"), names.reason_key(reason).alias("reason"), names.ends_conversation(F.col("text")).alias("ends"), names.first_words(F.col("text"), 5).alias("opening"))


@query("""WITH t AS (SELECT p_partkey, p_retailprice / 200 AS km, p_size AS s, p_retailprice / 2000 AS w FROM part)
SELECT p_partkey, greatest(3, least(60, round_even(CASE WHEN km < 1 THEN km * 12 WHEN km < 5 THEN 12 + (km - 1) * 6 ELSE 36 + (km - 5) * 2 END, 0)::INTEGER)) AS minutes, round(greatest(0, least(1, (s - 5) / 30)), 6) AS scaled,
CASE WHEN w >= 0.75 THEN 'close' WHEN w >= 0.5 THEN 'friend' WHEN w >= 0.25 THEN 'known' ELSE 'stranger' END AS tier, round(((s % 2 = 0)::INT + (s % 3 = 0)::INT + (s % 5 = 0)::INT) / 3, 6) AS preserved, round((w - 0.4) / 0.4, 6) AS lift, (s % 2 = 0)::INT + (s % 3 = 0)::INT + (s % 5 = 0)::INT >= 2 AS most FROM t""")
def math_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales, tiers, travel minutes and composite scores over parts."""
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 200).alias("km"), F.col("p_size").alias("s"), (F.col("p_retailprice") / 2000).alias("w"))
    a, b, c = F.col("s") % 2 == 0, F.col("s") % 3 == 0, F.col("s") % 5 == 0
    return t.select(
        "p_partkey", maths.minutes_for(F.col("km")).alias("minutes"), F.round(maths.normalised(F.col("s"), 5, 35), 6).alias("scaled"), maths.tier(F.col("w"), (0.75, 0.5, 0.25), ("close", "friend", "known", "stranger")).alias("tier"),
        F.round(maths.conflict_preservation(a, b, c), 6).alias("preserved"), F.round(maths.lift(F.col("w"), F.lit(0.4)), 6).alias("lift"), maths.more_than_half(F.array(a, b, c)).alias("most"))
