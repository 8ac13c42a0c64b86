"""Files of nested JSON whose shapes differ, read as variants: no schema is laid down, each item says what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.sources.tables import kept


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value (variant) of every file under `path`, each of which is one JSON value; files that are none are left out."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))
    return found.where("value IS NOT NULL")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _get(path: str, shape: str = "string", value: str = "item") -> Column:
    return F.expr(f"try_variant_get({value}, '$.{path}', '{shape}')")


def _first(*paths: str) -> Column:
    """The first of an item's fields that holds anything but an empty text."""
    return F.coalesce(*[F.nullif(_get(x), F.lit("")) for x in paths])


def _exploded(df: DataFrame, value: str, keep: list[str], pos: str = "pos", key: str = "key", out: str = "item") -> DataFrame:
    """df's columns `keep` beside position, key (null in arrays) and value of what the variant column `value` holds."""
    names = ", ".join(f"t.`{x}`" for x in keep)
    return df.sparkSession.sql(f"SELECT {names}, e.pos AS `{pos}`, e.key AS `{key}`, e.value AS `{out}` FROM {{t}} AS t, LATERAL variant_explode(t.`{value}`) AS e", t=df)


def questions(files: DataFrame) -> DataFrame:
    """file, position, question_id, question, answer, question_type, options, correct_option, item of files (file, value).

    A file is an object with a list under `qars` or `questions`, or a list; other shapes raise an error. An item with Q or A
    has its options as an object (the right one is the first whose text is the answer, in the order of the keys, else the
    answer's first letter) or as a list; any other item names its right option itself. Where a list's item names none, an
    answer that begins with A to D does. An item without an id is named by its place; an item that is no object or has no
    question raises an error. `item` keeps everything else.
    """
    root = F.when(kind(F.col("value")) == "ARRAY", F.col("value"))
    lists = [F.expr(f"try_variant_get(value, '$.{x}', 'variant')") for x in ("qars", "questions")]
    chosen = F.coalesce(*[F.when(kind(x) == "ARRAY", x) for x in lists], root, F.raise_error(F.concat(F.lit("no list of questions: "), "file")).cast("variant"))
    items = _exploded(files.select("file", chosen.alias("items")), "items", ["file"], pos="position")
    items = items.withColumn("item", F.when(kind(F.col("item")) == "OBJECT", F.col("item")).otherwise(F.raise_error(F.concat(F.lit("no object at "), "file", F.lit(" "), "position")).cast("variant")))
    has = lambda x: F.expr(f"try_variant_get(item, '$.{x}', 'variant')").isNotNull()
    new = has("Q") | has("A")
    items = items.withColumns({"new": new, "answer": F.trim(F.coalesce(F.when(new, _first("A", "answer")).otherwise(_first("answer", "A")), F.lit(""))), "kind": F.coalesce(kind(F.expr("try_variant_get(item, '$.options', 'variant')")), F.lit(""))})
    named = F.when(F.col("new"), _first("id")).otherwise(_first("question_id", "id"))
    asked = tx.clean_answer(F.coalesce(F.when(F.col("new"), _first("Q", "question")).otherwise(_first("question", "Q")), F.lit("")))
    asked = F.when(F.length(asked) > 0, asked).otherwise(F.raise_error(F.concat(F.lit("no question at "), "file", F.lit(" "), "position")).cast("string"))
    by_key = F.array_sort(F.map_entries(_get("options", "map<string,string>")))
    by_key = F.when(F.col("new") & (F.col("kind") == "OBJECT") & (F.size(by_key) > 0), by_key)
    listed = _get("options", "array<string>")
    listed = F.when((F.col("kind") == "ARRAY") & (F.size(listed) > 0), listed)
    letter = lambda c: F.nullif(F.upper(F.substring(F.trim(c), 1, 1)), F.lit(""))
    right = F.get(F.filter(by_key, lambda x: F.lower(F.trim(x["value"])) == F.lower(F.col("answer"))), F.lit(0))["key"]
    begins = F.when(letter(F.col("answer")).isin("A", "B", "C", "D"), letter(F.col("answer")))
    told = F.when(~F.col("new"), letter(_first("correct_option")))
    return items.select(
        "file", "position", F.coalesce(named, F.format_string("q_%04d", "position")).alias("question_id"), asked.alias("question"), "answer",
        F.when(by_key.isNotNull() | listed.isNotNull(), "multiple_choice").otherwise("open_ended").alias("question_type"),
        F.coalesce(F.transform(by_key, lambda x: F.concat(x["key"], F.lit(". "), x["value"])), listed).alias("options"),
        F.when(by_key.isNotNull(), F.coalesce(letter(right), letter(F.col("answer")))).when(listed.isNotNull(), F.coalesce(told, begins)).alias("correct_option"),
        "item",
    )


def string_leaves(values: DataFrame, value: str = "value") -> DataFrame:
    """values' other columns, path, value of every string inside the variant column `value`: keys are parted by dots, places in
    lists stand in brackets; a lone string has an empty path. Other values and nulls have no rows.

    Each round opens the objects and lists of one depth and is written, until none is left."""
    names = [x for x in values.columns if x != value]
    spark, level, found = values.sparkSession, values.select(*names, F.lit("").alias("path"), F.col(value).alias("item")), None
    while True:
        level = kept(level.withColumn("kind", kind(F.col("item"))).where("kind IN ('STRING', 'OBJECT', 'ARRAY')"), "leaves")
        strings = level.where("kind = 'STRING'").select(*names, "path", F.expr("variant_get(item, '$', 'string')").alias("value"))
        found = strings if found is None else found.unionByName(strings)
        inner = level.where("kind <> 'STRING'")
        if inner.isEmpty():
            return found
        opened = _exploded(inner.withColumnRenamed("item", "whole"), "whole", [*names, "path"])
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        level = opened.select(*names, step.alias("path"), "item")


def keyed_sessions(files: DataFrame) -> DataFrame:
    """file, entry, session, position, speaker, text of files (file, value) whose sessions lie under keys session_<n>, either in
    the file's object or under `conversation` of each object of its list (entry: the place there, else 0). Other keys, and
    such keys that hold no list, are passed over; texts are trimmed (clean_text before text), empty ones left out, and
    positions count all turns. Sessions are numbered by their keys, so that 10 follows 9."""
    rooted = files.where(kind(F.col("value")) == "OBJECT").select("file", F.lit(0).alias("entry"), F.coalesce(F.expr("try_variant_get(value, '$.conversation', 'variant')"), F.col("value")).alias("whole"))
    listed = _exploded(files.where(kind(F.col("value")) == "ARRAY"), "value", ["file"], pos="entry").where(kind(F.col("item")) == "OBJECT")
    listed = listed.select("file", "entry", F.coalesce(F.expr("try_variant_get(item, '$.conversation', 'variant')"), F.col("item")).alias("whole"))
    sessions = _exploded(rooted.unionByName(listed), "whole", ["file", "entry"], pos="at")
    sessions = sessions.where(F.col("key").rlike("^session_[0-9]+$") & (kind(F.col("item")) == "ARRAY"))
    sessions = sessions.select("file", "entry", F.substring("key", 9, 20).cast("long").alias("session"), F.col("item").alias("turns"))
    turns = _exploded(sessions, "turns", ["file", "entry", "session"], pos="position").where(kind(F.col("item")) == "OBJECT")
    text = F.trim(F.coalesce(_first("clean_text", "text"), F.lit("")))
    return turns.select("file", F.col("entry").cast("long").alias("entry"), "session", F.col("position").cast("long").alias("position"), F.coalesce(_get("speaker"), F.lit("")).alias("speaker"), text.alias("text")).where("text <> ''")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """file, msg_id, thread_id, user_id, text, occur_ts, deliver_ts of every message in a folder of transcripts and group chats,
    told apart by what they hold: an object with an object of `dialogues` (date -> group -> messages) is a chat, on however
    many lines; any other file is a transcript with an object a line. Lines that are none raise an error.

    A chat's messages are numbered by date, group and place, and named date_group_number where they have no id; times get a
    T and a Z, and a message without one has its day's start. A transcript's messages without an id are named by their
    line; delivery defaults to occurrence. A file is read as one row.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("whole"))
    files = files.withColumn("dialogues", F.expr("try_variant_get(whole, '$.dialogues', 'variant')")).withColumn("chat", F.coalesce(kind(F.col("dialogues")) == "OBJECT", F.lit(False)))
    dates = _exploded(files.where("chat"), "dialogues", ["file"], key="date").where(kind(F.col("item")) == "OBJECT")
    groups = _exploded(dates, "item", ["file", "date"], key="group", out="list").where(kind(F.col("list")) == "ARRAY")
    said = _exploded(groups, "list", ["file", "date", "group"]).where(kind(F.col("item")) == "OBJECT")
    number = F.row_number().over(Window.partitionBy("file").orderBy("date", "group", "pos")) - 1
    at = F.replace(F.trim(F.coalesce(_get("time"), F.lit(""))), F.lit(" "), F.lit("T"))
    at = F.when(at == "", F.concat("date", F.lit("T00:00:00Z"))).when(F.endswith(at, F.lit("Z")) | F.contains(F.substring(at, 11, 99), F.lit("+")), at).otherwise(F.concat(at, F.lit("Z")))
    chats = said.select("file", F.coalesce(_first("msg_id"), F.concat_ws("_", "date", "group", number)).alias("msg_id"), F.col("group").alias("thread_id"), _get("speaker_id", "long").alias("user_id"), F.coalesce(_first("dialogue", "text", "content"), F.lit("")).alias("text"), at.alias("occur_ts"), at.alias("deliver_ts"))
    lines = files.where("NOT chat").select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where("trim(value) <> ''").withColumn("item", F.parse_json("value"))
    speaker = F.expr("try_variant_get(item, '$.speaker', 'variant')")
    user = F.when(kind(speaker) == "OBJECT", _get("speaker.user_id", "long")).otherwise(_get("user_id", "long"))
    occur = _first("occur_ts", "time")
    told = lines.select("file", F.coalesce(_first("msg_id", "id"), F.format_string("jsonl_%08d", "line")).alias("msg_id"), F.coalesce(_first("thread_id", "group"), F.lit("")).alias("thread_id"), user.alias("user_id"), F.coalesce(_first("text", "dialogue", "content"), F.lit("")).alias("text"), occur.alias("occur_ts"), F.coalesce(_first("deliver_ts"), occur).alias("deliver_ts"))
    return chats.unionByName(told)
