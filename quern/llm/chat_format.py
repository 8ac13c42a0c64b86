"""Chat formatting: paths of reply trees, ranked by score, each as one conversation of a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import written

#: A turn reads <|role|>, a new line, the text, </s>, a new line. Inside texts and roles a backslash after the first
#: character breaks these marks up; where backslashes stand there already, they get one more.
OPEN, SHUT, END = "<|", "|>\n", "</s>\n"
TURN = r"(?s)<\|(.*?)\|>\n(.*?)</s>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(\||/s>)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(\||/s>)", r"<$1$2")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def root_paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, above: every node on the way from each leaf to its root, `above` steps over the leaf.

    nodes: tree, node, parent (null at roots). Self-joins double the step: after k of them each node knows its ancestor
    2^k steps up and each leaf its next 2^k ancestors, so the rounds grow as the logarithm of the depth.
    """
    jumps = written(nodes.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up")), "jumps")
    parents = jumps.select("tree", F.col("up").alias("node")).distinct()
    paths = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    step = 1
    while not jumps.isEmpty():
        further = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + step).alias("above"))
        paths = written(paths.unionByName(further), "paths")
        above = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = written(jumps.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "jumps")
        step *= 2
    return paths


def format_trees(messages: DataFrame, branches: int = 1, null_tree: bool = False) -> DataFrame:
    """tree, leaf, branch (rank from 1), branch_score, formatted, loss_spans (array of start, length) per chosen path.

    messages: tree, node (long, a parent's less than its replies'), parent, role, text, score. A tree has one path per
    leaf; the `branches` best by mean score are chosen, ties to the smaller leaf. A parent that is null, unknown or not
    less than the node makes it a root. Null texts and roles are empty, null scores 0. Rows that repeat a node count
    once, the least by parent, role, text, score. Null nodes take no part, nor do null trees; with null_tree these
    are one tree. loss_spans are the code points of `formatted` that hold the assistant's texts. No rows give no rows.
    """
    rows = messages.where("node IS NOT NULL" if null_tree else "tree IS NOT NULL AND node IS NOT NULL")
    tree = F.struct(F.col("tree").alias("id")) if null_tree else F.col("tree")  # a struct is not null and equals itself, whatever it holds
    rows = rows.select(tree.alias("tree"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    rows = written(rows, "messages")
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = rows.select("tree", "node", "parent").join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known") & (F.col("parent") < F.col("node")), F.col("parent")).alias("parent"))
    paths = root_paths(nodes)
    scored = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = scored.withColumn("branch", rank).where(F.col("branch") <= branches)
    turns = paths.join(chosen, ["tree", "leaf"]).join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.withColumns({"head": F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(SHUT)), "body": escaped(F.col("text"))})
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start)
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    whole = turns.groupBy("tree", "leaf").agg(F.first("branch").alias("branch"), F.first("branch_score").alias("branch_score"), F.sort_array(F.collect_list(F.struct("start", "turn"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return whole.select((F.col("tree.id") if null_tree else F.col("tree")).alias("tree"), "leaf", "branch", "branch_score", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """messages for format_trees() of a table of conv_id, turn, role, text: each row replies to the one before it.

    Rows go by turn, null first, ties by role, then text (nulls first); each repeated row is a turn of its own. Rows
    without a conv_id are one conversation, for format_trees() with null_tree.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def read_back(formatted: DataFrame) -> DataFrame:
    """What op5 returns of each conversation, read from `formatted` and `loss_spans` alone."""
    text = F.col("formatted")
    roles, texts = F.regexp_extract_all(text, F.lit(TURN), F.lit(1)), F.regexp_extract_all(text, F.lit(TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.concat(unescaped_role(r), F.lit("\n"), unescaped(t), F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda x: unescaped(F.substring(text, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    return formatted.select(F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length(text).cast("long").alias("formatted_chars"))


#: DuckDB SQL for op5's rows over conversations and conversation -7.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (
  SELECT *, length(regexp_replace(text, '<(\\*)(\||/s>)', '<\\\1\2', 'g'))
    + length(regexp_replace(regexp_replace(role, '<(\\*)(\||/s>)', '<\\\1\2', 'g'), '\|(\\*)>', '|\\\1>', 'g')) + 10 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
