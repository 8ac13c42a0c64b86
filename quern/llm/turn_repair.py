"""Repair of conversations' structure: fault flags, then a fold over sorted turns that carries four cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import WORD, written

#: Turns of a block are a power of two; conversations that reach over blocks are folded block by block, then over blocks.
BLOCK_BITS = 8
#: Costs of the edits, and of leaving a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What a conversation may stand at: nothing yet, after the system's turn, after the user's, after the assistant's.
STATES = ("start", "system", "user", "assistant")
_BEST = "struct<cost:bigint,audit:string>"
_FOUR = "struct<" + ",".join(f"{x}:{_BEST}" for x in STATES) + ">"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged for trial repairs, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row (copies 0), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it the user's. Null roles and
    texts become one space, as do null parts of the hashed text; null turns and conv_ids stay null.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _four(states: list[Column]) -> Column:
    return F.struct(*[x.alias(n) for x, n in zip(states, STATES, strict=True)]).cast(_FOUR)


def _standing(start: int) -> list[Column]:
    """The four cheapest edits where a conversation stands at one state and nothing is done yet."""
    none, first = F.lit(None).cast(_BEST), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).cast(_BEST)
    return [first if i == start else none for i in range(4)]


def _after(best: Column, cost: Column | int, letters: Column | str) -> Column:
    """A cheapest edit with more edits behind it; null stays null."""
    return F.when(best.isNotNull(), F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], F.lit(letters) if isinstance(letters, str) else letters).alias("audit")))


def _inserted(states: list[Column]) -> Column:
    """The four cheapest edits after at most one inserted turn. Two in one place never pay: a start does what an
    assistant's turn does, and a system's turn is deleted for less."""

    def insert(four: Column) -> Column:
        user = F.least(four["user"], *[_after(four[x], INSERT, "I") for x in ("start", "system", "assistant")])
        return F.struct(four["start"].alias("start"), four["system"].alias("system"), user.alias("user"), F.least(four["assistant"], _after(four["user"], INSERT, "I")).alias("assistant"))

    # through an array of one, so that each state is worked out once
    return F.get(F.transform(F.array(_four(states)), insert), F.lit(0)).cast(_FOUR)


def _turn(four: Column, turn: Column) -> Column:
    """The four cheapest edits after a turn (initial, must_go, leave: what keeping costs, tail: deletions of its copies) and
    what is inserted behind it. Inserting among copies never pays, as D comes before I."""
    s = [four[x] for x in STATES]
    tail_cost = DELETE * F.length(turn["tail"])
    edit = lambda best, cost, letter: _after(best, tail_cost + cost, F.concat(F.lit(letter), turn["tail"]))
    gone = [edit(x, DELETE, "D") for x in s]
    kept = lambda initial, best: F.when(~turn["must_go"] & (turn["initial"] == initial), edit(best, turn["leave"], "K"))
    rerole = lambda best: F.when(~turn["must_go"], edit(best, turn["leave"] + REROLE, "R"))
    user = F.least(gone[2], *[x for i in (0, 1, 3) for x in (kept("u", s[i]), rerole(s[i]))])
    return _inserted([gone[0], F.least(gone[1], kept("s", s[0])), user, F.least(gone[3], kept("a", s[2]), rerole(s[2]))])


def fold(turns: Column, inner: Column) -> Column:
    """An array: the four cheapest edits of an array of turns for a conversation that stands at a start before it, and where
    `inner` holds, also for the other three of STATES. At a start a turn may be inserted first; elsewhere the turns
    before have seen to that."""
    start = _inserted(_standing(0))
    starts = F.when(inner, F.array(start, *[_four(_standing(i)) for i in (1, 2, 3)])).otherwise(F.array(start))
    return F.transform(starts, lambda s: F.aggregate(turns, s, _turn))


def _then(four: Column, block: Column) -> Column:
    """The four cheapest edits after a whole block, whose edits from each state (an array as of fold()) are known."""

    def end(name: str) -> Column:
        ways = [(four[x], F.get(block, F.lit(i))[name]) for i, x in enumerate(STATES)]
        return F.least(*[F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))) for a, b in ways])

    return _four([end(x) for x in STATES])


def placed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with digest and place, which numbers them by conv_id, turn (nulls first),
    role and digest. Written once, so that places stay. Key ranges split a conversation of any length; equal rows are one."""
    order = ["conv_id", "turn", "role", "digest"]
    same = rows.withColumn("digest", F.md5("text")).groupBy(*order).agg(F.sum("copies").alias("copies"), F.first("text").alias("text")).where("copies > 0")
    return written(same.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")


def fault_flags(rows: DataFrame) -> DataFrame:
    """placed() rows without their texts, with block, initial, and the number of copies that are blank, duplicate (role and
    text seen earlier in the conversation), truncated (the last visible character is none of `.!?`), the first that
    holds, and illegal: that may not follow the row before, inside a block."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = rows.select("conv_id", "turn", "role", "digest", "copies", "place", F.shiftright("place", BLOCK_BITS).alias("block"), F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORD)).alias("is_blank"), last.isin(".", "!", "?").alias("ends"))
    slim = written(slim, "turns")
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(1).alias("first"))
    before = F.lag("initial").over(Window.partitionBy("conv_id", "block").orderBy("place"))
    legal = lambda x: F.concat(x, F.col("initial")).isin("su", "ua", "au")
    n, first_n = F.col("copies"), F.coalesce("first", F.lit(0))
    return slim.join(first, "place", "left").select(
        "conv_id", "turn", "place", "block", "copies", "initial",
        F.when(F.col("is_blank"), n).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).otherwise(n - first_n).alias("duplicate"),
        F.when(F.col("is_blank") | F.col("ends"), 0).otherwise(first_n).cast("long").alias("truncated"),
        (F.when(before.isNotNull() & ~legal(before), 1).otherwise(0) + n - 1).alias("illegal"),
    )


def cheapest(flags: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of every conversation of fault_flags()."""
    must_go = F.col("blank") + F.col("duplicate") >= F.col("copies")
    turn = F.struct("place", "initial", must_go.alias("must_go"), (F.col("truncated") * TRUNCATED).alias("leave"), F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")).alias("tail"))
    counts = ("blank", "duplicate", "truncated", "illegal")
    blocks = flags.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"), *[F.sum(x).alias(x) for x in counts])
    # what does not begin its block begins its conversation, so only a start leads there
    inner = F.col("turns")[0]["place"] == F.shiftleft("block", BLOCK_BITS)
    ways = fold(F.col("turns"), inner)
    ends = F.struct(F.col("turns")[0]["initial"].alias("head"), F.element_at("turns", -1)["initial"].alias("tail"))
    whole = blocks.select("conv_id", *counts, F.struct("block", ways.alias("ways"), ends.alias("ends")).alias("b"))
    whole = written(whole.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"), *[F.sum(x).alias(x) for x in counts]), "repairs")
    begin = _four(_standing(0))
    best = F.aggregate("b", begin, lambda four, x: _then(four, x["ways"]), lambda four: F.least(four["start"], four["assistant"]))
    joints = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b")), lambda x, y: F.concat(x["ends"]["tail"], y["ends"]["head"]))
    joints = F.size(F.filter(joints, lambda x: ~x.isin("su", "ua", "au")))
    return whole.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + joints).alias("illegal"), best.alias("best")).select("conv_id", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def repaired_turns(role: str, text: str, copies: int, letters: Iterator[str], after: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns that one row and the turns inserted before it become; after: the initial before."""
    while copies:
        letter = next(letters)
        if letter in "IR":
            new = "assistant" if after == "u" else "user"
            yield new, "" if letter == "I" else text
            after = new[0]
        elif letter == "K":
            yield role, text
            after = role[0]
        copies -= letter != "I"


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """key (conv_id as text), repaired_sha256 of `role:text` of the repaired turns, joined by new lines.

    Each conversation's audit, then its rows by place, stream by: the hash takes in one turn at a time."""
    key = F.col("conv_id").cast("string").alias("key")
    stream = rows.select(key, "place", "copies", "role", "text").unionByName(audits.select(key, F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("role"), F.col("audit").alias("text")))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, key, letters, after, first = False, None, iter(""), "", True
        digest = hashlib.sha256()

        def add(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal after, first
            for role, text in turns:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                after, first = role[0], False

        def done() -> list[tuple]:
            add(("assistant" if after == "u" else "user", "") for _ in letters)  # what is inserted behind the last row
            return [(key, digest.hexdigest())] if known else []

        for batch in batches:
            found: list[tuple] = []
            for k, place, copies, role, text in zip(batch["key"], batch["place"], batch["copies"], batch["role"], batch["text"], strict=True):
                if place < 0:
                    found += done()
                    known, key, letters, after, first, digest = True, k, iter(text), "", True, hashlib.sha256()
                else:
                    add(repaired_turns(role, text, copies, letters, after))
            yield pd.DataFrame(found, columns=["key", "repaired_sha256"])
        yield pd.DataFrame(done(), columns=["key", "repaired_sha256"])

    return stream.repartition("key").sortWithinPartitions("key", "place").mapInPandas(hashes, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Turns go by `turn`, nulls first, ties by role, then by the text's MD5; rows of 0 copies only name their conversation.
    A conversation of no copies has zeros, an empty audit and the hash of an empty text; a null conv_id is a conversation.
    Roles and texts must not be null; turns of an empty role cannot be kept. Edits are Keep (0), Rerole to user or assistant (1), Delete (2, a must for blank and
    duplicate turns) and Insert of an empty user's or assistant's turn (5); a truncated turn that stays costs 5 more.
    `audit` has the initials of the cheapest edits after which the roles' initials are `(s?(ua)+)?`, the least in
    ASCII of several. gaps: turns missing between the least and the greatest. No rows give no conversations.

    What an edit costs hangs on the row and the edit alone, so the cheapest edits up to a turn, one for each of four states,
    lead to the cheapest of all; and as no two equally cheap edits up to one turn begin one another, the least of them
    stays the least. A conversation over several blocks is folded from each state in each block, then over its blocks.
    """
    parts = placed(rows)
    flags = written(fault_flags(parts), "flags")
    found = written(cheapest(flags), "cheapest")
    turns = flags.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    hashes = repaired_hashes(parts, found.select("conv_id", "audit"))
    every = rows.select("conv_id").distinct()
    same = lambda a, b, name: a.join(b.withColumnRenamed(name, "__id"), (F.col("conv_id") if name == "conv_id" else F.col("conv_id").cast("string")).eqNullSafe(F.col("__id")), "left").drop("__id")
    whole = same(same(same(every, turns, "conv_id"), found, "conv_id"), hashes, "key")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("conv_id", *[count(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: DuckDB SQL for op11's rows over conversations.
SQL = r"""
WITH RECURSIVE bits AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, bits),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '[^ 	-
]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM o),
g AS (SELECT *, CASE WHEN NOT blank AND seen THEN 1 ELSE 0 END AS duplicate, CASE WHEN NOT blank AND NOT seen AND cut THEN 1 ELSE 0 END AS truncated, blank OR seen AS gone FROM f),
e AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS s0, NULL::VARCHAR AS s1, '0000000005I' AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, x0, x1, least(x2, CASE WHEN x0 IS NOT NULL THEN lpad((x0[:10]::BIGINT + 5)::VARCHAR, 10, '0') || x0[11:] || 'I' END, CASE WHEN x1 IS NOT NULL THEN lpad((x1[:10]::BIGINT + 5)::VARCHAR, 10, '0') || x1[11:] || 'I' END, CASE WHEN x3 IS NOT NULL THEN lpad((x3[:10]::BIGINT + 5)::VARCHAR, 10, '0') || x3[11:] || 'I' END),
    least(x3, CASE WHEN x2 IS NOT NULL THEN lpad((x2[:10]::BIGINT + 5)::VARCHAR, 10, '0') || x2[11:] || 'I' END) FROM (
    SELECT g.conv_id, g.i, d0 AS x0, least(d1, CASE WHEN NOT gone AND r = 's' THEN k0 END) AS x1,
      least(d2, CASE WHEN NOT gone AND r = 'u' THEN least(k0, k1, k3) END, CASE WHEN NOT gone THEN least(r0, r1, r3) END) AS x2, least(d3, CASE WHEN NOT gone AND r = 'a' THEN k2 END, CASE WHEN NOT gone THEN r2 END) AS x3
    FROM (SELECT g.*, lpad((s0[:10]::BIGINT + 2)::VARCHAR, 10, '0') || s0[11:] || 'D' AS d0, lpad((s1[:10]::BIGINT + 2)::VARCHAR, 10, '0') || s1[11:] || 'D' AS d1, lpad((s2[:10]::BIGINT + 2)::VARCHAR, 10, '0') || s2[11:] || 'D' AS d2, lpad((s3[:10]::BIGINT + 2)::VARCHAR, 10, '0') || s3[11:] || 'D' AS d3,
        lpad((s0[:10]::BIGINT + 5 * truncated)::VARCHAR, 10, '0') || s0[11:] || 'K' AS k0, lpad((s1[:10]::BIGINT + 5 * truncated)::VARCHAR, 10, '0') || s1[11:] || 'K' AS k1, lpad((s2[:10]::BIGINT + 5 * truncated)::VARCHAR, 10, '0') || s2[11:] || 'K' AS k2, lpad((s3[:10]::BIGINT + 5 * truncated)::VARCHAR, 10, '0') || s3[11:] || 'K' AS k3,
        lpad((s0[:10]::BIGINT + 1 + 5 * truncated)::VARCHAR, 10, '0') || s0[11:] || 'R' AS r0, lpad((s1[:10]::BIGINT + 1 + 5 * truncated)::VARCHAR, 10, '0') || s1[11:] || 'R' AS r1, lpad((s2[:10]::BIGINT + 1 + 5 * truncated)::VARCHAR, 10, '0') || s2[11:] || 'R' AS r2, lpad((s3[:10]::BIGINT + 1 + 5 * truncated)::VARCHAR, 10, '0') || s3[11:] || 'R' AS r3
      FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i + 1) g) z),
b AS (SELECT conv_id, i AS n, least(s0, s3)[:10]::BIGINT AS cost, least(s0, s3)[11:] AS audit FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, p, audit[p] AS letter, length(replace(audit[:p], 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM b)),
t AS (SELECT l.conv_id, l.p, letter, CASE WHEN letter = 'I' THEN '' ELSE g.text END AS text, CASE WHEN letter = 'K' THEN g.role END AS role, CASE WHEN letter = 'K' THEN g.r = 's' ELSE false END AS is_system FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, is_system ORDER BY p) AS q FROM t),
v AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM u GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, sum(duplicate) AS duplicate, sum(truncated) AS truncated, count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM b.conv_id
"""
