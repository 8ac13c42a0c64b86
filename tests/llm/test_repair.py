"""Repair of conversations, against all edits, across blocks, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from quern.llm import turn_repair
from quern.llm.turn_repair import damaged, repair

ROWS = "conv_id long, turn long, role string, text string, copies long"


def cheapest(rows):
    """All edits of rows (initial, must_go, truncated), without a shortcut: the least (cost, audit)."""
    ways = [(0, "", "")]
    inserts = lambda ways: [(c + 5 * len(x), a + "I" * len(x), r + x) for c, a, r in ways for x in ("", "u", "a", "ua", "au")]
    ways = inserts(ways)
    for initial, must_go, truncated in rows:
        after = [(c + 2, a + "D", r) for c, a, r in ways]
        if not must_go:
            after += [(c + 5 * truncated, a + "K", r + initial) for c, a, r in ways if initial]
            after += [(c + 1 + 5 * truncated, a + "R", r + x) for c, a, r in ways for x in "ua"]
        ways = inserts([w for w in after if re.fullmatch("s?(ua)*u?", w[2])])
        ways = [w for w in ways if re.fullmatch("s?(ua)*u?", w[2])]
    return min((c, a, r) for c, a, r in ways if re.fullmatch("(s?(ua)+)?", r))


def expected(rows):
    """What repair() says of one conversation's rows (turn, role, text), by loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, flags = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        flags.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, initials = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, flags, strict=True)])
    turns, left, made = [], iter(rows), iter(initials)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter != "D":
            x = next(made)
            turns.append(f"{row[1] if letter == 'K' else {'u': 'user', 'a': 'assistant', 's': 'system'}[x]}:{row[2] if row else ''}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def cases():
    rng = random.Random(3)
    texts = ["", " \n", "Yes.", "No", "So? ", "é!", "cut off", "Yes.\t"]
    found = {}
    for conv in range(40):
        found[conv] = [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["system", "user", "assistant", "tool", " ", ""]), rng.choice(texts)) for _ in range(rng.randint(1, 5))]
    found[None] = [(None, "user", "A."), (None, "user", "A."), (4, "assistant", "B.")]
    found[100] = [(7, "user", "Again.")] * 3 + [(8, "assistant", "Well.")]
    return found


@pytest.mark.parametrize("bits", [8, 1, 0])
def test_equals_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)  # of 1: conversations reach over blocks
    found = cases()
    rows = spark.createDataFrame([(conv, *row, 1) for conv, rows in found.items() for row in rows] + [(200, 1, "user", "gone", 0)], ROWS)
    got = {r.conv_id: tuple(r)[1:] for r in repair(rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == {**{conv: expected(rows) for conv, rows in found.items()}, 200: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.", 1) for i in range(2000) if i % 97]
    got = repair(spark.createDataFrame(rows, ROWS)).collect()[0]
    assert got.gaps == len([i for i in range(1, 1999) if not i % 97]) and len(got.audit) - got.audit.count("I") == len(rows)
    assert got.illegal == got.gaps and got.cost <= 2 * got.gaps + 2


def test_damage(spark):
    rows = [(c, t, None if t == 3 else "assistant", None if t == 4 else "A. B! C?") for c in (1, 2, None) for t in (*range(12), None)]
    got = sorted(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=str)
    show = lambda x: " " if x is None else str(x)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        text = " " if text is None else text
        want.append((c, t, "user" if kind == 4 else role or " ", {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), {0: 0, 3: 2}.get(kind, 1)))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((spark.createDataFrame(want, ROWS)).collect(), key=str)]


def test_no_rows(spark):
    assert repair(spark.createDataFrame([], ROWS)).collect() == []
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 9)], "conv_id long, turn long, role string, text string, place string, copies long")
    assert repair(damaged(clash)).count() == 1
