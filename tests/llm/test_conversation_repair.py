"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache
from zlib import crc32

import pytest

from tidemark.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        r = "user" if fate == 4 else r
        yield from [(c, t, r, x)] * (2 if fate == 3 else 1)


def cheapest(rows, faults):
    """(cost, audit, lines) by trying every edit at every place."""

    @cache
    def best(i, q, put_in):
        ways = []
        if i == len(rows) and q in ("", "a"):
            ways.append((0, "", ()))

        def go(cost, letter, line, *place):
            if (n := best(*place)) is not None:
                ways.append((cost + n[0], letter + n[1], (*line, *n[2])))

        for role in ("user", "assistant"):
            if put_in < 4 and (q, role[0]) in NEXT:
                go(5, "I", (f"{role}:",), i, NEXT[q, role[0]], put_in + 1)
        if i < len(rows):
            go(2, "D", (), i + 1, q, 0)
            own, text = rows[i]
            extra = 5 if faults[i] == "truncated" else 0
            if faults[i] not in ("blank", "duplicate"):
                if (q, own[:1]) in NEXT:
                    go(extra, "K", (f"{own}:{text}",), i + 1, NEXT[q, own[:1]], 0)
                for role in ("user", "assistant"):
                    if (q, role[0]) in NEXT:
                        go(extra + 1, "R", (f"{role}:{text}",), i + 1, NEXT[q, role[0]], 0)
        return min(ways) if ways else None

    return best(0, "", 0)


def plain_repair(ids, rows):
    out = []
    for c in set(ids):
        own = [r[1:] for r in rows if r[0] == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(WHITE)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([r[1:] for r in own], faults)
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(cr.op12_conversation_repair(spark, sf)) == plain_repair([r[0] for r in rows], list(damage(rows)))


@pytest.mark.parametrize("block, texts", [(1 << 16, 1 << 10), (2, 2)])
def test_awkward_rows_in_blocks_of_any_size(spark, monkeypatch, block, texts):
    """Nulls in every column, equal turns, foreign and empty roles, one conversation with half of the rows, copies of rows."""
    monkeypatch.setattr(cr, "BLOCK", block)
    monkeypatch.setattr(cr, "TEXTS", texts)
    rng = random.Random(block)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = [None, "", "a.", "b!", "c", "d?  ", "\n e. \t", "f g.", "h.", "no end", "\x1c.", "é ☃."]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(110)]
    rows += [(7, None, None, None)] * 9 + [(8, 3, "user", "again.")] * 9
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("*", "1 as conv", "2 as Text", "3 as block", "4 as part")
    ids = [r[0] for r in rows]
    as_given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(cr.repair(df)) == plain_repair(ids, as_given)
    assert result(cr.repair(df, cr.damaged(cr.conversation_rows(df)))) == plain_repair(ids, list(damage(rows)))


def test_lines_and_edits(spark):
    rows = [(1, 0, "user", "A question?"), (1, 1, "user", "cut off in the mid"), (1, 2, "assistant", "An answer."), (1, 3, "assistant", "An answer."), (1, 4, "user", "Thanks.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = cr.repaired_lines(df).orderBy("conv_id", "part", "block", "some").collect()
    assert "\n".join(r["lines"] for r in lines) == "user:A question?\nassistant:An answer."
    got = cr.repair(df).first()
    assert (got["audit"], got["cost"], got["truncated"], got["duplicate"]) == ("KDKDD", 6, 1, 1)


def test_a_long_conversation(spark):
    """400 turns in one block of 65,536 and in blocks of seven give the same."""
    rows = [(1, t, ("user", "assistant", "assistant", "user", "tool")[t * 7 % 5], f"turn {t * 3 % 257}" + "." * (t % 4 > 0)) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = result(cr.repair(df))
    assert len(want[0][7].replace("I", "")) == 400
    old, cr.BLOCK = cr.BLOCK, 7
    try:
        assert result(cr.repair(df)) == want
    finally:
        cr.BLOCK = old


def test_automaton_is_small():
    automat = cr.automaton()
    rng = random.Random(3)
    for _ in range(200):
        kinds = [rng.randrange(9) for _ in range(50)]
        automat.scan(kinds, [1] * 50, cr.FINAL)
    assert len(automat.vectors) < 200


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(df).count() == 0 and cr.repaired_lines(df).count() == 0
    one = spark.createDataFrame([(4, 1, "user", "x.")], df.schema)
    assert result(cr.repair(one, cr.conversation_rows(df))) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
