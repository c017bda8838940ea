import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from lodestar.llm.conversations import Repair, damaged, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
DARK = r"[^\x20\x09-\x0D]"


def cheapest(turns):
    """Cost, labels and output by trying every edit from the last turn back; turns: (role, text, fault)."""

    @cache
    def best(i, before, inserts):
        out = [(0, "", ())] if i == len(turns) and re.fullmatch("(s?(ua)+)?", before) else []
        tail = before[-1:] or "^"
        follows = {"^": "su", "s": "u", "u": "a", "a": "u"}[tail]

        def then(cost, label, symbol, turn, j, n):
            state = {"u": "u", "a": "ua", "s": "s", "": before}[symbol]
            rest = best(j, state if symbol else before, n)
            if rest:
                out.append((cost + rest[0], label + rest[1], (turn, *rest[2]) if symbol else rest[2]))

        if inserts < 3:
            for symbol, role in (("u", "user"), ("a", "assistant")):
                if symbol in follows:
                    then(5, "I", symbol, (role, ""), i, inserts + 1)
        if i < len(turns):
            role, text, fault = turns[i]
            then(2, "D", "", None, i + 1, 0)
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in follows:
                    then(stays, "K", role[:1], (role, text), i + 1, 0)
                for symbol, new in (("u", "user"), ("a", "assistant")):
                    if symbol in follows:
                        then(stays + 1, "R", symbol, (new, text), i + 1, 0)
        return min(out, key=lambda x: x[:2], default=None)

    return best(0, "", 0)


def expected(rows):
    """Rows of (conv_id, turn, role, text), None as it is."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults, given = set(), [], []
        for _, role, text in turns:
            dark = re.findall(DARK, text)
            faults.append("blank" if not dark else "duplicate" if (role, text) in seen else "truncated" if dark[-1] not in ".!?" else "")
            seen.add((role, text))
            given.append((role, text, faults[-1]))
        cost, audit, kept = cheapest(tuple(given))
        numbers = {t[0] for t in turns if t[0] is not None}
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["a.", "b!", "c", "", " \n", None, "d?  ", "a.", "ü。", "x" * 3000 + "."]
    return [(r.choice([None, *range(40)]) if r.random() < 0.1 else i % 40, r.choice([None, *range(12)]), r.choice(roles), r.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 400)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("clash")).withColumn("mark", F.lit(None).cast("int"))
    got = repair(frame)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    turns = repaired_turns(frame, got).orderBy("place").collect()
    digests = {}
    for t in turns:
        digests.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for row in got.collect():
        lines = digests.get(row.conv_id, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))


def test_paths_are_the_cheapest():
    r = random.Random(5)
    for _ in range(3000):
        turns = tuple((r.choice(["system", "user", "assistant", "tool", ""]), f"{i}.", r.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(r.randrange(9)))
        path = Repair()
        for t in turns:
            path.add(*t)
        cost, audit, kept = cheapest(turns)
        assert path.close() == (cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())


def test_a_long_conversation_keeps_little():
    r, path = random.Random(7), Repair()
    turns = [(r.choice(["user", "assistant", "assistant", "system"]), f"{i}.", r.choice(["", "", "truncated", "duplicate"])) for i in range(6000)]
    for t in turns:
        path.add(*t)
    held = 0
    p = next(iter(path.paths.values()))[1]
    while p:
        held, p = held + 1, p.before
    assert held < 1500 and len(path.known) > 4500
    weights = {3: (0, ""), 0: (0, ""), 2: (5, "I"), 1: (10, "II")}  # from the last turn back
    for role, _, fault in reversed(turns):
        new = {}
        for state, to in ((0, {"s": 1, "u": 2}), (1, {"u": 2}), (2, {"a": 3}), (3, {"u": 2})):
            out = [(weights[state][0] + 2, "D" + weights[state][1])]
            stays = 5 if fault == "truncated" else 0
            for symbol, t in to.items() if fault != "duplicate" else ():
                if role[0] == symbol:
                    out.append((weights[t][0] + stays, "K" + weights[t][1]))
                if symbol != "s":
                    out.append((weights[t][0] + stays + 1, "R" + weights[t][1]))
            new[state] = min(out)
        for state, to in ((2, 3), (3, 2), (0, 2), (1, 2), (2, 3)):
            new[state] = min(new[state], (new[to][0] + 5, "I" + new[to][1]))
        weights = new
    assert path.close()[:2] == weights[0]


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 3, 11) for t in (None, *range(30)) for r, x in [("assistant", "One. Two! Three?"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        row = (c, t, "user" if fate == 4 else r, "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x, fate == 0)
        want += [row] * (2 if fate == 3 else 1)
    assert sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(want, key=str)


def test_nothing_left_and_nothing_given(spark):
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (None, 1, "user", "b.", True)], SCHEMA + ", gone boolean")
    empty = hashlib.sha256().hexdigest()
    assert sorted(map(tuple, repair(gone).collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repaired_turns(gone, repair(gone)).count() == 0
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, 0, "user", "a.")] * 50 + [(1, None, "assistant", "b.")]
    assert list(map(tuple, repair(spark.createDataFrame(same, SCHEMA)).collect())) == expected(same)
