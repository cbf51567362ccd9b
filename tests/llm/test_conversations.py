"""Conversation repair against plain enumeration and a plain dynamic program."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lanternwatch.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def enumerate_all(rows):
    """Least (cost, audit) over every way to edit up to three rows: ``rows`` are (initial, forced, cut)."""
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    best = None
    for picks in itertools.product(*[[("D", "", 4)] + ([] if forced else [("K", k, 3 * cut), ("R", "u", 3 + 3 * cut), ("R", "a", 3 + 3 * cut)]) for k, forced, cut in rows]):
        for fills in itertools.product(gaps, repeat=len(rows) + 1):
            audit = initials = ""
            cost = 0
            for i, (letters, shown) in enumerate(fills):
                audit, initials, cost = audit + letters, initials + shown, cost + 3 * len(letters)
                if i < len(rows):
                    audit, initials, cost = audit + picks[i][0], initials + picks[i][1], cost + picks[i][2]
            if GRAMMAR.match(initials):
                best = min(best or (cost, audit), (cost, audit))
    return best


def plain(rows):
    """The same for any number of rows: tuples of cost and audit instead of integers."""
    step = {"0u": 2, "1u": 2, "3u": 2, "2a": 3, "0s": 1}
    at = {0: (0, "")}

    def inserted(at):
        for _ in range(3):
            for s, (cost, audit) in list(at.items()):
                to = step[f"{s}{'a' if s == 2 else 'u'}"]
                at[to] = min(at.get(to, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return at

    for kind, forced, cut in rows:
        new = {}
        for s, (cost, audit) in inserted(dict(at)).items():
            ways = [(s, 4, "D")]
            if not forced:
                ways += [(step[f"{s}{k}"], 3 + 3 * cut, "R") for k in "ua" if f"{s}{k}" in step]
                ways += [(step[f"{s}{kind}"], 3 * cut, "K")] if f"{s}{kind}" in step else []
            for to, more, letter in ways:
                new[to] = min(new.get(to, (cost + more, audit + letter)), (cost + more, audit + letter))
        at = new
    at = inserted(at)
    return min(at[s] for s in (0, 3) if s in at)


def weights(rows, block):
    codes = "".join(chr(65 + c.CLASSES.index(k if k in "sua" else "?") + 4 * f + 8 * (t and not f)) for k, f, t in rows)
    parts = [codes[i : i + block] for i in range(0, len(codes), block)]
    sums = [c.summary(p) for p in parts]
    cost, path = c.route([s[0] for s in sums], [s[1] for s in sums])
    return cost, "".join(c.audit(p, a, b) for p, (a, b) in zip(parts, path, strict=True)) + c.TAILS[path[-1][1]]


def some(r, n):
    return [(r.choice("suax"), r.random() < 0.2, False) if r.random() < 0.6 else (r.choice("ua"), False, r.random() < 0.5) for _ in range(n)]


def test_weights_against_enumeration():
    r = random.Random(1)
    for _ in range(60):
        rows = some(r, r.randint(1, 2))
        assert weights(rows, 99) == weights(rows, 1) == plain(rows) == enumerate_all(rows), rows
    for _ in range(4):
        rows = some(r, 3)
        assert weights(rows, 2) == enumerate_all(rows), rows


def test_blocks_change_nothing():
    r = random.Random(2)
    for _ in range(400):
        rows = some(r, r.randint(1, 40))
        assert weights(rows, 1000) == weights(rows, r.randint(1, 7)) == plain(rows), rows


def report(rows):
    """Plain version of the report of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][: c.LEAD], hashlib.sha256(x[2].encode()).hexdigest()))
    seen, judged, kinds = set(), [], []
    for _, role, text in rows:
        shown = text.rstrip(c.WHITE)
        blank = shown.lstrip(c.WHITE) == ""
        duplicate = not blank and (role, text) in seen
        seen.add((role, text))
        judged.append((blank, duplicate, not blank and not duplicate and shown[-1] not in ".!?"))
        kinds.append(role[:1])
    cost, audit = plain([(k if k in ("s", "u", "a") else "x", b or d, t) for k, (b, d, t) in zip(kinds, judged, strict=True)])
    turns = [t for t, _, _ in rows if t is not None]
    lines, state, i = [], 0, 0
    for letter in audit:
        expected = "assistant" if state == 2 else "user"
        role = rows[i][1] if letter == "K" else expected
        if letter != "D":
            lines.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        i += letter != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    return [gaps, *(sum(x[k] for x in judged) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()], lines


def damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def made_up(seed=4, n=120):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "unknown"]) if r.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = r.choice(["Hello there.", "no end", "Really?  \n", "", " \t", None, "good!\x0b", "x" * 3000 + ".", "日本語。", "ok.", "mmm …"])
            rows.append((conv, None if r.random() < 0.1 else turn * r.choice([1, 1, 1, 2]), role, text, "clash", 7))
    return [*rows, (None, 0, "user", "a.", "c", 1), (None, None, "assistant", "b.", "c", 1), (None, 0, "user", "a.", "c", 1), *rows[:6]]


@pytest.mark.parametrize("block", [1024, 2])
def test_repair_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    rows = made_up()
    got = {x["conv_id"]: [x[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] for x in c.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    for conv, left in want.items():
        assert got[conv] == (report(left)[0] if left else [0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()]), conv


def test_repaired_rows_of_one_long_conversation(spark, monkeypatch):
    """A conversation over many partitions and blocks, one turn of it repeated often."""
    monkeypatch.setattr(c, "BLOCK", 16)
    r = random.Random(7)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["fine.", "cut", "", "why? %d." % t]), "", 0) for t in range(300)] + [(1, 40, "user", "again and again.", "", 0)] * 100
    fixed, summed = c.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want, lines = report([(t, role, text) for _, t, role, text, *_ in rows])
    got = summed.collect()
    assert len(got) == 1 and [got[0][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")] == want
    assert [f"{x['role']}:{x['text']}" for x in fixed.orderBy("place", "n").collect()] == lines
    assert GRAMMAR.match("".join(x["role"][0] for x in fixed.orderBy("place", "n").collect()))


def test_empty_table(spark):
    assert c.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
