from __future__ import annotations

import functools
import hashlib
import random
import zlib

import pytest

from repopulse.llm import conversations as c

rng = random.Random(12)
SPACES = " \t\n\x0b\x0c\r"


def brute_search(codes, entry, terminal):
    """Cheapest and least edits by trying all, backwards."""
    @functools.cache
    def best(i, q, inserts):
        if i == len(codes):
            return terminal[q], "", q
        kind, fault = codes[i] & 3, codes[i] >> 2
        ways = [(3, "D", best(i + 1, q, 0))]
        if inserts < 3:
            ways.append((2, "I", best(i, c._TURN[q], inserts + 1)))
        if fault != c.FORCED:
            ways.append((2 + fault, "R", best(i + 1, c._TURN[q], 0)))
            if (q, kind) in c._KEEP:
                ways.append((fault, "K", best(i + 1, c._KEEP[q, kind], 0)))
        return min((cost + r[0], edit + r[1], r[2]) for cost, edit, r in ways)

    for i in range(len(codes), -1, -16):  # no deep recursion
        for q in range(4):
            best(max(i, 0), q, 0)
    return best(0, entry, 0)


def brute(rows):
    """The contract's columns of one conversation, from its rows as given."""
    left = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, codes = set(), [], []
    for _, role, text in left:
        body = text.rstrip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * (2 if fault in ("blank", "duplicate") else fault == "truncated"))
    cost, audit, state = brute_search(bytes(codes), 0, c.ACCEPT) if codes else (0, "", 0)
    audit += "I" * (c.ACCEPT[state] // 2)
    out, i = [], 0
    for edit in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((due, ""))
            continue
        if edit != "D":
            out.append((left[i][1] if edit == "K" else due, left[i][2]))
        i += 1
    turns = [r[0] for r in left if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


def talk(conv, n, seed, odd=0.2):
    r = random.Random(seed)
    rows = [(conv, 0, "system", "Be kind.")] if r.random() < 0.5 else []
    for i in range(n):
        role = "assistant" if len(rows) % 2 == (rows[:1] != [] and rows[0][2] != "system") else "user"
        if r.random() < odd:
            role = r.choice(["user", "assistant", "system", "tool", "", None, "User"])
        text = r.choice(["Yes.", "No", "What is it?", f"Word {i}.", f"Word {i}!  \n", f"ends {i} ,", "", " \t", None, "漢字。", "é!"])
        turn = None if r.random() < 0.03 else i + r.randint(0, 1) + (r.random() < 0.05) * 5
        rows.append((conv, turn, role, text))
    return rows


CONVERSATIONS = [talk(i, rng.randint(0, 9), i) for i in range(120)] + [talk(200, 900, 7, 0.1), talk(201, 300, 8, 0.6), talk(None, 8, 9), [(300, 1, "user", "Again.")] * 9, [(301, None, None, None)]]


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_least_of_the_cheapest(seed):
    r = random.Random(seed)
    for n in range(200):
        codes = bytes(r.choice([0, 1, 2, 2, 3, 3]) + 4 * r.choice([0, 0, 0, 1, 2]) for _ in range(r.randint(1, 14)))
        terminal = c.ACCEPT if n % 2 else tuple(r.randint(0, 9) for _ in range(4))
        entry = r.randrange(4)
        assert c.search(codes, entry, terminal) == brute_search(codes, entry, terminal)
        if n < 40:
            want = [[min(brute_search(codes, q, tuple(0 if x == leave else c.NEVER for x in range(4)))[0], c.NEVER) for leave in range(4)] for q in range(4)]
            assert [min(x, c.NEVER) for x in c.crossing_costs(codes)] == sum(want, [])
        assert c.suffix_bounds(codes)[0] <= brute_search(codes, 0, c.ACCEPT)[0]


def test_conversations_equal_brute_force(spark):
    rows = [(*r, "x", 5) for talk in CONVERSATIONS for r in talk]
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, cost long").repartition(5)
    out = c.repair_conversations(given, c.damaged(given))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    want = {talk[0][0]: brute(talk) for talk in CONVERSATIONS if talk}
    assert got == want


def test_conversations_without_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    given = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "user", "Hi.")], schema)
    got = {r.conv_id: tuple(r)[1:] for r in c.repair_conversations(given, given.filter("conv_id = 'a'")).collect()}
    assert got["b"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got["a"] == (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    assert c.repair_conversations(given.limit(0)).count() == 0
    both = spark.createDataFrame([("", 1, "user", "Hi."), (None, 1, "assistant", "Yes.")], schema)
    assert {r.conv_id: r.audit for r in c.repair_conversations(both).collect()} == {"": "KI", None: "IK"}
