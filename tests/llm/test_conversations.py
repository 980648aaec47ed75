"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

from meterlake.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def searched(rows):
    """(cost, audit, repaired rows) by uniform-cost search; states are regular expression prefixes."""
    names, heap, done = {"u": "user", "a": "assistant"}, [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        at = (i, roles[-1:])
        if at in done:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        done.add(at)
        ways = []
        for r in "ua":
            ways.append((5, "I", i, r, (f"{names[r]}:",)))
        if i < len(rows):
            fault, role, text = rows[i]
            ways.append((2, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                ways.append((more, "K", i + 1, role[:1], (f"{role}:{text}",)))
                ways += [(1 + more, "R", i + 1, r, (f"{names[r]}:{text}",)) for r in "ua"]
        for add, edit, j, r, told in ways:
            roles_ = roles + r
            if edit in "DI" and not r or re.fullmatch("s?(ua)*u?", roles_) and (r or edit == "D"):
                heapq.heappush(heap, (cost + add, audit + edit, j, roles_[:1] + roles_[-2:] if len(roles_) > 5 and len(roles_) % 2 else roles_, out + told))
    raise AssertionError


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text, kept = " " if role is None else role, " " if text is None else text, groups[conv]
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        kept += [(turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    out = set()
    for conv, kept in groups.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults, n = set(), [], Counter()
        for _, role, text in kept:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((fault, role, text))
            n[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        turns = {x[0] for x in kept} - {None}
        cost, audit, told = searched(faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn * rng.randint(1, 2), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "So!", "Why? ", "cut off", "", " \n", None, "é…"])))
    rows += [(None, t, r, "x.") for t, r in enumerate(["user", "assistant"] * 3)] + [(7, None, "user", "n."), (7, None, "assistant", "m.")]
    rows += [rows[5]] * 4
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in c.repair(c.damaged(df)).select(*COLUMNS).collect()}
    assert got == expected(rows)


def test_signatures_beyond_the_broadcast(spark, monkeypatch):
    rows = [(conv, turn, "user" if (turn + conv) % 2 else "assistant", "a." * (conv % 5)) for conv in range(40) for turn in range(4)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    monkeypatch.setattr(c, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in c.repair(c.damaged(df)).select(*COLUMNS).collect()} == expected(rows)


def test_solutions_are_the_least_of_all():
    rng = random.Random(2)
    faults = {"x": ("blank", ""), **{x: ("", x) for x in "suao"}, **{x.upper(): ("truncated", x) for x in "suao"}}
    for _ in range(400):
        signature = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7)))
        cost, audit, _ = searched([(*faults[x], "") for x in signature])
        assert c.solve(signature) == (cost, audit), signature


def test_very_long_conversation_and_nothing_left(spark):
    cost, audit = c.solve("ua" * 20_000 + "u")
    assert cost == 2 and sorted(Counter(audit).items()) == [("D", 1), ("K", 40_000)] and audit[0] == "K"
    dropped = next((k, t) for k in range(100) for t in range(100) if zlib.crc32(f"{k}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*dropped, "user", "gone.", None)], SCHEMA)
    row = c.repair(c.damaged(df)).collect()[0]
    assert (row.audit, row.cost, row.gaps, row.repaired_sha256) == ("", 0, 0, hashlib.sha256(b"").hexdigest())
    assert c.repair(c.damaged(df.limit(0))).collect() == []
