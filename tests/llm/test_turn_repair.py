"""Operator 13 against its rules written out, and against all edit scripts of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from forgeline.llm import turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\v\f\r"


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        solid = text.strip(WHITE)
        out.append(
            "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        )
        seen.add((role, text))
    return out


def apply_script(script, turns, faults):
    """(cost, lines) of an audit string, None if it isn't one; inserted and renamed roles follow the pattern."""
    at, cost, initials, lines = 0, 0, "", []
    for letter in script:
        wanted = "assistant" if initials.endswith("u") else "user"
        if letter == "I":
            cost, initials = cost + 2, initials + wanted[0]
            lines.append(f"{wanted}:")
            continue
        if at == len(turns):
            return None
        _, role, text = turns[at]
        if letter == "D":
            cost += 3
        elif faults[at] in ("blank", "duplicate"):
            return None
        else:
            cost += (2 if letter == "R" else 0) + (faults[at] == "truncated")
            role = wanted if letter == "R" else role
            initials += role[:1] or "?"
            lines.append(f"{role}:{text}")
        at += 1
    if at < len(turns) or not re.fullmatch("(s?(ua)+)?", initials):
        return None
    return cost, lines


def all_scripts(turns, faults):
    """Cheapest, then ASCII-least audit over all scripts of up to two insertions more than turns."""
    best = None
    for n in range(len(turns), len(turns) + 4):
        for script in itertools.product("DIKR", repeat=n):
            done = apply_script(script, turns, faults)
            if done and (best is None or (done[0], "".join(script)) < best[:2]):
                best = done[0], "".join(script), done[1]
    return best


def expected(conv, table, search=all_scripts):
    rows = [(t, r, x) for c, t, r, x in damaged(table) if c == conv]
    turns = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = faults_of(turns)
    known = [t for t, _, _ in turns if t is not None]
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(turns, turns[1:])]
    cost, audit, lines = search(turns, faults) if turns else (0, "", [])
    return (
        conv,
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def by_suffix(turns, faults):
    """The same by recursion over (turn, last initial), for longer conversations."""
    memo = {}

    def best(at, last):
        if (at, last) in memo:
            return memo[at, last]
        options = []
        if at == len(turns) and last in ("", "a"):
            options.append((0, "", ()))
        memo[at, last] = (10**9, "", ())
        wanted = "assistant" if last == "u" else "user"
        if at < len(turns):
            _, role, text = turns[at]
            after = best(at + 1, last)
            options.append((after[0] + 3, "D" + after[1], after[2]))
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and role:
                    after = best(at + 1, role[0])
                    options.append((after[0] + extra, "K" + after[1], (f"{role}:{text}", *after[2])))
                after = best(at + 1, wanted[0])
                options.append((after[0] + 2 + extra, "R" + after[1], (f"{wanted}:{text}", *after[2])))
        direct = min(options) if options else (10**9, "", ())
        memo[at, last] = direct
        return direct

    # insertions: relax over the few places before each turn, from the last turn to the first
    for at in range(len(turns), -1, -1):
        for last in ("", "s", "u", "a"):
            best(at, last)
        for _ in range(4):
            for last in ("", "s", "u", "a"):
                wanted = "assistant" if last == "u" else "user"
                after = memo[at, wanted[0]]
                memo[at, last] = min(memo[at, last], (after[0] + 2, "I" + after[1], (f"{wanted}:", *after[2])))
    return memo[0, ""]


def conversations(n, longest, seed=4):
    draw, table = random.Random(seed), []
    words = ["Yes.", "no", "Why?", " ", "", "a.b", "Go! \n", "\t", None, "long text. And more"]
    roles = ["user", "assistant", "system", "tool", "", None, "Sys", "u"]
    for conv in [*range(n - 1), None]:
        turns = draw.randint(0, longest)
        for k in range(turns):
            turn = draw.choice([k, k, k, 2 * k, None, -3])
            usual = ["user", "assistant"][k % 2]
            table.append((conv, turn, draw.choice([usual, usual, usual, *roles]), draw.choice(words)))
    return table


def test_short_conversations_against_all_scripts(rows):
    table = conversations(150, 3)
    source = rows(SCHEMA + ", audit int", *[(*r, 1) for r in table])
    got = turn_repair.assess(turn_repair.damage(source), source)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    want = [expected(c, table) for c in {r[0] for r in table}]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [3, 4096])
def test_longer_conversations(rows, spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    table = conversations(40, 30, 9) + [(1000, k, ["user", "assistant"][k % 2], f"t{k % 40}.") for k in range(3000)]
    source = rows(SCHEMA, *table)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, turn_repair.assess(turn_repair.damage(source), source).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((expected(c, table, by_suffix) for c in {r[0] for r in table}), key=repr)
    assert got == want


def test_both_searches_agree():
    table = conversations(120, 3, 21)
    for conv in {r[0] for r in table}:
        assert expected(conv, table) == expected(conv, table, by_suffix)


def test_repaired_turns_follow_the_pattern(rows):
    table = conversations(60, 12, 3)
    turns = turn_repair.damage(rows(SCHEMA, *table))
    lines = {}
    for r in sorted(turn_repair.repair(turns).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    digests = {r.conv_id: r for r in turn_repair.assess(turns).collect()}
    for conv, got in lines.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in got))
        shown = "\n".join(f"{role}:{text}" for _, role, text in got)
        assert hashlib.sha256(shown.encode()).hexdigest() == digests[conv].repaired_sha256
        assert "".join(e for e, _, _ in got) == digests[conv].audit.replace("D", "")


def test_empty_and_wholly_dropped(rows):
    assert turn_repair.assess(turn_repair.damage(rows(SCHEMA))).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    source = rows(SCHEMA, (gone, 0, "user", "x."))
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in turn_repair.assess(turn_repair.damage(source), source).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", nothing)
    ]
