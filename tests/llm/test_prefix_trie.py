"""Operator 12 against tries built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from forgeline.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(table):
    own = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - int(c - 100 * int(c / 100)), [])[:h] + turns[h:]
    return out


def expected(table):
    members, ends = defaultdict(set), defaultdict(list)
    for conv, turns in rebuilt(table).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
        ends[tuple(turns)].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        if path:
            children[path[:-1]] += 1
            saved[path] += (len(members[path]) - 1) * len(path[-1][1])
        leaves[path] += children[path] == 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (
            (
                min(m),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(m),
                children[path],
                leaves[path],
                saved[path],
                hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
            )
            for path, m in members.items()
        ),
        key=repr,
    )


def conversations(n, longest, seed=1, words=2):
    draw, table = random.Random(seed), []
    for _ in range(n):
        conv = draw.randrange(-150, 450)
        for k in range(draw.randint(0, longest)):
            turn = draw.choice([k, k, k, None, 1])
            table.append((conv, turn, draw.choice(["user", "user", None]), draw.choice(["a", "été", None, "x\U0001f600"][:words + 1])))
    return table + [(None, 0, "user", "lost"), (7, 3, "user", "again"), (7, 3, "user", "again")]


def got(df):
    assert df.columns == prefix_trie.RESULT
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("span,shard_rows,longest", [(64, 20_000, 6), (2, 5, 9), (3, 1, 20), (1, 3, 7), (64, 2, 6)])
def test_nodes_equal_a_trie_in_memory(rows, span, shard_rows, longest):
    table = conversations(200, longest)
    source = rows(SCHEMA + ", depth string, name int", *[(*r, "x", 1) for r in table])
    nodes = prefix_trie.trie(*prefix_trie.rebuild(source), span=span, shard_rows=shard_rows)
    assert got(nodes) == expected(table)


def test_one_shard_has_no_skeleton(rows, spark):
    table = conversations(60, 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for span in (64, 2):
            nodes = prefix_trie.trie(*prefix_trie.rebuild(rows(SCHEMA, *table)), span=span)
            assert got(nodes) == expected(table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_and_a_giant_conversation(rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 20)
    copies = [(c, k, "user", f"t{k}") for c in range(100, 700) for k in range(6)]
    giant = [(800, k, "user", f"g{k % 7}") for k in range(900)] + [(801, k, "user", f"g{k % 7}") for k in range(640)]
    table = copies + giant + conversations(40, 5)
    nodes = prefix_trie.trie(*prefix_trie.rebuild(rows(SCHEMA, *table)), span=16, shard_rows=50)
    assert got(nodes) == expected(table)


def test_skeleton_is_the_prefixes_of_splitters():
    a, b = b"a" * 16, b"b" * 16
    skeleton = prefix_trie.skeleton_of([(prefix_trie.ROOT, a + b, 5), (prefix_trie.ROOT, a, 7)])
    first = prefix_trie.node_id(prefix_trie.ROOT, a)
    assert skeleton == {(prefix_trie.ROOT, True), (first, False), (prefix_trie.node_id(first, b), False)}


def test_turnless_and_empty(rows):
    assert prefix_trie.conversation_trie(rows(SCHEMA)).collect() == []
    lost = rows(SCHEMA, (None, 0, "user", "x"))
    assert prefix_trie.conversation_trie(lost).collect() == []
    gone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 1)
    table = [(gone, 0, "user", "only")]
    assert got(prefix_trie.conversation_trie(rows(SCHEMA, *table))) == expected(table)
