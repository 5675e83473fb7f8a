"""Operator 9 against all pairs."""

import random
import re
from collections import Counter

import pytest

from forgeline.llm import ngram_join


def shingles(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}


def brute(data, words, percent):
    sets = [shingles(t, words) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and None not in (data[i][0], data[j][0]):
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(data):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return Counter((k, len(sets[i]), None if k is None else low[find(i)]) for i, (k, _) in enumerate(data))


def edited(text, rate, draw):
    return " ".join(f"x{draw.randint(0, 10**6)}" if draw.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def documents(prose):
    draw = random.Random(8)
    passages = [prose(f"p{k}", 40) for k in range(3)]
    texts = [prose(k, draw.randint(3, 160)) for k in range(30)]
    # passages that many share, some texts made of nothing else
    texts += [prose(f"a{k}", draw.randint(5, 90)) + " " + draw.choice(passages) for k in range(40)]
    texts += [" ".join(draw.sample(passages, 2)) for _ in range(12)]
    # one large group of near copies, with links only along chains
    base = prose("base", 120)
    texts += [edited(base, draw.choice([0.01, 0.02, 0.03]), draw) for _ in range(50)]
    step = prose("chain", 200)
    for _ in range(12):
        step = edited(step, 0.02, draw)
        texts.append(step)
    texts += [texts[3]] * 6 + [texts[4].upper(), texts[5].replace(" ", "\n\t"), "", " \n", "one two", "One TWO", "é ß", "É ß"]
    draw.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (1000, None)]


@pytest.mark.parametrize(
    "frequent,extra,rounds,words,percent", [(16, 32, 6, 4, 85), (2, 3, 2, 4, 85), (3, 0, 1, 3, 60), (2, 40, 6, 5, 80)]
)
def test_components_equal_all_pairs(monkeypatch, rows, documents, frequent, extra, rounds, words, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "EXTRA", extra)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
    docs = rows("doc_id bigint, text string, n int, cid int, comp int", *[(k, t, 1, 1, 1) for k, t in documents])
    got = ngram_join.near_duplicates(docs, words=words, percent=percent)
    assert Counter(map(tuple, got.collect())) == brute(documents, words, percent)


def test_equal_keys_with_different_texts(rows, prose):
    data = [(1, prose(1, 50)), (1, prose(2, 50)), (5, prose(2, 50)), (6, prose(1, 50) + " z"), (7, prose(3, 9))]
    got = ngram_join.near_duplicates(rows("doc_id bigint, text string", *data))
    assert Counter(map(tuple, got.collect())) == brute(data, 4, 85)


def test_one_of_each_group_stays(rows, documents):
    names = "stays int, rep int, rows int, slot int, name string, doc string, row int"
    docs = rows(f"doc_id bigint, text string, {names}", *[(k, t, *range(4), "n", "d", 5) for k, t in documents])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    # rows as rows: each has a number of its own for the search of all pairs, in the order of keys
    ordered = sorted(range(len(documents)), key=lambda k: (documents[k][0] is None, documents[k][0] or 0))
    least = {p for p, _, c in brute([(p, documents[k][1]) for p, k in enumerate(ordered)], 5, 80) if p == c}
    want = Counter(documents[ordered[p]] for p in least)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_rows_without_a_key_of_their_own(rows, prose):
    same, other = prose(1, 60), prose(2, 60)
    data = [(None, same), (None, same), (None, other), (4, same), (4, other + " x"), (4, other), (4, other), (None, ""), (None, ""), (9, None)]
    kept = ngram_join.keep_one(rows("doc_id bigint, text string", *data)).collect()
    got = Counter(tuple(r) for r in kept)
    assert got[None, ""] == 2 and got[9, None] == 1 and got[4, same] == 1
    assert got[4, other] + got[4, other + " x"] == 1 and sum(got.values()) == 5


def test_words_that_share_a_polynomial_hash(rows):
    words = ["".join("ab"[bin(k).count("1") + flip & 1] for k in range(1024)) for flip in (0, 1)]
    data = [(k, f"one two {w} three four") for k, w in enumerate(words)] + [(5, f"one two {words[1]} three four")]
    got = ngram_join.near_duplicates(rows("doc_id bigint, text string", *data))
    assert Counter(map(tuple, got.collect())) == brute(data, 4, 85)


def test_no_documents(rows):
    empty = rows("doc_id bigint, text string")
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_links_of_a_large_group_are_thinned_and_connect_the_same(rows):
    draw = random.Random(4)
    # 300 members linked to most of 20 pivots, a chain, and a pair
    links = {(draw.randrange(20), m) for m in range(100, 400) for _ in range(40)}
    links |= {(k, k + 1) for k in range(500, 520)} | {(700, 900)}
    for turn in (0, 3):
        fewer = [tuple(r) for r in ngram_join.spanning(rows("a bigint, b bigint", *links), turn).collect()]
        assert len(links) > 4000 and 4 * len(fewer) < len(links)

        def groups(edges):
            near = {}
            for a, b in edges:
                near.setdefault(a, {a}).add(b)
                near.setdefault(b, {b}).add(a)
            low = {k: k for k in near}
            while (new := {k: min(low[m] for m in near[k]) for k in near}) != low:
                low = new
            return low

        assert groups(fewer) == groups(links)


def test_old_index_tables_are_not_kept(spark, rows, documents, monkeypatch, tmp_path):
    from pathlib import Path

    monkeypatch.setattr(ngram_join, "new_run_folder", lambda spark, name: f"{tmp_path}/{name}-{len(list(Path(tmp_path).iterdir()))}")
    ngram_join.near_duplicates(rows("doc_id bigint, text string", *documents)).count()
    assert len([p for p in Path(tmp_path).iterdir() if p.name.startswith("index")]) == 1
