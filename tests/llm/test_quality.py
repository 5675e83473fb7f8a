"""Operators 3 and 7."""

import random
import re
import zlib
from collections import Counter

import pytest

from forgeline.llm import quality_ranking, quality_rules


def junk(text, k):
    words = text.split(" ")
    if k % 4 == 0:
        return " ".join(w + "&&&" for w in words)
    if k % 4 == 1:
        return " ".join(w for w in words[: max(1, len(words) // 8)] for _ in range(8))
    if k % 4 == 2:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    letters = "etaoinshrdlu"
    data, labels = [], []
    for k in range(500):
        text = " ".join("".join(draw.choices(letters, k=draw.randint(2, 8))) for _ in range(draw.randint(15, 120)))
        text = ". ".join(x.strip().capitalize() for x in re.findall(r"(?:\S+ ?){1,9}", text)) + "."
        bad = k % 5 == 0
        data.append((k, junk(text, k // 5) if bad else text))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    return data, labels, docs, spark.createDataFrame(labels, "doc_id bigint, quality int")


def out(key):
    return zlib.crc32(str(key).encode()) % 3 == 1


def test_ranking_on_held_out_documents(corpus):
    data, labels, docs, table = corpus
    got = {r.doc_id: r for r in quality_ranking.classify(docs, table).collect()}
    assert len(got) == len(data)
    known = dict(labels)
    hits = [got[k].predicted == q for k, q in known.items() if out(k)]
    assert sum(hits) / len(hits) >= 0.97
    assert all(got[k].held_out == out(k) and 0 <= got[k].score <= 1 for k in got)
    assert all(got[k].predicted == (got[k].score >= 0.5) for k in got)


def test_held_out_labels_and_other_columns_change_nothing(corpus):
    from pyspark.sql import functions as F

    data, labels, docs, table = corpus
    plain = dict(quality_ranking.classify(docs, table).select("doc_id", "score").collect())
    flipped = table.withColumn(
        "quality", F.when(quality_ranking.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    wide = docs.repartition(5).withColumns({"lang": F.lit("x"), "score": F.lit(1), "good": F.lit(2), "predicted": F.lit(3)})
    assert dict(quality_ranking.classify(wide, flipped).select("doc_id", "score").collect()) == plain


def test_ranking_edge_cases(rows, corpus):
    table = corpus[3]
    docs = rows("doc_id bigint, text string", (None, "a b"), (4, None), (4, None), (6, ""), (7, "x" * 100_000))
    got = quality_ranking.classify(docs, table).collect()
    assert Counter(r.doc_id for r in got) == Counter([None, 4, 4, 6, 7])
    assert all(r.held_out is not None and r.score is not None for r in got)
    none = quality_ranking.classify(docs, table.filter("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_ranking.classify(rows("doc_id bigint, text string"), table).count() == 0


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    symbols = sum(text.count(s) for s in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(rows):
    draw = random.Random(4)
    parts = ["a", "b", "é", "\U0001f600", "#", "|", "&&", "\n", "\n\n", " ", "\t", "\x0b", "\x1c", "　", "lorem", "a b c d e"]
    texts = [" ".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n", "a b c d e " * 40, "one\ntwo\none\n\n", "x " * 30_000]
    docs = rows("doc_id bigint, text string, n_words string, kept int", *[(k, t, "?", 5) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in quality_rules.assess(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        want = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_find_junk_without_labels(corpus):
    data, _, docs, _ = corpus
    got = {r.doc_id: r.kept for r in quality_rules.assess(docs).collect()}
    bad = [got[k] for k, _ in data if k % 5 == 0]
    good = [got[k] for k, _ in data if k % 5]
    assert sum(bad) / len(bad) <= 0.05 and sum(good) / len(good) >= 0.98
    kept = quality_rules.keep(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in got if got[k])


def test_estimation_equals_brute_force(corpus):
    import math

    docs = corpus[2]
    votes = quality_rules.with_measures(docs).select(*quality_rules.votes())
    data = [tuple(r) for r in votes.collect()]
    bad, rates = quality_rules.START_BAD_RATE, quality_rules.START_RATES
    for _ in range(quality_rules.ROUNDS):
        q = []
        for row in data:
            odds = math.log(bad / (1 - bad)) + sum(math.log(b / g) for v, (b, g) in zip(row, rates) if v)
            q.append(1 / (1 + math.exp(-odds)))
        prior, n, all_bad = quality_rules.PRIOR_SHARE * len(data), len(data), sum(q)
        new = []
        for k, start in enumerate(quality_rules.START_RATES):
            hit = sum(x for x, row in zip(q, data) if row[k])
            miss = sum(1 - x for x, row in zip(q, data) if row[k])
            b = min(0.999, max(0.0005, (hit + prior * start[0]) / (all_bad + prior)))
            g = min(0.999, max(0.0005, (miss + prior * start[1]) / (n - all_bad + prior)))
            if k < len(quality_rules.AGAINST):
                g = min(g, quality_rules.MOST_FALSE)
                b = max(b, g)
            else:
                b = min(b, g)
            new.append((b, g))
        bad, rates = min(0.9, max(0.001, all_bad / n)), new
    got = quality_rules.fit(votes)
    assert got.bad == pytest.approx(bad) and [x for r in got.rates for x in r] == pytest.approx([x for r in rates for x in r])


def test_rules_edge_cases(rows):
    docs = rows("doc_id bigint, text string", (None, "a b"), (4, None), (4, None))
    got = quality_rules.assess(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in got) == Counter([(None, 2, False), (4, 0, False), (4, 0, False)])
    empty = rows("doc_id bigint, text string")
    assert quality_rules.assess(empty).count() == quality_rules.keep(empty).count() == 0


def test_rules_run_without_python(corpus):
    plan = quality_rules.keep(corpus[2])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_labelled_id_counts_once_in_the_fit(rows, prose, monkeypatch):
    free = [k for k in range(80) if zlib.crc32(str(k).encode()) % 3 != 1]
    one = [(k, prose(k, 40) if k % 2 else junk(prose(k, 40), k)) for k in free]
    hot = [(free[0], prose(1000 + k, 30) + "!" * (k % 7)) for k in range(300)]
    labels = rows("doc_id bigint, quality int", *[(k, k % 2) for k in free])
    seen, fit_pairs = [], quality_ranking.fit_pairs

    def noted(x, good):
        seen.append((x.tolist(), good.tolist()))
        return fit_pairs(x, good)

    monkeypatch.setattr(quality_ranking, "fit_pairs", noted)
    for parts, data in ((1, one + hot), (5, (one + hot)[::-1]), (3, one)):
        quality_ranking.fit(rows("doc_id bigint, text string", *data).repartition(parts), labels)
    assert [len(good) for _, good in seen] == [len(free)] * 3
    assert seen[0] == seen[1]
    plain = {tuple(x) for x in seen[2][0]}
    assert len(plain - {tuple(x) for x in seen[0][0]}) <= 1
