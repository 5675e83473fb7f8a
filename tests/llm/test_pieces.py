"""Operator 11 against the library itself."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from forgeline.llm import bpe, piece_bpe

PATH = piece_bpe.piece_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = list(" \n\t\x00\x1c abZ19é中ß!.,-՘ࢠ▁\U0001f600") + ["  ", " the", "tion", "<s>", "<0x0A>", " w1", "</s>"]
ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "▁a", "a▁", "x" * 3000, " " * 300, "\n" * 50]


def texts(n=600, size=80):
    draw = random.Random(11)
    return ODD + ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, size))) for _ in range(n)]


def encoded(segmenter, column):
    out = {}
    for row, ids, _, _ in piece_bpe.parts(segmenter, column):
        out.setdefault(row, []).extend(ids.tolist())
    return [out.get(k, []) for k in range(len(column))]


def table_of(words):
    pieces = piece_bpe.model(PATH)
    return piece_bpe.WordTable(words, [np.array(i, np.uint16) for i in pieces.segment(words)])


@pytest.mark.parametrize("words", [[], [b"a", b"the", b"", b"x" * 60, "中".encode(), b" a"]])
def test_ids_equal_the_library(words):
    segmenter = piece_bpe.Segmenter(piece_bpe.model(PATH), table_of(words))
    assert encoded(segmenter, pa.array(texts())) == [LIBRARY.encode(t) for t in texts()]
    assert encoded(segmenter, pa.array([None, "a", ""])) == [[], LIBRARY.encode("a"), []]


def test_long_texts_and_words_are_cut_where_no_piece_crosses(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    monkeypatch.setattr(piece_bpe, "LONG_WORD", 16)
    long = ["word one, two  three's\n" * 60, "x" * 500, "é 中" * 90, "", "a,b;c\n1é" * 200 + " end", " ab" * 300 + "  "]
    segmenter = piece_bpe.Segmenter(piece_bpe.model(PATH), table_of([b"one,", b"two"]))
    assert encoded(segmenter, pa.array(long)) == [LIBRARY.encode(t) for t in long]
    state = {}
    for row, ids, opens, _ in piece_bpe.parts(segmenter, pa.array(long)):
        if opens:
            state[row] = piece_bpe.Digests(segmenter.pieces)
        state[row].add(ids, opens)
    for row, digest in state.items():
        ids = LIBRARY.encode(long[row])
        assert digest.done() == expected(long[row])[1:], ids[:5]


def expected(text):
    ids = LIBRARY.encode(text or "")
    shown = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def thue_morse(flip):
    return "".join("ab"[bin(k).count("1") + flip & 1] for k in range(1024))


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(bpe.RollingHash, "of", lambda self, sums, start, end: (end - start).astype(np.uint64))
    segmenter = piece_bpe.Segmenter(piece_bpe.model(PATH), table_of([b"the", b"of"]))
    assert encoded(segmenter, pa.array(texts())) == [LIBRARY.encode(t) for t in texts()]


def test_decoding_equals_the_library():
    pieces, draw = piece_bpe.model(PATH), random.Random(3)
    for n in range(400):
        ids = [draw.randrange(260 if n % 3 else 32_000) for _ in range(draw.randint(0, 12))]
        if n % 4 == 0:
            ids = LIBRARY.encode(" ab")[:1] + ids
        assert pieces.decode(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids), ids


def test_query_columns_for_any_rows(rows):
    many = [(k, t, "other") for k, t in enumerate(texts(200))]
    many += [(None, "a b", None), (5, None, "x"), (5, None, "x"), (7, "same same", ""), (7, "same same", "")]
    many += [(8, f"{thue_morse(0)} {thue_morse(1)}", "")]
    docs = rows("doc_id bigint, text string, n_tokens string", *many)
    for most in (0, 20, piece_bpe.SHARED_WORDS):
        got = piece_bpe.digests(docs, most=most)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, *expected(t)) for k, t, _ in many), key=repr)


def test_texts_come_back_from_ids(rows):
    many = list(enumerate(t.replace("▁", " ") for t in texts(100)))
    docs = rows("doc_id bigint, text string", *many)
    ids = piece_bpe.encode(docs)
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in ids.collect()} == {
        k: LIBRARY.encode(t) for k, t in many
    }
    assert {tuple(r) for r in piece_bpe.decode(ids).collect()} == set(many)


def test_table_holds_the_most_frequent_words_of_the_corpus(rows):
    docs = rows("doc_id bigint, text string", *[(k, "often often sometimes" + f" once{k}" * (k % 9 == 0)) for k in range(90)])
    words = {r.word.decode(): r.n for r in piece_bpe.word_counts(docs).collect()}
    assert words["often"] == 180 and words["sometimes"] == 90 and words["once9"] == 1
    table = piece_bpe.shared_table(docs, PATH, most=1)
    assert table.data.tobytes() == b"often"
    assert piece_bpe.shared_table(docs, PATH).data.tobytes() in (b"oftensometimes", b"sometimesoften")
    assert len(piece_bpe.shared_table(rows("doc_id bigint, text string"), PATH).keys) == 0


def test_empty_table(rows):
    assert piece_bpe.digests(rows("doc_id bigint, text string")).collect() == []
