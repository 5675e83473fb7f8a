"""Operators 1, 2, 8 and 10 against the library itself."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from forgeline.llm import bpe, chunk_bpe, packing, token_counts, training_order

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = list(" \n\t 　''sStmdrevl<|endoftext|>abZ19é中ß!.,-́\x00\x1c\U0001f600՘࢘") + [
    "<|endoftext|>",
    "'re",
    "'ll",
    "  ",
]
ODD = ["", "a", " ", "  ", "it's 're 'll''s 'st  x", "a<|endoftext|>b <|endoftext|>  ", "a" * 700, " " * 300]


def texts(n=600, size=80):
    draw = random.Random(5)
    return ODD + ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, size))) for _ in range(n)]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_library():
    tokenizer = bpe.ByteBpe(PATH)
    got = []
    for _, ids, count in bpe.encode_texts(tokenizer, pa.array(texts())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [library_ids(t) for t in texts()]


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    tokenizer = bpe.ByteBpe(PATH)
    long = ["word one, two  three's\n" * 60, "x" * 500, "<|endoftext|> a" * 40, "é 中" * 90, ""]
    assert bpe.count_texts(tokenizer, pa.array(long)).tolist() == [len(library_ids(t)) for t in long]
    whole = [ids.tolist() for _, ids, _ in bpe.encode_texts(tokenizer, pa.array(long[:4]))]
    assert sum(whole, []) == sum((library_ids(t) for t in long[:4]), [])
    encoder = chunk_bpe.ChunkEncoder(tokenizer)
    assert [x.tolist() for x in chunk_bpe.encode_documents(encoder, pa.array(long))] == [library_ids(t) for t in long]


def test_words_are_forgotten_and_learned_again():
    tokenizer = bpe.ByteBpe(PATH)
    tokenizer.words = bpe.Words(limit=50)
    for _ in range(2):
        assert bpe.count_texts(tokenizer, pa.array(texts(200))).tolist() == [len(library_ids(t)) for t in texts(200)]


def colliding(flip, n=1024):
    """Words whose polynomial hashes modulo 2**64 are equal whatever the base."""
    return "".join("ab"[bin(k).count("1") + flip & 1] for k in range(n))


def test_words_that_share_a_hash(rows):
    pair = [colliding(0), colliding(1)]
    tokenizer = bpe.ByteBpe(PATH)
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    hashes = tokenizer.hashes.of(tokenizer.hashes.sums(data), np.array([0, 1024]), np.array([1024, 2048]))
    assert hashes[0] == hashes[1]
    sample = [" ".join(pair), *pair, *pair, " ".join(pair[::-1] + pair)]
    assert bpe.count_texts(tokenizer, pa.array(sample)).tolist() == [len(library_ids(t)) for t in sample]
    got = [i.tolist() for _, ids, count in bpe.encode_texts(tokenizer, pa.array(sample)) for i in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [library_ids(t) for t in sample]
    encoder = chunk_bpe.ChunkEncoder(tokenizer)
    assert [x.tolist() for x in chunk_bpe.encode_documents(encoder, pa.array(sample))] == [library_ids(t) for t in sample]
    docs = rows("doc_id bigint, text string", *enumerate(sample))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {
        k: len(library_ids(t)) for k, t in enumerate(sample)
    }
    pieces = packing.pack(docs).filter("piece = 0").collect()
    assert {r.doc_id: r.ids_crc32 for r in pieces} == {
        k: zlib.crc32(np.array((library_ids(t) + [2])[: r.length], "<u4").tobytes())
        for (k, t), r in zip(enumerate(sample), sorted(pieces, key=lambda r: r.doc_id))
    }


def test_any_hash_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe.RollingHash, "of", lambda self, sums, start, end: ((end - start) % 3).astype(np.uint64))
    tokenizer = bpe.ByteBpe(PATH)
    for _ in range(2):
        assert bpe.count_texts(tokenizer, pa.array(texts(200))).tolist() == [len(library_ids(t)) for t in texts(200)]


@pytest.mark.parametrize("least,bits,window", [(6, 3, 4), (1, 2, 2), (96, 9, 16)])
def test_chunk_joins_are_repaired(monkeypatch, least, bits, window):
    monkeypatch.setattr(chunk_bpe, "LEAST_CHUNK", least)
    monkeypatch.setattr(chunk_bpe, "CHUNK_BITS", bits)
    monkeypatch.setattr(chunk_bpe, "WINDOW", window)
    encoder = chunk_bpe.ChunkEncoder(bpe.ByteBpe(PATH), reused_bytes=10_000)
    sample = texts(400, 300)
    got = [x.tolist() for x in chunk_bpe.encode_documents(encoder, pa.array(sample))]
    assert got == [library_ids(t) for t in sample]


def test_equal_chunks_are_encoded_once(prose):
    encoder = chunk_bpe.ChunkEncoder(bpe.ByteBpe(PATH))
    shared = prose(1, 3000)
    list(chunk_bpe.encode_documents(encoder, pa.array([prose(2, 100) + shared])))
    before = len(encoder.chunks)
    list(chunk_bpe.encode_documents(encoder, pa.array([prose(3, 90) + shared])))
    assert len(encoder.chunks) - before < before / 4
    assert chunk_bpe.encoder_of(PATH) is chunk_bpe.encoder_of(PATH)  # kept from task to task


def test_decoding_replaces_what_is_no_text():
    tokenizer = bpe.ByteBpe(PATH)
    for ids in ([170], [170, 64, 50256], LIBRARY.encode("é", add_special_tokens=False).ids[:1] + [64]):
        assert chunk_bpe.decode(tokenizer, np.array(ids)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture
def odd_docs(rows):
    data = [(k, t, k) for k, t in enumerate(texts(40))]
    return rows("doc_id bigint, text string, n_tokens int", *data, (7, "a", 1), (7, "a", 1), (None, "b c", 1), (99, None, 1))


def test_counts_and_digests(odd_docs, rows):
    source = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    got = Counter(map(tuple, token_counts.count_tokens(odd_docs, limit=3).collect()))
    want = Counter()
    for (key, text), n in source.items():
        tokens = len(library_ids(text))
        want[key, len((text or "").encode()), tokens, tokens > 3] += n
    assert got == want
    got = Counter(map(tuple, chunk_bpe.encode(odd_docs, digests=True).collect()))
    want = Counter()
    for (key, text), n in source.items():
        ids = np.array(library_ids(text), "<u4").tobytes()
        plain = hashlib.sha256((text or "").encode()).hexdigest()
        want[key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), plain] += n
    assert got == want
    back = chunk_bpe.decode_ids(chunk_bpe.encode(odd_docs))
    assert Counter(map(tuple, back.collect())) == Counter({k: n for k, n in _filled(source).items()})
    empty = rows("doc_id bigint, text string")
    assert token_counts.count_tokens(empty).count() == chunk_bpe.encode(empty, digests=True).count() == 0


def _filled(source):
    out = Counter()
    for (key, text), n in source.items():
        out[key, text or ""] += n
    return out


def test_plan_covers_the_histogram_without_waste():
    draw = random.Random(3)
    histogram = Counter(min(1024, int(draw.expovariate(1 / 300)) + 1) for _ in range(40_000))
    plan = packing.plan_sequences(dict(histogram), 1024)
    covered = Counter()
    for pattern, n in plan:
        assert sum(a * b for a, b in pattern) <= 1024
        for length, copies in pattern:
            covered[length] += copies * n
    assert covered == histogram
    least = -(-sum(a * b for a, b in histogram.items()) // 1024)
    assert sum(n for _, n in plan) <= 1.005 * least


def test_small_plans_are_best():
    assert sum(n for _, n in packing.plan_sequences({6: 2, 4: 2}, 10)) == 2
    assert sum(n for _, n in packing.plan_sequences({3: 30}, 10)) == 10
    assert packing.plan_sequences({}, 10) == []
    assert sum(n for _, n in packing.plan_sequences({10: 5, 1: 1}, 10)) == 6


@pytest.mark.parametrize("mean,spread", [(300, 150), (500, 150), (700, 150), (400, 40)])
def test_plan_is_never_above_best_fit(mean, spread):
    draw = random.Random(mean)
    histogram = Counter(min(1024, max(1, int(draw.gauss(mean, spread)))) for _ in range(20_000))
    plan = packing.plan_sequences(dict(histogram), 1024)
    covered = Counter()
    for pattern, n in plan:
        covered.update({length: copies * n for length, copies in pattern})
    assert covered == histogram
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(dict(histogram), 1024))


def test_repeated_rows_are_ranked_in_many_groups(rows, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 16)
    pieces = packing.settle(packing.tokenized_pieces(rows("doc_id bigint, text string", *[(1, "a b")] * 400), 1024), "pieces")
    assert pieces.select("row_number").distinct().count() == 400
    ranked = packing.ranked_by_length(pieces, pieces.groupBy("length").count(), "doc_id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(400))


def test_packing(odd_docs, rows):
    got = packing.pack(odd_docs, size=16).collect()
    source = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    want = Counter()
    for (key, text), n in source.items():
        ids = library_ids(text) + [2]
        head = len(ids) % 16 or 16
        cuts = [(0, min(head, len(ids)))] + [(a, 16) for a in range(head, len(ids), 16)]
        for piece, (start, length) in enumerate(cuts):
            want[key, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += n
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 16
    assert packing.pack(rows("doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation_is_one_to_one(total):
    slots = training_order.permute(np.arange(total), total, 9)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert (slots != training_order.permute(np.arange(total), total, 10)).any()
        assert (np.diff(slots) == 1).mean() < 0.1


def test_shards_hold_every_sequence_in_its_slot(odd_docs, stored, spark, tmp_path, rows):
    docs = stored(odd_docs.repartition(3))
    folder = str(tmp_path / "shards")
    total = training_order.write_shards(docs, folder, seed=4, size=8, shard=10)
    got = training_order.read_shards(spark, folder, 8, 10).collect()
    assert sorted(r.slot for r in got) == list(range(total))
    assert all(r.byte_offset == r.slot % 10 * training_order.stride(8, 2) for r in got)
    want = Counter()
    for (key, text), n in Counter((r.doc_id, r.text) for r in docs.collect()).items():
        ids = library_ids(text) + [50256]
        for piece, at in enumerate(range(0, len(ids), 8)):
            want[key, piece, tuple(ids[at : at + 8])] += n
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in got) == want
    late = training_order.read_shards(spark, folder, 8, 10, first_slot=23).collect()
    assert sorted(map(tuple, late)) == sorted(tuple(r) for r in got if r.slot >= 23)
    again = str(tmp_path / "again")
    training_order.write_shards(docs, again, seed=4, size=8, shard=10)
    assert Counter(map(str, training_order.read_shards(spark, again, 8, 10).collect())) == Counter(map(str, got))
    assert training_order.materialise(stored(rows("doc_id bigint, text string"))).count() == 0


def test_registered_training_order_on_rows(rows, stored):
    many = [(k, t) for k, t in enumerate(texts(80, 200))] + [(None, "a b"), (5, None), (5, ""), (9, "word " * 3000)]
    many = [(1009 if t and len(t) > 9000 else k, t) for k, t in many]
    docs = stored(rows("doc_id bigint, text string, slot string", *[(*r, "x") for r in many]))
    size, shard = 16, 32
    got = training_order.materialise(docs, 7, size, shard).collect()
    want = Counter()
    for key, text in many:
        ids = library_ids(text) + [50256]
        for piece in range(0, len(ids), size):
            part = np.array(ids[piece : piece + size], "<u4")
            want[key, piece // size, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n)) and {r.shard for r in got} == set(range(-(-n // shard)))
    step = training_order.stride(size, 2)
    assert all(r.shard == r.slot // shard and r.byte_offset == r.slot % shard * step for r in got)
    # pieces of a document were numbered one after the other before the permutation
    slots = {}
    for r in got:
        if r.doc_id == 1009:
            slots[r.piece] = r.slot
    order = {s: k for k, s in enumerate(training_order.permute(np.arange(n), n, 7).tolist())}
    longest = [order[slots[k]] for k in range(len(slots)) if len(slots) > 1]
    assert sorted(b - a for a, b in zip(longest[1:], longest[2:])) == [1] * (len(longest) - 2)
