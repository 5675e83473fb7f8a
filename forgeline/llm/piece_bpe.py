"""SentencePiece encoding and decoding by a table of distinct marked words (operator 11).

A BPE model whose pieces hold the white space mark only in front can't merge across the place
where a mark follows another character. So a text is a run of marked words that don't touch each
other: every distinct one is segmented once and its ids are joined back at all its positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm import bpe
from forgeline.sources.tables import settle

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
SHARED_WORDS = 1 << 19  # words of the broadcast table at most
SHARED_LENGTH = 64  # bytes of a word of that table at most
LONG_WORD = 1024  # bytes from which a word is cut where no piece can join its sides
STEPS = 8  # steps of the histogram of word counts per doubling
NO_PREFIX = b"\x1a\x02\x18\x00"  # fixed value: the model file's field that turns the leading mark off


def piece_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class PieceModel:
    """The library's model, its pieces as bytes, and which neighbours some piece holds."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        # The same model without the mark in front, so that any part of a text can be segmented.
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=raw + NO_PREFIX)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(k) for k in range(n)]
        plain = [
            not (self.library.is_control(k) or self.library.is_byte(k) or self.library.is_unknown(k)) for k in range(n)
        ]
        if any(MARK in p.lstrip(MARK) for p, ok in zip(pieces, plain) if ok):
            raise ValueError("pieces of this model cross white space: its words can't be segmented apart")
        if self.library.encode(" a  b ") != self.inner.encode("  a  b "):
            raise ValueError("this model changes white space: its words can't be segmented apart")
        shown = []
        for k, p in enumerate(pieces):
            if self.library.is_byte(k):
                shown.append(bytes([int(p[3:5], 16)]))
            elif self.library.is_control(k):
                shown.append(b"")
            elif self.library.is_unknown(k):
                shown.append(self.library.decode([k]).encode())
            else:
                shown.append(p.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(shown), np.uint8)
        self.length = np.array([len(s) for s in shown], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.control = np.array([self.library.is_control(k) for k in range(n)])
        self.marked = np.array([ok and p.startswith(MARK) for p, ok in zip(pieces, plain)])
        self.byte = np.array([self.library.is_byte(k) for k in range(n)])
        self.number = np.array([b"%d," % k for k in range(n)], object)
        near = {(ord(a), ord(b)) for p, ok in zip(pieces, plain) if ok for a, b in zip(p, p[1:])}
        self.near = np.sort(np.array([a << 21 | b for a, b in near], np.int64))

    def segment(self, words: list[bytes]) -> list[list[int]]:
        """Ids of marked words, given without their first mark and with blanks for the others."""
        out = self.inner.encode([" " + w.decode() if len(w) <= LONG_WORD else "" for w in words], num_threads=1)
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._segment_long(" " + w.decode())
        return out

    def _segment_long(self, word: str) -> list[int]:
        """Ids of a long word, cut between neighbours that no piece holds."""
        points = np.frombuffer(word.replace(" ", MARK).encode("utf-32-le"), np.int32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.near, pairs), len(self.near) - 1)
        cuts = np.flatnonzero(self.near[at] != pairs) + 1
        if len(cuts):  # the first possible cut behind each multiple of LONG_WORD
            wanted = np.searchsorted(cuts, np.arange(LONG_WORD, len(word), LONG_WORD))
            cuts = cuts[np.unique(wanted[wanted < len(cuts)])]
        edges = [0, *cuts.tolist(), len(word)]
        return [i for a, b in zip(edges, edges[1:]) for i in self.inner.encode(word[a:b])]

    def decode(self, ids: np.ndarray, opening: bool = True) -> bytes:
        """UTF-8 of ids; with ``opening`` the mark that encoding puts in front is taken off again."""
        raw = self.surface[bpe.spread(self.first[ids], self.length[ids])].tobytes()
        if self.byte[ids].any():
            try:
                raw.decode()
            except UnicodeDecodeError:  # bytes that are no characters: as the library shows them
                return self.library.decode(ids.tolist()).encode()
        if opening:
            said = np.flatnonzero(~self.control[ids])
            if len(said) and self.marked[ids[said[0]]]:
                return raw[1:]
        return raw


@cache
def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)


class WordTable:
    """Words by hash, with their bytes for the check and their ids."""

    def __init__(self, words: list[bytes], ids: list[np.ndarray]) -> None:
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        rolling = bpe.RollingHash()
        keys = rolling.of(rolling.sums(data), end - length, end) if len(words) else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.data = keys[order], data
        self.first, self.length = (end - length)[order], length[order]
        count = np.array([len(i) for i in ids], np.int64)
        self.ids = np.concatenate([np.empty(0, np.uint16), *ids])
        self.at, self.count = (np.cumsum(count) - count)[order], count[order]


def same_bytes(
    a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Whether a[a_first:][:length] equals b[b_first:][:length], for each of many ranges."""
    wrong = a[bpe.spread(a_first, length)] != b[bpe.spread(b_first, length)]
    bad = np.concatenate([[0], np.cumsum(wrong)])
    end = np.cumsum(length)
    return bad[end] == bad[end - length]


class Segmenter:
    """Encodes buffers of texts: distinct words from the shared table, the others once per buffer."""

    def __init__(self, pieces: PieceModel, table: WordTable) -> None:
        self.pieces, self.table, self.hashes = pieces, table, bpe.RollingHash()

    @staticmethod
    def words(data: np.ndarray, bounds: np.ndarray, opening: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every marked word without its first mark, and words of each text.

        ``opening`` says that the buffer's texts begin there; else the first mark of each is its own.
        """
        blank = data == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[heads] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        count = np.diff(np.searchsorted(start, bounds))
        skip = np.ones(len(start), np.int64)
        if opening:
            skip[np.searchsorted(start, heads)] = 0
        return start + skip, end, count

    def distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first place of every distinct word, and which one each word is."""
        found = self.hashes.of(self.hashes.sums(data), start, end)
        keys, first, which = np.unique(found, return_index=True, return_inverse=True)
        length = end - start
        alike = length == length[first][which]
        alike[alike] = same_bytes(data, start[alike], data, start[first][which][alike], length[alike])
        odd = np.flatnonzero(~alike)  # words that only share a hash stand for themselves
        which[odd] = len(keys) + np.arange(len(odd))
        return np.concatenate([keys, found[odd]]), np.concatenate([first, odd]), which

    def encode(self, data: np.ndarray, bounds: np.ndarray, opening: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and tokens of each text."""
        start, end, count = self.words(data, bounds, opening)
        if not len(start):
            return np.empty(0, np.int64), np.zeros(len(count), np.int64)
        keys, first, which = self.distinct(data, start, end)
        table, length = self.table, (end - start)[first]
        at = np.searchsorted(table.keys, keys).clip(max=max(len(table.keys) - 1, 0))
        known = np.zeros(len(keys), bool)
        if len(table.keys):
            known = (table.keys[at] == keys) & (table.length[at] == length)
            known[known] = same_bytes(data, start[first[known]], table.data, table.first[at[known]], length[known])
        rare = np.flatnonzero(~known)
        raw = data.tobytes()
        fresh = self.pieces.segment([raw[start[k] : end[k]] for k in first[rare].tolist()])
        sizes = np.array([len(i) for i in fresh], np.int64)
        places = np.zeros(len(keys), np.int64)
        tokens = np.zeros(len(keys), np.int64)
        places[known], tokens[known] = table.at[at[known]], table.count[at[known]]
        places[rare], tokens[rare] = len(table.ids) + np.cumsum(sizes) - sizes, sizes
        own = np.fromiter((i for ids in fresh for i in ids), np.int64, int(sizes.sum()))
        each = tokens[which]
        where = bpe.spread(places[which], each)
        shared = where < len(table.ids)
        ids = np.empty(len(where), np.int64)
        ids[shared] = table.ids[where[shared]]
        ids[~shared] = own[where[~shared] - len(table.ids)]
        sums = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(count)])])


def marked(column: pa.Array) -> pa.Array:
    """Texts in which the mark itself is a blank, as the model takes both for the same."""
    return pc.replace_substring(column, MARK, " ")


def parts(segmenter: Segmenter, column: pa.Array) -> Iterator[tuple[int, np.ndarray, bool, bool]]:
    """(row, ids, whether they open the text, whether they end it), long texts in several parts."""
    data, bounds = bpe.text_buffer(marked(column))
    for a, b, part, cut in bpe.blocks(data, bounds):
        whole = b - a > 1 or len(part) == bounds[b] - bounds[a]
        opens = whole or part.ctypes.data == data[bounds[a] :].ctypes.data
        ids, count = segmenter.encode(part, cut, opens)
        ends = whole or bpe.is_last(part, data[bounds[a] : bounds[b]])
        for row, some in zip(range(a, b), np.split(ids, np.cumsum(count)[:-1])):
            yield row, some, opens, ends


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct marked word of at most ``SHARED_LENGTH`` bytes and how often it stands in the corpus.

    Tasks send a word once per slice of text, counted; Spark adds these before and after its shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Segmenter(None, None)
        for batch in batches:
            data, bounds = bpe.text_buffer(marked(batch.column(0)))
            for a, b, part, cut in bpe.blocks(data, bounds):
                opens = b - a > 1 or part.ctypes.data == data[bounds[a] :].ctypes.data
                start, end, _ = finder.words(part, cut, opens)
                if not len(start):
                    continue
                _, first, which = finder.distinct(part, start, end)
                count = np.bincount(which, minlength=len(first))
                length = (end - start)[first]
                kept = np.flatnonzero(length <= SHARED_LENGTH)
                offsets = np.concatenate([[0], np.cumsum(length[kept])]).astype(np.int32)
                flat = part[bpe.spread(start[first[kept]], length[kept])]
                words = pa.BinaryArray.from_buffers(
                    pa.binary(), len(kept), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([words, pa.array(count[kept])], names=["word", "n"])

    found = docs.select(F.col(text)).mapInArrow(run, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def shared_table(docs: DataFrame, path: str, text: str = "text", most: int = SHARED_WORDS) -> WordTable:
    """The words that stand most often in the whole corpus, each segmented once.

    All words are counted. A histogram of the counts (some hundred rows) says from which count on
    the words fit into ``most``; only those are segmented, by tasks, and gathered: at most ``most``
    words of ``SHARED_LENGTH`` bytes. Words that stand once gain nothing from a table and stay out.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    counted = settle(word_counts(docs, text).filter("n > 1").withColumn("step", step), "words")
    room, least = most, None
    for row in sorted(counted.groupBy("step").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return WordTable([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            ids = [np.array(i, np.uint16).tobytes() for i in pieces.segment(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    chosen = counted.filter(F.col("step") >= least).select("word").mapInArrow(run, "word binary, ids binary").toArrow()
    return WordTable(
        chosen.column("word").to_pylist(), [np.frombuffer(i, np.uint16) for i in chosen.column("ids").to_pylist()]
    )


def _encode(docs: DataFrame, path: str, key: str, text: str, most: int, pack: Callable, outputs: str) -> DataFrame:
    if not len(model(path).control) <= 1 << 16:
        raise ValueError("ids of this model need more than 16 bits")
    table = docs.sparkSession.sparkContext.broadcast(shared_table(docs, path, text, most))
    key_type = docs.schema[key].dataType.simpleString()
    names = [part.split(" ")[0] for part in outputs.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.binary() for part in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(model(path), table.value)
        for batch in batches:
            at, count, shown, size = 0, [], [], 0
            state, tokens = None, 0
            for _, ids, opens, ends in parts(segmenter, batch.column(1)):
                if opens:
                    state, tokens = pack(segmenter.pieces), 0
                state.add(ids, opens)
                tokens += len(ids)
                if not ends:
                    continue
                count.append(tokens)
                shown.append(state.done())
                size += sum(map(len, shown[-1]))
                if size > 16 << 20 or at + len(count) == len(batch):
                    columns = [pa.array([s[k] for s in shown], kind) for k, kind in enumerate(kinds)]
                    rows = batch.column(0).slice(at, len(count))
                    yield pa.RecordBatch.from_arrays(
                        [rows, pa.array(count, pa.int64()), *columns], names=[key, "n_tokens", *names]
                    )
                    at, count, shown, size = at + len(count), [], [], 0

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, n_tokens bigint, {outputs}")


class Ids:
    """Ids of a text as little-endian unsigned 16-bit numbers."""

    def __init__(self, pieces: PieceModel) -> None:
        self.held: list[bytes] = []

    def add(self, ids: np.ndarray, opens: bool) -> None:
        self.held.append(ids.astype("<u2").tobytes())

    def done(self) -> tuple[bytes]:
        return (b"".join(self.held),)


class Digests:
    """SHA-256 of the ids as decimals with commas, and of the text they decode to, part by part."""

    def __init__(self, pieces: PieceModel) -> None:
        self.pieces, self.ids, self.text, self.held = pieces, hashlib.sha256(), hashlib.sha256(), b""

    def add(self, ids: np.ndarray, opens: bool) -> None:
        numbers = self.held + b"".join(self.pieces.number[ids].tolist())
        self.ids.update(numbers[:-1])
        self.held = numbers[-1:]  # the last comma goes if nothing follows
        self.text.update(self.pieces.decode(ids, opens))

    def done(self) -> tuple[str, str]:
        return self.ids.hexdigest(), self.text.hexdigest()


def encode(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", most: int = SHARED_WORDS
) -> DataFrame:
    """Ids of every whole text (``ids``, little-endian unsigned 16-bit).

    Two passes over the texts, which are never shuffled. The first counts all distinct marked words
    of the corpus; the most frequent (``most`` at most, a fixed bound on what is broadcast) are
    segmented once and sent to all tasks. The second finds every word of a text by its position:
    its ids come from the table, after its bytes have been compared, and a word that is too rare or
    too long for the table is segmented where it stands, once per slice of text.

    A null or empty text has no ids; a null key stays null; repeated rows give a row each; an empty
    table gives none. Long texts are worked through in parts cut where no piece crosses, a long word
    likewise; memory grows only with a stretch that has no such place. Other columns are not read.
    """
    return _encode(docs, path or piece_path(), key, text, most, Ids, "ids binary")


def digests(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", most: int = SHARED_WORDS
) -> DataFrame:
    """As :func:`encode`, decoded again, both sides as SHA-256 (``ids_sha256``, ``decoded_sha256``)."""
    return _encode(docs, path or piece_path(), key, text, most, Digests, "ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of the ids that :func:`encode` returned; null ids give null."""
    path = path or piece_path()
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [
                None if x is None else pieces.decode(np.frombuffer(x, "<u2").astype(np.int64)).decode()
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {key_type}, text string")
