"""BPE encoding and decoding with reuse of content-defined chunks (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm import bpe
from forgeline.llm.token_counts import VOCABULARY

WINDOW = 16  # bytes that decide about a cut
CHUNK_BITS = 9  # a cut every 512 bytes on average
LEAST_CHUNK = 96  # no cut nearer than this to another or to an end of the text
REUSED_BYTES = 16 << 20  # text of chunks a worker keeps
LOOKAHEAD = 3  # characters behind a pre-token that may change it


class Chunk:
    """A chunk encoded on its own: ids, and where each pre-token starts in bytes and in ids."""

    __slots__ = ("ids", "starts", "places", "sure")

    def __init__(self, text: bytes, ids: np.ndarray, starts: np.ndarray, count: np.ndarray) -> None:
        self.ids = ids
        self.starts = np.append(starts, len(text)).astype(np.int32)
        self.places = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        # Pre-tokens that end this far from the end stay as they are whatever follows.
        limit = len(text)
        for _ in range(LOOKAHEAD):
            limit -= 1
            while limit > 0 and text[limit] & 0xC0 == 0x80:
                limit -= 1
        ends = self.starts[1:]
        self.sure = int(np.searchsorted(ends, limit, "right")) if limit > 0 else 0


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks of any documents of a worker are encoded once."""

    def __init__(self, tokenizer: bpe.ByteBpe, reused_bytes: int = REUSED_BYTES) -> None:
        self.tokenizer = tokenizer
        self.reused_bytes = reused_bytes
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple[bytes, bytes], tuple[int, int, np.ndarray] | None] = {}
        self.held = 0

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Places where the rolling hash of the bytes before ends in zeros, at whole characters."""
        if len(data) <= WINDOW:
            return []
        hashes = self.tokenizer.hashes
        end = np.arange(WINDOW, len(data))
        rolling = hashes.of(hashes.sums(data), end - WINDOW, end)
        hit = end[(rolling & np.uint64((1 << CHUNK_BITS) - 1) == 0) & (data[WINDOW:] & 0xC0 != 0x80)]
        doc = np.searchsorted(bounds, hit, "right")
        last, kept = -LEAST_CHUNK, []
        for at, low, high in zip(hit.tolist(), bounds[doc - 1].tolist(), bounds[doc].tolist()):
            if at - max(last, low) >= LEAST_CHUNK <= high - at:
                kept.append(at)
                last = at
        return kept

    def _encode_all(self, texts: list[bytes]) -> None:
        """Encode chunks not met before, all of them in one batch."""
        todo = [t for t in dict.fromkeys(texts) if t not in self.chunks]
        if not todo:
            return
        for text, chunk in zip(todo, self._chunks_of(todo)):
            self.chunks[text] = chunk
            self.held += len(text)

    def _chunks_of(self, texts: list[bytes]) -> list[Chunk]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        ids, starts, count = self.tokenizer.encode_pieces(data, bounds, specials=False)
        places = np.concatenate([[0], np.cumsum(count)])
        at = np.searchsorted(starts, bounds).tolist()
        return [
            Chunk(t, ids[places[a] : places[b]].copy(), starts[a:b] - start, count[a:b])
            for t, a, b, start in zip(texts, at, at[1:], bounds.tolist())
        ]

    def _plain(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return self.tokenizer.encode(data, np.array([0, len(text)]), specials=False)[0]

    def _repair_all(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """Settle joins not met before, all of them in one batch per round.

        A join is (first unsure id of the left chunk, first id of the right chunk that stands,
        ids between). The unsure end of the left chunk is encoded again with ever more of the
        right one, until a pre-token that can't change any more starts where one of the right
        chunk's own starts; from there on both agree for good. It is None if the right chunk
        ends before that.
        """
        todo = [p for p in dict.fromkeys(pairs) if p not in self.joins]
        pieces = 2
        while todo:
            pieces *= 2
            tails, texts = [], []
            for left, right in todo:
                a, b = self.chunks[left], self.chunks[right]
                tails.append(len(left) - int(a.starts[a.sure]))
                texts.append(left[int(a.starts[a.sure]) :] + right[: int(b.starts[min(pieces, len(b.starts) - 1)])])
            again = self._chunks_of(texts)
            late = []
            for pair, tail, new in zip(todo, tails, again):
                a, b = self.chunks[pair[0]], self.chunks[pair[1]]
                known = set(b.starts[: min(pieces, b.sure) + 1].tolist())
                # a pre-token start that is final, behind the join, and shared with the right chunk
                for here, at in enumerate(new.starts[: new.sure + 1].tolist()):
                    if at >= tail and at - tail in known:
                        there = int(np.searchsorted(b.starts, at - tail))
                        between = new.ids[: int(new.places[here])]
                        self.joins[pair] = (int(a.places[a.sure]), int(b.places[there]), between)
                        break
                else:
                    if pieces < len(b.starts) - 1:
                        late.append(pair)
                    else:
                        self.joins[pair] = None
            todo = late

    def segment(self, chunks: list[bytes]) -> np.ndarray:
        """Ids of a run of chunks; joins are repaired, or all of it is encoded anew where one can't be."""
        if len(chunks) == 1:
            return self.chunks[chunks[0]].ids
        out, begin = [], 0
        for left, right in zip(chunks, chunks[1:]):
            fixed = self.joins[left, right]
            if fixed is None or fixed[0] < begin:
                return self._plain(b"".join(chunks))
            out += [self.chunks[left].ids[begin : fixed[0]], fixed[2]]
            begin = fixed[1]
        out.append(self.chunks[chunks[-1]].ids[begin:])
        return np.concatenate(out)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of every document of a buffer."""
        if self.held > self.reused_bytes:
            self.chunks, self.joins, self.held = {}, {}, 0
        marks = self.tokenizer._specials(data, bounds) if len(data) else []
        special = {s: self.tokenizer.special[data[s:e].tobytes()] for s, e in marks}
        edges = np.array([x for m in marks for x in m], np.int64)
        cuts = np.unique(np.concatenate([np.array(self.cuts(data, bounds), np.int64), edges, bounds]))
        raw = data.tobytes()
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        inside = set()  # parts of a special string that the rolling hash cut
        for s, e in marks:
            inside.update(c for c in cuts[(cuts > s) & (cuts < e)].tolist())
        texts = [raw[a:b] for a, b in spans]
        self._encode_all([t for t, (a, _) in zip(texts, spans) if a not in special and a not in inside])
        breaks = set(edges.tolist())
        plan: list[list[list[bytes] | int]] = []  # per document: runs of chunks and special ids
        k = 0
        for end in bounds[1:].tolist():
            parts: list[list[bytes] | int] = []
            while k < len(spans) and spans[k][0] < end:
                at = spans[k][0]
                if at in special:
                    parts.append(special[at])
                elif at not in inside:
                    if not parts or at in breaks or isinstance(parts[-1], int):
                        parts.append([])
                    parts[-1].append(texts[k])
                k += 1
            plan.append(parts)
        runs = [r for parts in plan for r in parts if not isinstance(r, int)]
        self._repair_all([p for r in runs for p in zip(r, r[1:])])
        for parts in plan:
            ids = [np.array([r], np.int32) if isinstance(r, int) else self.segment(r) for r in parts]
            yield np.concatenate(ids) if ids else np.empty(0, np.int32)


@cache
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder per worker process and file, so that its chunks outlive a task."""
    return ChunkEncoder(bpe.tokenizer(path))


def encode_documents(encoder: ChunkEncoder, column: pa.Array) -> Iterator[np.ndarray]:
    """Ids of every text of a column, long texts in parts cut where no pre-token crosses."""
    data, bounds = bpe.text_buffer(column)
    held: list[np.ndarray] = []
    for a, b, part, cut in bpe.blocks(data, bounds):
        if b - a > 1 or len(part) == bounds[b] - bounds[a]:
            yield from encoder.encode(part, cut)
            continue
        held += encoder.encode(part, cut)
        if bpe.is_last(part, data[bounds[a] : bounds[b]]):
            yield np.concatenate(held)
            held = []


def decode(tokenizer: bpe.ByteBpe, ids: np.ndarray) -> bytes:
    """UTF-8 text of ids; bytes that are no UTF-8 become replacement characters."""
    raw = tokenizer.decode_bytes(ids).tobytes()
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode("utf-8")


def encode(
    docs: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Ids of every whole text (``ids``, little-endian unsigned 32-bit), or digests of them.

    One narrow pass, nothing is shuffled. Texts are cut where a rolling hash of the last bytes
    ends in zeros, so passages that documents share yield the same chunks; a worker process
    encodes a chunk once and keeps it for its later tasks too, until it holds ``REUSED_BYTES`` of them. Joins between chunks are encoded again
    until they agree with the chunk that follows. With ``digests`` the ids are also decoded
    and both sides come back as SHA-256.

    A null or empty text has no ids; a null key stays null; repeated rows give a row each; an
    empty table gives none. Special strings in a text are special tokens, as the library's
    default has it. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        tokenizer = encoder.tokenizer
        for batch in batches:
            at, count, shown = 0, [], [[], []]

            def flush(final: bool = False):
                nonlocal at, count, shown
                names = ("ids_sha256", "decoded_sha256") if digests else ("ids",)
                rows = batch.column(0).slice(at, len(count))
                kinds = pa.string() if digests else pa.binary()
                columns = [pa.array(x, kinds) for x in shown[: len(names)]]
                at += len(count)
                done = pa.RecordBatch.from_arrays(
                    [rows, pa.array(count, pa.int64()), *columns], names=[key, "n_tokens", *names]
                )
                count, shown = [], [[], []]
                return done

            size = 0
            for ids in encode_documents(encoder, batch.column(1)):
                packed = ids.astype("<u4").tobytes()
                count.append(len(ids))
                if digests:
                    shown[0].append(hashlib.sha256(packed).hexdigest())
                    shown[1].append(hashlib.sha256(decode(tokenizer, ids)).hexdigest())
                else:
                    shown[0].append(packed)
                    size += len(packed)
                    if size > 16 << 20:
                        size = 0
                        yield flush()
            yield flush()

    outputs = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, n_tokens bigint, {outputs}")


def decode_ids(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of the ids that :func:`encode` returned; null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        for batch in batches:
            texts = [
                None if x is None else decode(tokenizer, np.frombuffer(x, "<u4").astype(np.int64)).decode()
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {key_type}, text string")
