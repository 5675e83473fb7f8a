"""Byte-level BPE on ragged numpy arrays: splitting, rank-synchronous merging, decoding.

Texts arrive as one byte buffer with document bounds. Pre-tokens are found with array
operations, distinct ones are merged together (:meth:`ByteBpe.merge`) and remembered in a
bounded table, so a word costs one merge per worker and a look-up afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

SLICE_BYTES = 1 << 20  # texts worked on at once
REMEMBERED_WORDS = 1 << 19  # distinct pre-tokens a worker keeps
REMEMBERED_BYTES = 32 << 20  # of their ids and long texts

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
NO_RANK = np.int32(2**31 - 1)
# Any odd base has an inverse modulo 2**64, which the window hashes need.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0]+1, ... of ragged pieces, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))


class RollingHash:
    """Content hashes of any byte range of a buffer from one running sum."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = np.uint64(pow(int(BASE), -1, 2**64))
            for name, base in (("powers", BASE), ("inverse", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums; entry i covers the bytes before i."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= (end - start).astype(np.uint64) * MIX
        h ^= h >> np.uint64(29)
        h *= BASE
        return h ^ (h >> np.uint64(32))


class Spans:
    """What tells byte ranges of a buffer apart: lengths, first and last eight bytes, and all of long ones."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.data, self.start, self.length = data, start, end - start
        padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        short = np.maximum(8 - self.length, 0).astype(np.uint64) * np.uint64(8)
        none = self.length == 0
        self.head = np.where(none, 0, eights[start + 8] << np.where(none, 0, short))
        self.tail = np.where(none, 0, eights[end] >> np.where(none, 0, short))
        self.long = self.length > 16  # shorter ones are their head and tail

    def same(self, mine: np.ndarray, other: Spans, theirs: np.ndarray) -> np.ndarray:
        """Whether my ranges ``mine`` hold the same bytes as the other's ranges ``theirs``."""
        out = self.length[mine] == other.length[theirs]
        out &= (self.head[mine] == other.head[theirs]) & (self.tail[mine] == other.tail[theirs])
        at = np.flatnonzero(out & self.long[mine])
        if len(at):
            length = self.length[mine[at]]
            mine_bytes = self.data[spread(self.start[mine[at]], length)]
            differ = mine_bytes != other.data[spread(other.start[theirs[at]], length)]
            sums = np.concatenate([[0], np.cumsum(differ)])
            end = np.cumsum(length)
            out[at] = sums[end] == sums[end - length]
        return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            wider = np.empty(2 * (self.size + len(values)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Words:
    """Bounded table from words to token ids, found by hash and compared by bytes; empties itself when full."""

    def __init__(self, limit: int = REMEMBERED_WORDS, limit_bytes: int = REMEMBERED_BYTES) -> None:
        self.limit, self.limit_bytes = limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._first, self._count, self._ids = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        self._length, self._head, self._tail = Grown(np.int64), Grown(np.uint64), Grown(np.uint64)
        self._start, self._data = Grown(np.int64), Grown(np.uint8)

    def make_room(self, words: int) -> None:
        """Forget everything if so many more words could be too much."""
        full = self._ids.size * 4 + self._data.size > self.limit_bytes
        if full or len(self.keys) + words > max(self.limit, 2 * words):
            self.clear()

    def find(self, keys: np.ndarray, spans: Spans, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of every word ``spans[which]``, and whether it is there; a word that only shares a hash is not."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        row = self.row[at]
        known[known] = spans.same(which[known], self, row[known])
        return row, known

    # the parts of Spans that comparing takes
    length = property(lambda self: self._length.all)
    head = property(lambda self: self._head.all)
    tail = property(lambda self: self._tail.all)
    start = property(lambda self: self._start.all)
    data = property(lambda self: self._data.all)
    first = property(lambda self: self._first.all)
    count = property(lambda self: self._count.all)
    ids = property(lambda self: self._ids.all)

    def add(self, keys: np.ndarray, spans: Spans, which: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add words that are not in the table, with ascending keys."""
        free = np.ones(len(keys), bool)
        if len(self.keys):  # a hash that another word has already stays with that word
            free = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        free[1:] &= keys[1:] != keys[:-1]
        place = np.cumsum(count) - count
        keys, which, place, count = keys[free], which[free], place[free], count[free]
        row = self._first.size + np.arange(len(keys))
        self._first.add(self._ids.size + np.cumsum(count) - count)
        self._count.add(count)
        self._ids.add(ids[spread(place, count)])
        kept = np.where(spans.long[which], spans.length[which], 0)
        self._start.add(self._data.size + np.cumsum(kept) - kept)
        self._data.add(spans.data[spread(spans.start[which], kept)])
        self._length.add(spans.length[which])
        self._head.add(spans.head[which])
        self._tail.add(spans.tail[which])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, at, keys), np.insert(self.row, at, row)


class ByteBpe:
    """The tokenizer of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_pairs = self._ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.byte_of = np.zeros(int(self.byte_ids.max()) + 1, np.int64)
        self.byte_of[self.byte_ids] = np.arange(256)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in enumerate(alphabet)}
        texts = {i: bytes(to_byte[c] for c in word) for word, i in vocab.items()}
        texts |= {i: word for word, i in self.special.items()}
        pieces = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_first = np.cumsum(self.piece_length) - self.piece_length
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.hashes = RollingHash()
        self.words = Words()
        self._learn_kinds(np.arange(128))

    # -- splitting ---------------------------------------------------------------

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Ask the library how it treats characters not met before, so both know the same Unicode."""
        for p in points.tolist():
            for kind, mark in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(self.splitter.pre_tokenize_str(f"{mark}{chr(p)}{mark}")) == 1:
                    self.kinds[p] = kind
                    break
            else:
                self.kinds[p] = SPACE

    def _kinds_of(self, data: np.ndarray, at: np.ndarray, lead: np.ndarray) -> np.ndarray:
        kinds = self.kinds[np.minimum(lead, 127)]
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            b = [padded[at[wide] + k].astype(np.int32) for k in range(4)]
            two = (b[0] & 31) << 6 | b[1] & 63
            three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
            four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
            points = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
            found = self.kinds[points]
            if (found == UNKNOWN).any():
                self._learn_kinds(np.unique(points[found == UNKNOWN]))
                found = self.kinds[points]
            kinds[wide] = found
        return kinds

    def _specials(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Places of special strings, each inside one document."""
        raw, found = data.tobytes(), []
        for word in self.special:
            at = raw.find(word)
            while at >= 0:
                inside = np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + len(word) - 1, "right")
                if inside:
                    found.append((at, at + len(word)))
                at = raw.find(word, at + (len(word) if inside else 1))
        return sorted(found)

    def split(self, data: np.ndarray, bounds: np.ndarray, specials: bool = True) -> np.ndarray:
        """Byte offset of every pre-token of documents that begin at ``bounds``."""
        if not len(data):
            return np.empty(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kind = self._kinds_of(data, at, lead)
        marks = self._specials(data, bounds) if specials else []
        cuts = np.unique(np.concatenate([bounds, np.array([x for m in marks for x in m], np.int64)]))
        first = np.zeros(len(at) + 1, bool)
        first[np.searchsorted(at, cuts[cuts < len(data)])] = True
        first = first[:-1]
        first[0] = True
        # a run of one kind starts a pre-token, unless a single blank before it belongs to it
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        solid = kind != SPACE
        begins[1:] &= ~((lead[:-1] == 0x20) & ~first[1:] & solid[1:])
        # the last white space before a word is split off the rest of its run
        begins[:-1] |= ~solid[:-1] & solid[1:] & ~first[1:]
        self._contractions(lead, first, begins)
        starts = at[begins]
        for s, e in marks:  # a special string is one piece
            starts = starts[(starts <= s) | (starts >= e)]
        return starts

    @staticmethod
    def _contractions(lead: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a pre-token stand alone."""
        p = np.flatnonzero((lead == 0x27) & begins)
        if not len(p):
            return
        chars = np.concatenate([lead, np.zeros(3, np.uint8)])
        ends = np.concatenate([first, np.ones(3, bool)])
        a, b = np.where(ends[p + 1], 0, chars[p + 1]), np.where(ends[p + 1] | ends[p + 2], 0, chars[p + 2])
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begins[p[short | long] + 1] = False
        after = np.concatenate([p[short] + 2, p[long] + 3])
        begins[after[after < len(lead)]] = True

    # -- merging -----------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge ragged byte sequences to the end; returns their ids and how many survive in each.

        Every round applies, in all unfinished sequences at once, the pair of lowest rank
        of each. A merge of one rank can't make a pair of lower rank, so taking all its
        places in a sequence together gives what taking them one by one does.
        """
        owner = np.repeat(np.arange(len(lengths)), lengths)
        size = lengths.astype(np.int64).copy()
        ids = self.byte_ids[symbols]
        rank = np.full(len(symbols), NO_RANK, np.int32)
        if len(symbols) > 1:
            pairs = self.byte_pairs[symbols[:-1].astype(np.int64) << 8 | symbols[1:]]
            rank[:-1] = np.where(owner[:-1] == owner[1:], pairs, NO_RANK)
        live_size = size[size > 0]
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.cumsum(live_size) - live_size
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, live_size)
            going = each != NO_RANK
            if not going.all():
                done_ids.append(ids[~going])
                done_owner.append(owner[~going])
                ids, owner, rank, each = ids[going], owner[going], rank[going], each[going]
                live_size = live_size[best != NO_RANK]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == each)
            # of overlapping places (a a a) take every other one from the left
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            turn = np.arange(len(hit))
            hit = hit[(turn - np.maximum.accumulate(np.where(fresh, turn, 0))) & 1 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            gone = np.add.reduceat((~keep).astype(np.int64), np.cumsum(live_size) - live_size)
            live_size = live_size - gone
            moved = hit - np.arange(len(hit))  # where the merged symbols are after dropping
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            touched = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
            touched = touched[touched < len(ids)]
            after = np.minimum(touched + 1, len(ids) - 1)
            same = (owner[touched] == owner[after]) & (after > touched)
            rank[touched] = np.where(same, self._ranks(ids[touched], ids[after]), NO_RANK)
        if not done_ids:
            return np.empty(0, np.int32), size
        flat, whose = np.concatenate(done_ids), np.concatenate(done_owner)
        return flat[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(lengths))

    # -- whole texts -------------------------------------------------------------

    def look_up(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id and number of ids of every pre-token in the array that comes third; new words are merged.

        Words are found by hash and compared by bytes, in the text and in the table. One that only
        shares its hash with another is a word of its own.
        """
        ends = np.append(starts[1:], len(data))
        found = self.hashes.of(self.hashes.sums(data), starts, ends)
        spans = Spans(data, starts, ends)
        keys, first, inverse = np.unique(found, return_index=True, return_inverse=True)
        odd = np.flatnonzero(~spans.same(np.arange(len(starts)), spans, first[inverse]))
        if len(odd):
            inverse[odd] = len(keys) + np.arange(len(odd))
            keys, first = np.concatenate([keys, found[odd]]), np.concatenate([first, odd])
        self.words.make_room(len(keys))
        row, known = self.words.find(keys, spans, first)
        place, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place[known], count[known] = self.words.first[row[known]], self.words.count[row[known]]
        pool = self.words.ids
        if not known.all():
            fresh = np.flatnonzero(~known)
            new = first[fresh]
            lengths = spans.length[new]
            ids, sizes = self.merge(data[spread(starts[new], lengths)], lengths)
            for word, number in self.special.items():
                for k in np.flatnonzero(lengths == len(word)):
                    s = starts[new[k]]
                    if data[s : s + len(word)].tobytes() == word:
                        at = int(sizes[:k].sum())
                        ids = np.concatenate([ids[:at], [number], ids[at + sizes[k] :]]).astype(np.int32)
                        sizes[k] = 1
            place[fresh], count[fresh] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, ids])
            order = np.argsort(keys[fresh], kind="stable")
            sorted_ids = ids[spread((np.cumsum(sizes) - sizes)[order], sizes[order])]
            self.words.add(keys[fresh][order], spans, new[order], sorted_ids, sizes[order])
        return place[inverse], count[inverse], pool

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each document; ``bounds`` holds n + 1 offsets."""
        starts = self.split(data, bounds)
        sums = np.zeros(len(starts) + 1, np.int64)
        if len(starts):
            np.cumsum(self.look_up(data, starts)[1], out=sums[1:])
        return np.diff(sums[np.searchsorted(starts, bounds)])

    def encode(self, data: np.ndarray, bounds: np.ndarray, specials: bool = True):
        """Ids of all documents in one array, tokens of each document."""
        ids, starts, count = self.encode_pieces(data, bounds, specials)
        sums = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        return ids, np.diff(sums[np.searchsorted(starts, bounds)])

    def encode_pieces(self, data: np.ndarray, bounds: np.ndarray, specials: bool = True):
        """Ids, the start of every pre-token, and the tokens of every pre-token."""
        starts = self.split(data, bounds, specials)
        if not len(starts):
            return np.empty(0, np.int32), starts, np.empty(0, np.int64)
        place, count, pool = self.look_up(data, starts)
        return pool[spread(place, count)], starts, count

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids, special tokens included."""
        return self.piece_bytes[spread(self.piece_first[ids], self.piece_length[ids])]


@cache
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer per worker process and file."""
    return ByteBpe(path)


def safe_cut(data: np.ndarray, start: int, size: int) -> int:
    """First place after ``start + size`` where a blank follows an ASCII letter or digit, else the end.

    No pre-token and no special string crosses such a place.
    """
    at = start + size
    while at < len(data):
        part = data[at - 1 : at + size]
        before = part[:-1] | 0x20
        word = (before >= 0x61) & (before <= 0x7A) | (part[:-1] >= 0x30) & (part[:-1] <= 0x39)
        hit = np.flatnonzero(word & (part[1:] == 0x20))
        if len(hit):
            return at + int(hit[0])
        at += size
    return len(data)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes, one document at least."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end


def blocks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Work units (first document, end, bytes, bounds); a long text is cut at safe places."""
    for a, b in slices(bounds):
        part = data[bounds[a] : bounds[b]]
        if b - a > 1 or len(part) <= 2 * SLICE_BYTES:
            yield a, b, part, bounds[a : b + 1] - bounds[a]
            continue
        at = 0
        while at < len(part):
            end = safe_cut(part, at, SLICE_BYTES)
            yield a, b, part[at:end], np.array([0, end - at])
            at = end


def count_texts(bpe: ByteBpe, column: pa.Array) -> np.ndarray:
    """Tokens of every text of a column."""
    data, bounds = text_buffer(column)
    out = np.zeros(len(column), np.int64)
    for a, b, part, cut in blocks(data, bounds):
        out[a:b] += bpe.count(part, cut)
    return out


def encode_texts(bpe: ByteBpe, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of a run of rows, tokens of each row), whole rows at a time."""
    data, bounds = text_buffer(column)
    held: list[np.ndarray] = []
    for a, b, part, cut in blocks(data, bounds):
        ids, count = bpe.encode(part, cut)
        if b - a == 1 and bounds[b] - bounds[a] > 2 * SLICE_BYTES:
            held.append(ids)
            if sum(map(len, held)) and is_last(part, data[bounds[a] : bounds[b]]):
                whole = np.concatenate(held)
                held = []
                yield a, whole, np.array([len(whole)])
        else:
            yield a, ids, count


def is_last(part: np.ndarray, whole: np.ndarray) -> bool:
    return part.ctypes.data + len(part) == whole.ctypes.data + len(whole)
