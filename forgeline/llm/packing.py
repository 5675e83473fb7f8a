"""Packing documents into few fixed-length sequences by a configuration linear program (operator 10)."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm import bpe
from forgeline.llm.token_counts import vocabulary_path
from forgeline.sources.tables import settle

END_ID = 2
RANK_GROUP = 4096  # pieces of one length ranked together
KEPT_SIXTEENTHS = (16, 15, 14, 12, 8, 4, 2, 0)  # parts of the program that rounding tries to keep

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def cut_pieces(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces; only the first may be short."""
    pieces = np.maximum(1, -(-count // size))
    doc = np.repeat(np.arange(len(count)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = count - (pieces - 1) * size
    start = np.where(number == 0, 0, head[doc] + (number - 1) * size)
    return doc, number, start, np.where(number == 0, head[doc], size)


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after every document."""
    return np.insert(ids, np.cumsum(count), end_id), count + 1


def tokenized_pieces(
    docs: DataFrame, size: int, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Pieces of every document: key, piece, start, length, the CRC-32 of the ids and a row number.

    The row number is made of the task's partition and a count, so it tells repeated rows apart
    once the table is written.
    """
    path = path or vocabulary_path()
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, ids, count in bpe.encode_texts(tokenizer, batch.column(1)):
                ids, count = with_end(ids, count, end_id)
                doc, number, start, length = cut_pieces(count, size)
                flat = memoryview(ids.astype("<u4")).cast("B")
                first = (np.cumsum(count) - count)[doc] + start
                sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + row)),
                        pa.array(number.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                        pa.array(np.arange(next_row, next_row + len(doc))),
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32", "row_number"],
                )
                next_row += len(doc)

    schema = f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint, row_number bigint"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


# -- the program over the length histogram ---------------------------------------------


def best_patterns(lengths: np.ndarray, values: np.ndarray, size: int, columns: int) -> list[np.ndarray]:
    """Copies of each length in the most valuable of the fullest patterns: a knapsack by dynamic programming.

    ``lengths`` are ascending. For every fill, the best last piece is chosen among all lengths
    that fit. The fill nearest to ``size`` that can be reached is followed back from each of
    the ``columns`` best last pieces, so that one table prices several patterns.
    """
    worth = np.full(size + 1, -np.inf)
    worth[0] = 0
    last = np.full(size + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right").tolist()
    back = -lengths
    for c in range(int(lengths[0]), size + 1):
        n = fits[c]
        offer = worth[back[:n] + c] + values[:n]
        k = int(offer.argmax())
        worth[c], last[c] = offer[k], k
    full = int(np.flatnonzero(np.isfinite(worth)).max())
    offer = worth[back[: fits[full]] + full] + values[: fits[full]]
    found = []
    for k in np.argsort(-offer, kind="stable")[:columns]:
        if not np.isfinite(offer[k]):
            break
        copies = np.zeros(len(lengths), np.int64)
        copies[k] = 1
        c = full - int(lengths[k])
        while c > 0:
            copies[last[c]] += 1
            c -= int(lengths[last[c]])
        found.append(copies)
    return found


def fractional(lengths: np.ndarray, need: np.ndarray, size: int, rounds: int, rate: float, columns: int = 16):
    """Patterns and how often to use each: the configuration program by multiplicative weights.

    A length's price is its share of a sequence, the dual solution of a packing without
    waste, times a weight that falls exponentially with the part of its need covered so far.
    Each round prices patterns by a knapsack, and uses the best ones as often as covers
    ``rate`` of the tightest need in each.
    """
    covered = np.zeros(len(need))
    uses: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        share = covered / need
        if (share >= 1).all():
            break
        for copies in best_patterns(lengths, lengths / size * np.exp(-share / rate), size, columns):
            used = copies > 0
            times = rate * float((need[used] / copies[used]).min())
            uses[tuple(copies.tolist())] += times
            covered += copies * times
    return np.array(list(uses), np.int64), np.array(list(uses.values()))


def take_whole(patterns: np.ndarray, times: np.ndarray, need: np.ndarray, lengths: np.ndarray, size: int):
    """Round down: use every pattern without waste a whole number of times, never beyond what is left."""
    left, plan = need.copy(), []
    for k in np.flatnonzero(patterns @ lengths == size):
        used = patterns[k] > 0
        n = int(min(np.floor(times[k] + 1e-9), (left[used] // patterns[k][used]).min()))
        if n > 0:
            left -= n * patterns[k]
            plan.append((tuple((int(lengths[i]), int(patterns[k][i])) for i in np.flatnonzero(used)[::-1]), n))
    return left, plan


def best_fit(need: dict[int, int], size: int):
    """Best fit, longest first, over counts: whole groups of equal bins are filled at once."""
    groups: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted(need, reverse=True):
        todo = need[length]
        while todo:
            room = min((r for r, g in groups.items() if r >= length and g), default=None)
            if room is None:
                fit = size // length
                for copies, n in ((fit, todo // fit), (todo % fit, 1)):
                    if copies and n:
                        groups[size - copies * length][((length, copies),)] += n
                break
            pattern, n = groups[room].popitem()
            placed = min(n, todo)
            if placed < n:
                groups[room][pattern] += n - placed
            tail = pattern[-1]
            grown = (*pattern[:-1], (length, tail[1] + 1)) if tail[0] == length else (*pattern, (length, 1))
            groups[room - length][grown] += placed
            todo -= placed
    return [(p, n) for g in groups.values() for p, n in g.items() if n]


def keep_first(plan: list[tuple[Pattern, int]], sequences: int, left: dict[int, int]):
    """The first sequences of a plan, and what is left when the others are given back."""
    kept, rest = [], defaultdict(int, left)
    for pattern, n in plan:
        stay = min(n, sequences)
        sequences -= stay
        if stay:
            kept.append((pattern, stay))
        for length, copies in pattern if stay < n else ():
            rest[length] += copies * (n - stay)
    return kept, rest


def round_plan(plan: list[tuple[Pattern, int]], left: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Sequences of a rounded program and of the pieces that it left, as few as giving back can make them.

    A program that has used up the small pieces leaves long ones that nothing fills. So patterns
    are ordered, by their smallest piece or by how few pieces they have, and growing parts from
    the end are given back to what best fit packs. The fewest sequences win, then the larger part of
    the program. All of it may be given back, so best fit alone is never better.
    """
    total = sum(n for _, n in plan)
    volume = sum(a * c * n for p, n in plan for a, c in p) + sum(a * c for a, c in left.items())
    least = -(-volume // size)
    found: list[tuple[Pattern, int]] | None = None
    orders = [
        sorted(plan, key=lambda item: -item[0][-1][0]),
        sorted(plan, key=lambda item: sum(c for _, c in item[0])),
    ]
    fewest = None
    for sixteenths in KEPT_SIXTEENTHS:
        for order in orders:
            kept, rest = keep_first(order, total * sixteenths // 16, left)
            packed = kept + best_fit(rest, size)
            count = sum(n for _, n in packed)
            if fewest is None or count < fewest:
                found, fewest = packed, count
            if fewest == least:
                return found
    return found


def plan_sequences(histogram: dict[int, int], size: int, rounds: int = 100, rate: float = 0.1, repeats: int = 3):
    """Patterns with how many sequences follow each, covering every piece exactly.

    The configuration program is solved over the histogram and rounded down, what is left is
    solved again ``repeats`` times, and :func:`round_plan` packs the pieces that no pattern
    without waste took. Work depends on ``size``, not on how many pieces there are.
    """
    plan: list[tuple[Pattern, int]] = []
    left = {n: c for n, c in histogram.items() if c > 0}
    if whole := left.pop(size, 0):
        plan.append((((size, 1),), whole))
    for _ in range(repeats):
        if not left:
            break
        lengths = np.array(sorted(left), np.int64)
        need = np.array([left[n] for n in lengths.tolist()], np.int64)
        patterns, times = fractional(lengths, need, size, rounds, rate)
        rest, taken = take_whole(patterns, times, need, lengths, size)
        if not taken:
            break
        plan += taken
        left = {int(n): int(c) for n, c in zip(lengths, rest) if c}
    return round_plan(plan, left, size)


def slots(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Per length, runs of ranks and the sequences and offsets they fill.

    Rank r of a length in a run that begins at ``first`` goes to sequence
    ``base + (r - first) // copies`` at ``offset + ((r - first) % copies) * length``.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, n in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], base, copies, offset))
            taken[length] += n * copies
            offset += length * copies
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "copies", "offset"), table.T))


def ranked_by_length(pieces: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Pieces numbered from 0 within their length.

    A length with many pieces is dealt over as many groups as it has thousands, by a hash of
    the row number, so that repeated rows spread as well; rows are numbered inside a group and
    shifted by the sizes of the groups before. ``sizes`` has one row per length, at most the
    sequence size.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("count") / RANK_GROUP))
    dealt = pieces.join(F.broadcast(sizes.select("length", parts.alias("parts"))), "length").withColumn(
        "part", F.pmod(F.xxhash64("row_number"), F.col("parts"))
    )
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "part").orderBy("row_number")
    return (
        dealt.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("parts", "part", "before")
    )


def pack(
    docs: DataFrame,
    size: int = 1024,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
) -> DataFrame:
    """Where every piece of every document goes: sequence and offset, besides the piece's own columns.

    Tokenising is narrow and written once. The histogram of lengths (``size`` rows at most)
    comes to the driver, which solves the configuration linear program by multiplicative
    weights with a knapsack as pricing, and rounds it. Pieces get their rank within their
    length in parallel, and a task looks the rank up in the plan: for each length, runs of
    ranks per pattern, a table bounded by the rounds of the solver.

    A null or empty text is the end id alone. Repeated rows are packed each. Rows that are
    alike in every column are interchangeable. An empty table gives no rows. Other columns
    are not read.
    """
    pieces = settle(tokenized_pieces(docs, size, path, key, text, end_id), "pieces")
    sizes = settle(pieces.groupBy("length").count(), "lengths")
    plan = plan_sequences({r["length"]: r["count"] for r in sizes.collect()}, size)
    table = slots(plan)
    key_type = docs.schema[key].dataType.simpleString()
    columns = [key, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table["length"] << 48 | table["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(runs, length.astype(np.int64) << 48 | rank, "right") - 1
            at = rank - table["first"][k]
            copies = table["copies"][k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [
                    pa.array(table["base"][k] + at // copies),
                    pa.array(table["offset"][k] + at % copies * length),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    ranked = ranked_by_length(pieces, sizes, key).select(*columns, F.col("rank").cast("bigint"))
    schema = f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
