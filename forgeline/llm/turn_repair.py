"""Faults of conversations and their cheapest repair (operator 13).

Both directions of the dynamic program are streams over rows that Spark has dealt by conversation
and sorted by turn. Tasks carry a few numbers from one Arrow batch to the next; what the walk back
needs, a byte a row, leaves the first stream as rows of some kilobytes and meets the turns again in
the second. So a conversation of any length takes a fixed amount of a worker's memory, and a lost
executor costs a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.tables import settle

BLOCK = 4096  # turns whose back pointers go into one row
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# Places of the pattern (s?(ua)+)?: before anything, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
# Where an initial leads to; None where the pattern does not allow it.
KEEPS = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
# Where an inserted or renamed turn leads to: the only role of the two that may follow.
GOES = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, RENAME = range(4)  # in the order of their letters
LETTERS = b"DIKR"
AT_END = (0, 4, 2, 0)  # cost to go behind the last turn


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32('conv_id:turn') % 20``, a null of any column taken as one blank.

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    its role user. ``conv_id`` and ``turn`` keep their nulls.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns numbered from 0 in their conversation, with the first fault of each and its initial.

    Order: turn, nulls first; rows of one turn by role and text. Of equal rows the first is no
    duplicate. ``fault`` is blank, duplicate, truncated or null.
    """
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = turns.select(
        "conv_id", "turn", "role", "text", (F.row_number().over(in_order) - 1).cast("bigint").alias("place")
    )
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    fault = (
        F.when(~F.col("text").rlike(SOLID), "blank")
        .when(F.row_number().over(alike) > 1, "duplicate")
        .when(~F.col("text").rlike(ENDED), "truncated")
    )
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return numbered.withColumns({"fault": fault, "initial": number.cast("int")})


def back_step(ahead: tuple, fault: str | None, initial: int) -> tuple[tuple, int]:
    """Cost to go at a turn for each place of the pattern, and the least letter that achieves each."""
    extra = fault == "truncated"
    best = [[3 + cost, None, None, None] for cost in ahead]
    for place in range(4):
        if fault not in ("blank", "duplicate"):
            kept = KEEPS[place][initial] if initial < 3 else None
            if kept is not None:
                best[place][KEEP] = extra + ahead[kept]
            best[place][RENAME] = 2 + extra + ahead[GOES[place]]
    least = [min(c for c in costs if c is not None) for costs in best]
    for _ in range(3):  # an insertion leads to another place before the same turn
        for place in range(4):
            best[place][INSERT] = 2 + least[GOES[place]]
            least[place] = min(least[place], best[place][INSERT])
    letters = sum(best[place].index(least[place]) << 2 * place for place in range(4))
    return tuple(least), letters


def back_pointers(faults: DataFrame) -> DataFrame:
    """Letters of the cheapest edits for all places of the pattern, ``BLOCK`` turns to a row.

    Rows come dealt by conversation and sorted from the last turn to the first. Costs are carried
    as differences to the least one, of which there are few, so a step is a look-up.
    """
    kind = faults.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict[tuple, tuple[tuple, int]] = {}
        whose, ahead, held, low, began = None, AT_END, bytearray(), 0, False
        done: list[tuple] = []

        def flush() -> None:
            if held:
                done.append((whose, low, bytes(reversed(held))))
                held.clear()

        for batch in batches:
            for conv, place, fault, initial in zip(*(c.to_pylist() for c in batch.columns)):
                if not began or conv != whose:
                    flush()
                    whose, ahead, began = conv, AT_END, True
                step = steps.get((ahead, fault, initial))
                if step is None:
                    costs, letters = back_step(ahead, fault, initial)
                    step = steps[ahead, fault, initial] = tuple(c - min(costs) for c in costs), letters
                ahead = step[0]
                held.append(step[1])
                low = place
                if len(held) == BLOCK:
                    flush()
            yield block_batch(done)
            done = []
        flush()
        yield block_batch(done)

    conv = pa.int64() if kind == "bigint" else None

    def block_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        arrays = [pa.array(columns[0], conv), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "letters"])

    dealt = faults.select("conv_id", "place", "fault", "initial").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(
        run, f"conv_id {kind}, place bigint, letters binary"
    )


class Repair:
    """Walk along one conversation: edits, counts and the digest, all in a fixed amount of memory but the audit."""

    def __init__(self) -> None:
        self.place, self.cost, self.audit = START, 0, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.last, self.before = 0, None, None, None
        self.hash, self.empty = hashlib.sha256(), True
        self.letters, self.base = b"", 0

    def _line(self, letter: int, role: str, text: str) -> tuple[str, str, str]:
        self.audit.append(LETTERS[letter])
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        return chr(LETTERS[letter]), role, text

    def _insert(self) -> tuple[str, str, str]:
        self.place = GOES[self.place]
        self.cost += 2
        return self._line(INSERT, ROLES[self.place], "")

    def turn(self, place: int, turn: int | None, role: str, text: str, fault: str | None, initial: int) -> Iterator:
        """Repaired turns that this one gives: (edit, role, text)."""
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault is not None:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.before is not None and (self.before, initial) not in ((0, 1), (1, 2), (2, 1))
        self.before = initial
        letters = self.letters[place - self.base]
        while (letter := letters >> 2 * self.place & 3) == INSERT:
            yield self._insert()
        if letter == DELETE:
            self.audit.append(LETTERS[DELETE])
            self.cost += 3
            return
        self.cost += fault == "truncated"
        if letter == KEEP:
            self.place = KEEPS[self.place][initial]
        else:
            self.place = GOES[self.place]
            self.cost += 2
            role = ROLES[self.place]
        yield self._line(letter, role, text)

    def end(self) -> Iterator:
        while AT_END[self.place]:
            yield self._insert()

    def report(self, conv) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return conv, *counts, self.audit.decode(), self.hash.hexdigest()


REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def _walk(turns: DataFrame, everyone: DataFrame, report: bool) -> DataFrame:
    faults = settle(with_faults(turns), "turns")
    kind = turns.schema["conv_id"].dataType.simpleString()
    blocks = back_pointers(faults)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))]
    no_fault = [F.lit(None).cast("string").alias("fault"), F.lit(None).cast("int").alias("initial")]
    no_letters = F.lit(None).cast("binary").alias("letters")
    heads = everyone.select("conv_id").distinct()
    stream = (
        heads.select("conv_id", F.lit(-1).cast("bigint").alias("place"), F.lit(0).alias("part"), *none, *no_fault, no_letters)
        .union(blocks.select("conv_id", "place", F.lit(1), *none, *no_fault, "letters"))
        .union(
            faults.select(
                "conv_id", "place", F.lit(2), F.col("turn").cast("bigint"), "role", "text", "fault", "initial", no_letters
            )
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, walk = None, None
        done: list[tuple] = []
        at, size = 0, 0

        def add(edits: Iterator) -> None:
            nonlocal at, size
            for edit, role, text in edits:
                if not report:
                    done.append((whose, at, edit, role, text))
                    size += len(text)
                at += 1

        def close() -> None:
            if walk is not None:
                add(walk.end())
                if report:
                    done.append(walk.report(whose))

        for batch in batches:
            for conv, place, part, turn, role, text, fault, initial, letters in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                if part == 0:
                    close()
                    whose, walk, at = conv, Repair(), 0
                elif part == 1:
                    walk.letters, walk.base = letters, place
                else:
                    add(walk.turn(place, turn, role, text, fault, initial))
                if size > 8 << 20:
                    yield as_batch(done)
                    done.clear()
                    size = 0
            yield as_batch(done)
            done.clear()
        close()
        yield as_batch(done)

    names = ["conv_id", *(REPORT if report else "place bigint, edit string, role string, text string").split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[] for _ in names]
        arrays = [pa.array(columns[0], types.get(kind))]
        arrays += [pa.array(c, types[n.split(" ")[1]]) for c, n in zip(columns[1:], names[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=[n.split(" ")[0] for n in names])

    out = ", ".join([f"conv_id {kind}", *names[1:]])
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").mapInArrow(run, out)


def assess(turns: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation of ``everyone``.

    ``turns`` has conv_id, turn, role and text, the last two without nulls; ``everyone`` (default:
    the conversations of ``turns``) names those to report, with zeros, an empty audit and the hash
    of nothing where no turn is left. A null conv_id is a conversation of its own, a null turn comes
    first and counts for no gap, repeated rows are duplicates, an empty table gives none. A role
    that begins with none of s, u and a can only be renamed or deleted. Other columns are not read.
    """
    return _walk(turns, turns if everyone is None else everyone, True)


def repair(turns: DataFrame) -> DataFrame:
    """Repaired turns: conv_id, place (from 0), edit (I, K or R), role, text; nulls as :func:`assess` takes them."""
    return _walk(turns, turns, False)
