"""Prefix trie of conversations: sorted shards and the skeleton of their splitters (operator 12).

Conversations are sorted by their paths and cut into shards at splitters. A node of the trie whose
members lie in more than one shard is a prefix of a splitter. These nodes, the skeleton, are few and
known to every task beforehand; all others are finished by the one shard that has them. A shard
reports what it has of a skeleton node as partial sums, which Spark adds up.

A path is kept in pieces of ``SPAN`` turns, so a conversation of any length is rows of a fixed size.
The end of a full piece is the root of the tries of the next pieces.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.tables import settle

SPAN = 64  # turns of a piece
ID = 16  # bytes that name a turn or a node: the head of a SHA-256
ROOT = bytes(ID)
SHARD_ROWS = 20_000  # pieces of a shard, while there are fewer than MOST_SHARDS
MOST_SHARDS = 4096  # bounds the splitters, and with SPAN the skeleton
SAMPLES = 8  # sampled pieces for each splitter
BLOCK = 1 << 16  # characters of member ids in a row
NODE, PART, MEMBERS, TOP = range(4)
FIELDS = (
    "kind int, key binary, top boolean, parent_key binary, parent_top boolean, conv_id bigint, depth bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "length bigint, members string, deeper array<bigint>"
)
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256().hexdigest()


def rebuild(conversations: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, depth from 1, the turn's name and the code points of its text.

    A conversation begins with the first ``crc32(conv_id) % heads`` turns of the one whose id ends
    its ``family`` with zeros; its own turns after as many follow. Order: turn, nulls first; turns of
    one number by role and text. Null roles and texts are empty; rows without conv_id take no part.
    """
    said = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = settle(
        said.select(
            "conv_id",
            (F.row_number().over(in_order) - 1).cast("bigint").alias("place"),
            F.unhex(F.substring(name, 1, 2 * ID)).alias("name"),
            F.length("text").cast("bigint").alias("length"),
        ),
        "turns",
    )
    everyone = own.select("conv_id").distinct()
    first = own.filter((F.col("conv_id") % family == 0) & (F.col("place") < heads - 1))
    opening = first.groupBy(F.col("conv_id").alias("family")).agg(
        F.array_sort(F.collect_list(F.struct("place", "name", "length"))).alias("opening")
    )
    led = (
        everyone.withColumns(
            {
                "family": F.col("conv_id") - F.col("conv_id") % family,
                "skipped": F.crc32(F.col("conv_id").cast("string")) % heads,
            }
        )
        .join(opening, "family", "left")
        .withColumn("opening", F.coalesce(F.slice("opening", F.lit(1), F.col("skipped").cast("int")), F.array()))
    )
    head = led.select("conv_id", F.explode("opening").alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.name", "t.length"
    )
    ahead = led.select("conv_id", "skipped", F.size("opening").alias("led"))
    tail = own.join(ahead, "conv_id").filter("place >= skipped")
    tail = tail.select("conv_id", (F.col("place") - F.col("skipped") + F.col("led") + 1).alias("depth"), "name", "length")
    return head.union(tail), everyone


def node_id(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:ID]


def pieces_of(turns: DataFrame, everyone: DataFrame, span: int) -> DataFrame:
    """Paths in pieces: the node it hangs on, names and lengths of its turns, and whether it is the last.

    Tasks get conversations sorted by depth and carry the node reached from batch to batch. A path
    that fills its last piece gets an empty one, so every conversation ends in exactly one piece
    with less than ``span`` turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, hang, node, names, lengths, piece = None, ROOT, ROOT, [], [], 0

        def flush(last: bool) -> None:
            nonlocal hang, names, lengths, piece
            done.append((hang, b"".join(names), lengths, conv, piece, last))
            hang, names, lengths, piece = node, [], [], piece + 1

        for batch in batches:
            for whose, depth, name, length in zip(*(c.to_pylist() for c in batch.columns)):
                if depth == 0:
                    if conv is not None:
                        flush(True)
                    conv, hang, node, names, lengths, piece = whose, ROOT, ROOT, [], [], 0
                    continue
                node = node_id(node, name)
                names.append(name)
                lengths.append(length)
                if len(names) == span:
                    flush(False)
            yield piece_batch(done)
            done.clear()
        if conv is not None:
            flush(True)
        yield piece_batch(done)

    def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["hang", "path", "lengths", "conv_id", "piece", "last"]
        )

    no_turn = [F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("bigint")]
    # Written first: of a union whose sides are all dealt by conversation, adaptive execution may
    # leave out the exchange although it has merged partitions of one side only.
    stream = settle(turns.union(everyone.select("conv_id", *no_turn)), "stream")
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(
        run, "hang binary, path binary, lengths array<bigint>, conv_id bigint, piece bigint, last boolean"
    )


def splitters_of(pieces: DataFrame, shard_rows: int) -> list[tuple[bytes, bytes, int]]:
    """Quantiles of a sample of the sorted pieces: ``MOST_SHARDS`` at most, from ``SAMPLES`` times as many rows."""
    n = pieces.count()
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MOST_SHARDS, max(parts, -(-n // shard_rows)), max(n, 1))
    every = max(1, n // (SAMPLES * shards))
    chosen = F.pmod(F.xxhash64("conv_id", "piece"), F.lit(every)) == 0
    sample = sorted((r.hang, r.path, r.conv_id) for r in pieces.filter(chosen).select("hang", "path", "conv_id").collect())
    sample = [(bytes(h), bytes(p), c) for h, p, c in sample]
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def skeleton_of(splitters: list[tuple[bytes, bytes, int]]) -> set[tuple[bytes, bool]]:
    """Every node on the path of a splitter; the flag tells the node a piece hangs on from those in it."""
    out = set()
    for node, path, _ in splitters:
        out.add((node, True))
        for at in range(0, len(path), ID):
            node = node_id(node, path[at : at + ID])
            out.add((node, False))
    return out


class Open:
    """A node on the path that a shard is at."""

    __slots__ = (
        "key", "top", "split", "depth", "length", "conv", "n", "children", "leaves", "saved", "hash", "text", "size",
        "deeper", "ends", "waiting",
    )

    def __init__(self, key: bytes, top: bool, split: bool, depth: int, length: int) -> None:
        self.key, self.top, self.split, self.depth, self.length = key, top, split, depth, length
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.text, self.size = None, [], 0
        self.deeper, self.ends, self.waiting = None, None, []


class Shard:
    """Walks along sorted pieces with a stack of open nodes; ``rows`` takes what is finished.

    The children of an open node wait for its smallest member; those of a skeleton node leave at
    once, with its key instead. So memory holds one path and the children of its nodes that are
    this shard's alone.
    """

    def __init__(self, skeleton: set[tuple[bytes, bool]], span: int, tops_only: bool) -> None:
        self.skeleton, self.span, self.tops_only = skeleton, span, tops_only
        self.stack: list[Open] = []
        self.path = b""
        self.rows: list[tuple] = []

    def _member(self, node: Open, conv: int) -> None:
        node.text.append(str(conv))
        node.size += len(node.text[-1]) + 1
        if node.size >= BLOCK:
            self._flush(node)

    def _flush(self, node: Open) -> None:
        if not node.text:
            return
        text = ",".join(node.text)
        if node.split:
            first = int(node.text[0])
            self.rows.append((MEMBERS, node.key, node.top, None, None, first, *[None] * 7, text, None))
        elif node.hash is None:
            node.hash = hashlib.sha256(text.encode())
        else:
            node.hash.update(f",{text}".encode())
        node.text, node.size = [], 0

    def _close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        self._flush(node)
        if parent is not None:
            parent.n += node.n
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        if node.split:
            up = (parent.key, parent.top) if parent is not None else (None, None)
            counts = (node.n, node.children, node.leaves, node.saved, node.length, node.ends, node.deeper)
            self.rows.append((PART, node.key, node.top, *up, node.conv, node.depth, None, *counts))
            return
        children, leaves, saved, ends = finish(
            node.depth % self.span == 0 and not node.top, node.children, node.leaves, node.saved, node.deeper
        )
        ends = node.ends if node.deeper else node.hash.hexdigest() if node.hash else NOTHING
        saved += (node.n - 1) * node.length
        for row in node.waiting:  # their parent's smallest member is known now
            self.rows.append((*row[:7], node.conv, *row[8:]))
        row = (node.key, node.top, None, None, node.conv, node.depth, None, node.n, children, leaves, saved, None, ends, None)
        if parent is None:
            if node.depth == 0 or self.tops_only:
                self.rows.append((TOP if self.tops_only else NODE, *row))
            return
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        if self.tops_only:
            return
        if parent.split:
            self.rows.append((NODE, node.key, node.top, parent.key, parent.top, *row[4:]))
        else:
            parent.waiting.append((NODE, *row))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._close()

    def add(self, hang: bytes, path: bytes, lengths: list[int], conv: int, piece: int, last: bool, deeper, ends) -> None:
        if not self.stack or self.stack[0].key != hang:
            self.close_to(0)
            self.path = b""
            self.stack.append(Open(hang, True, (hang, True) in self.skeleton, piece * self.span, 0))
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same : same + ID] == self.path[same : same + ID]:
            same += ID
        self.close_to(1 + same // ID)
        for at in range(same, len(path), ID):
            key = node_id(self.stack[-1].key, path[at : at + ID])
            depth = self.stack[-1].depth + 1
            self.stack.append(Open(key, False, (key, False) in self.skeleton, depth, lengths[at // ID]))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        if last:
            self._member(node, conv)
        elif deeper is not None:
            node.deeper, node.ends = deeper, ends


def finish(bottom: bool, children: int, leaves: int, saved: int, deeper: list[int] | None) -> tuple:
    """Children, leaves and saved tokens below a node: of the next pieces at the bottom, else its own."""
    if bottom:
        return (*(deeper or (0, 0, 0)), None)
    return children, leaves if children else 1, saved, None


def walk(pieces: DataFrame, splitters: list, span: int, tops_only: bool) -> DataFrame:
    """What the sorted shards report (``FIELDS``), written."""
    spark = pieces.sparkSession
    known = spark.sparkContext.broadcast((splitters, skeleton_of(splitters)))
    columns = ["hang", "path", "lengths", "conv_id", "piece", "last", "deeper", "ends"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = known.value[0]
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in ("hang", "path", "conv_id")))
            yield batch.append_column("shard", pa.array([bisect_right(bounds, key) for key in keys], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(known.value[1], span, tops_only)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(*row)
                if len(shard.rows) >= 8192:
                    yield report(shard.rows)
                    shard.rows.clear()
        shard.close_to(0)
        yield report(shard.rows)

    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}
    types = [kinds.get(f.split(" ")[1], pa.list_(pa.int64())) for f in FIELDS.split(", ")]

    def report(rows: list[tuple]) -> pa.RecordBatch:
        filled = list(zip(*rows)) or [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(filled, types)], names=NAMES)

    plain = "hang binary, path binary, lengths array<bigint>, conv_id bigint, piece bigint, last boolean, deeper array<bigint>, ends string"
    placed = pieces.select(*columns).mapInArrow(place, f"{plain}, shard int")
    dealt = placed.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("hang", "path", "conv_id")
    return settle(dealt.drop("shard").mapInArrow(run, FIELDS), "shards")


def member_hashes(reports: DataFrame) -> DataFrame:
    """SHA-256 of the members that end at each skeleton node, from its blocks in ascending order.

    A SHA-256 takes its input in order, so the blocks of one node meet in one task, some
    kilobytes of ids to a row; the task keeps only the state of the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for key, top, text in zip(*(batch.column(k).to_pylist() for k in ("key", "top", "members"))):
                if (key, top) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (key, top), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield shown(done)
            done.clear()
        if node is not None:
            done.append((*node, state.hexdigest()))
        yield shown(done)

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 3
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.bool_(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "top", "sha"])

    blocks = reports.filter(F.col("kind") == MEMBERS).select("key", "top", "conv_id", "members")
    dealt = blocks.repartition("key", "top").sortWithinPartitions("key", "top", "conv_id")
    return dealt.mapInArrow(run, "key binary, top boolean, sha string")


def finish_skeleton(reports: DataFrame, span: int) -> dict[tuple[bytes, bool], dict]:
    """Skeleton nodes with all their sums: Spark adds the shards' parts, then from the deepest upwards.

    One row a node: at most ``MOST_SHARDS`` times ``SPAN`` and one.
    """
    parts = reports.filter(F.col("kind") == PART)
    summed = parts.groupBy("key", "top").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("depth", "length", "parent_key", "parent_top", "deeper", "members")],
    )
    nodes = {}
    for r in summed.join(member_hashes(reports), ["key", "top"], "left").toArrow().to_pylist():
        r["up"] = (r["parent_key"], r["parent_top"]) if r["parent_key"] is not None else None
        nodes[r["key"], r["top"]] = r
    for r in sorted(nodes.values(), key=lambda r: -(2 * r["depth"] - r["top"])):
        bottom = r["depth"] % span == 0 and not r["top"]
        below = finish(bottom, r["n_children"], r["n_leaves"], r["saved_tokens"], r["deeper"])
        r["n_children"], r["n_leaves"], r["saved_tokens"], _ = below
        r["saved_tokens"] += (r["n_convs"] - 1) * r["length"]
        r["ends_sha256"] = r["members"] if bottom and r["deeper"] else r["sha"] or NOTHING
        if r["up"] is not None:
            parent = nodes[r["up"]]
            parent["n_children"] += 1
            parent["n_leaves"] += r["n_leaves"]
            parent["saved_tokens"] += r["saved_tokens"]
    for r in nodes.values():
        r["parent_conv_id"] = nodes[r["up"]]["conv_id"] if r["up"] is not None else None
    return nodes


def deeper_sums(pieces: DataFrame, span: int, shard_rows: int) -> DataFrame:
    """Children, leaves, saved tokens and members' hash of every node where a full piece ends.

    By the conversation that is its smallest member and the piece that ends there. The tries of the
    next pieces are summed each for itself by the same walk; a trie counts for its smallest member,
    and every trie adds up what its members count for from there on. So no chain of pieces is
    followed one by one, however long a conversation is.
    """
    spark = pieces.sparkSession
    deep = pieces.filter("piece > 0").withColumns(
        {"deeper": F.lit(None).cast("array<bigint>"), "ends": F.lit(None).cast("string")}
    )
    reports = walk(deep, splitters := splitters_of(deep, shard_rows), span, True)
    own = ["conv_id", "n_children", "n_leaves", "saved_tokens"]
    tops = reports.filter(F.col("kind") == TOP).select("key", *own, F.col("members").alias("ends"))
    if splitters:
        split = [
            (r["key"], *[r[c] for c in own], r["ends_sha256"]) for r in finish_skeleton(reports, span).values() if r["top"]
        ]
        tops = tops.union(spark.createDataFrame(split, tops.schema))
    tops = settle(tops, "tops")
    weights = tops.select(F.col("key").alias("hang"), "conv_id", "n_leaves", "saved_tokens")
    onwards = Window.partitionBy("conv_id").orderBy(F.desc("piece"))
    counted = (
        deep.select("hang", "conv_id", "piece")
        .join(weights, ["hang", "conv_id"], "left")
        .select(
            "hang",
            "piece",
            *[F.sum(F.coalesce(c, F.lit(0))).over(onwards).alias(c) for c in ("n_leaves", "saved_tokens")],
        )
    )
    totals = counted.groupBy(F.col("hang").alias("key")).agg(
        F.min("piece").alias("piece"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    return tops.select("key", "conv_id", "n_children", "ends").join(totals, "key").select(
        "conv_id", (F.col("piece") - 1).alias("piece"), F.array("n_children", "n_leaves", "saved_tokens").alias("deeper"), "ends"
    )


def trie(turns: DataFrame, everyone: DataFrame, span: int = SPAN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: each distinct sequence of first turns of the conversations of ``everyone``.

    ``turns`` has conv_id, depth (from 1, without gaps), name (16 bytes) and length, none null, and
    ``everyone`` each conv_id once, those without turns included. Returns the smallest member, depth,
    the parent's smallest member, members, children, leaves below, the tokens a shared prefix saves,
    and the SHA-256 of the ids of members that end there. Copies of one conversation and shared
    openings may be any share of the rows: shards are cut by path and id. An empty table gives none.
    """
    pieces = settle(pieces_of(turns, everyone, span), "pieces")
    spark = pieces.sparkSession
    none = {"deeper": F.lit(None).cast("array<bigint>"), "ends": F.lit(None).cast("string")}
    if pieces.filter("piece > 0").isEmpty():
        whole = pieces.withColumns(none)
    else:
        whole = pieces.join(deeper_sums(pieces, span, shard_rows), ["conv_id", "piece"], "left")
    splitters = splitters_of(pieces, shard_rows)
    reports = walk(whole, splitters, span, False)
    local = reports.filter(F.col("kind") == NODE)
    if not splitters:
        return local.withColumnRenamed("members", "ends_sha256").select(*RESULT)
    skeleton = finish_skeleton(reports, span)
    convs = [(key, top, r["conv_id"]) for (key, top), r in skeleton.items()]
    parents = spark.createDataFrame(convs, "parent_key binary, parent_top boolean, up bigint")
    resolved = local.join(F.broadcast(parents), ["parent_key", "parent_top"], "left").select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "up").alias("parent_conv_id"),
        *RESULT[3:7],
        F.col("members").alias("ends_sha256"),
    )
    shared = [tuple(r[c] for c in RESULT) for r in skeleton.values() if not r["top"] or r["depth"] == 0]
    return resolved.union(spark.createDataFrame(shared, resolved.schema))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations (:func:`rebuild`, :func:`trie`); other columns are not read."""
    return trie(*rebuild(conversations))
