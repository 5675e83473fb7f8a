"""Token shards in training order: a keyed permutation gives every sequence a global slot (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.llm import bpe
from forgeline.llm.token_counts import VOCABULARY, count_tokens
from forgeline.session import new_run_folder

SEQUENCE = 512  # tokens of a sequence
SHARD = 8192  # sequences of a shard
READ_RECORDS = 512  # of a shard looked at at once
ROUNDS = 4
END = b"\n"  # closes every record
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("length", "<u4")])


def stride(size: int, width: int) -> int:
    """Bytes of every record: head, ``size`` ids of ``width`` bytes, end."""
    return HEAD.itemsize + size * width + len(END)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Slots of indices under a keyed permutation of 0 .. total - 1.

    A balanced Feistel network permutes the least even number of bits that holds ``total``;
    what falls outside walks on along its cycle until it is inside, which keeps the map
    one to one.
    """
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (_mix(right, seed * 0x9E3779B97F4A7C15 + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


def sequence_counts(docs: DataFrame, path: str, key: str, text: str, size: int) -> dict[int, tuple[int, int]]:
    """Per task of the scan: the first sequence number, and how many it makes."""
    counted = count_tokens(docs, path, key, text)
    pieces = F.greatest(F.lit(1), F.ceil((F.col("n_tokens") + 1) / size))
    per_task = counted.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(pieces).alias("n"))
    out, first = {}, 0
    for row in per_task.orderBy("task").collect():  # a row per task
        out[row["task"]] = (first, row["n"])
        first += row["n"]
    return out


def write_shards(
    docs: DataFrame,
    folder: str,
    seed: int,
    size: int = SEQUENCE,
    shard: int = SHARD,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = None,
) -> int:
    """Write every document's ids, cut to sequences, in the order of the permutation; returns how many.

    Slot s is record s % ``shard`` of shard s // ``shard``, at byte (s % shard) * stride: a reader that
    stopped goes on from any slot by arithmetic. Tasks of the scan first only count their
    sequences, which numbers all of them without gaps; a second scan encodes them, sends each
    to its shard, and a shard is one sorted, fixed-stride file. Ids below 65,536 take two bytes,
    others four. The table has to be a stored one, so that both scans see the same tasks; a
    task that counts otherwise the second time fails.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ranges = sequence_counts(docs, path, key, text, size)
    total = sum(n for _, n in ranges.values())
    largest = len(bpe.tokenizer(path).piece_length) - 1
    width = 2 if largest < 1 << 16 else 4
    last = largest if end_id is None else end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        at, most = ranges.get(TaskContext.get().partitionId(), (0, 0))
        most += at
        for batch in batches:
            # a null key is stored as the least number
            keys = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            for row, ids, count in bpe.encode_texts(tokenizer, batch.column(1)):
                flat = np.insert(ids, np.cumsum(count), last)
                ends = np.cumsum(count + 1)
                pieces = -(-(count + 1) // size)
                doc = np.repeat(np.arange(len(count)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = (ends - count - 1)[doc] + number * size
                length = np.minimum(ends[doc] - start, size)
                if at + len(doc) > most:
                    raise ValueError("the table has changed between the two scans")
                slots = permute(np.arange(at, at + len(doc)), total, seed)
                at += len(doc)
                raw = flat.astype(f"<u{width}").tobytes()
                head = np.empty(len(doc), HEAD)
                head["doc_id"], head["piece"], head["length"] = keys[row + doc], number, length
                heads = head.tobytes()
                records = [
                    heads[k * HEAD.itemsize : (k + 1) * HEAD.itemsize] + raw[a * width : (a + n) * width]
                    for k, (a, n) in enumerate(zip(start.tolist(), length.tolist()))
                ]
                for a in range(0, len(records), 4096):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[a : a + 4096]), pa.array(records[a : a + 4096], pa.binary())],
                        names=["slot", "record"],
                    )

    sequences = docs.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, "slot bigint, record binary")
    shards = max(1, -(-total // shard))
    room = stride(size, width) - len(END)
    # padded after the shuffle; the text writer writes the bytes of a string as they are
    padded = F.rpad("record", F.lit(room), F.lit(b"\x00")).cast("string")
    (
        sequences.withColumn("shard", F.format_string("%012d", F.floor(F.col("slot") / shard)))
        .repartition(min(shards, 100_000), "shard")
        .sortWithinPartitions("shard", "slot")
        .select(padded.alias("value"), "shard")
        .write.option("lineSep", END.decode())
        .partitionBy("shard")
        .text(folder)
    )
    return total


def _records(
    spark: SparkSession, folder: str, size: int, shard: int, width: int, first_slot: int, last: Callable, last_type: str
) -> DataFrame:
    """One row per record from ``first_slot`` on; ``last`` makes the last column of some records, their ids in one array."""
    step = stride(size, width)
    kind = np.dtype([("head", HEAD), ("ids", f"<u{width}", (size,)), ("end", "S1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                if raw.size % step:
                    raise ValueError(f"shard {number} is not made of records of {step} bytes")
                shard_rows = np.frombuffer(raw, kind)
                for at in range(max(0, first_slot - number * shard), len(shard_rows), READ_RECORDS):
                    rows = shard_rows[at : at + READ_RECORDS]
                    place = at + np.arange(len(rows))
                    head, length = rows["head"], rows["head"]["length"].astype(np.int64)
                    ids = np.concatenate([r[:n] for r, n in zip(rows["ids"], length.tolist())])
                    keys = head["doc_id"].copy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(number * shard + place),
                            pa.array(np.full(len(rows), number, np.int64)),
                            pa.array(place * step),
                            pa.array(keys, mask=keys == -(1 << 63)),
                            pa.array(head["piece"].astype(np.int64)),
                            pa.array(length),
                            last(ids, length),
                        ],
                        names=["slot", "shard", "byte_offset", "doc_id", "piece", "length", last_type.split(" ")[0]],
                    )

    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint"))
        .filter((F.col("shard") >= first_slot // shard) & (F.col("length") > 0))
    )
    schema = "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece bigint, length bigint"
    return files.select("shard", "content").mapInArrow(run, f"{schema}, {last_type}")


def read_shards(
    spark: SparkSession, folder: str, size: int = SEQUENCE, shard: int = SHARD, width: int = 2, first_slot: int = 0
) -> DataFrame:
    """Sequences from ``first_slot`` on: slot, shard, byte offset, document, piece, length and ids.

    Earlier shards aren't opened; within its shard the first record is found by its stride.
    """

    def lists(ids: np.ndarray, length: np.ndarray) -> pa.Array:
        bounds = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
        return pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))

    return _records(spark, folder, size, shard, width, first_slot, lists, "ids array<int>")


def shard_digests(
    spark: SparkSession, folder: str, size: int = SEQUENCE, shard: int = SHARD, width: int = 2, first_slot: int = 0
) -> DataFrame:
    """As :func:`read_shards`, with the CRC-32 of the ids as little-endian unsigned 32-bit numbers in their place."""

    def sums(ids: np.ndarray, length: np.ndarray) -> pa.Array:
        flat = memoryview(ids.astype("<u4")).cast("B")
        ends = np.cumsum(length)
        return pa.array([zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())], pa.int64())

    return _records(spark, folder, size, shard, width, first_slot, sums, "ids_crc32 bigint")


def materialise(docs: DataFrame, seed: int = 20_240_601, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Write the shards and list what they hold, read back: one row per sequence, with a digest of its ids.

    A document is its ids and an end id, cut to ``size`` tokens, the last piece shorter. A null or empty
    text is the end id alone. Null keys come back as null. Repeated rows are stored each. An
    empty table gives no shards and no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_run_folder(spark, "shards")
    if not write_shards(docs, folder, seed, size, shard):
        schema = "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece bigint, length bigint"
        return spark.createDataFrame([], f"{schema}, ids_crc32 bigint")
    return shard_digests(spark, folder, size, shard)
