"""Document quality learned from preference pairs by a Bradley-Terry model (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm import bpe

MOST_LABELS = 20_000  # labelled documents that fitting looks at, one row of each, at most
PAIRS = 100_000  # preference pairs drawn from them
STEPS = 400
RATE = 0.5
DECAY = 1e-4
SEED = 7

_CLASS = np.zeros(256, np.int64)  # of bytes, for shares
for _k, _members in enumerate(
    (
        b"abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" ",
        b"\t\n\x0b\x0c\r",
        b".",
        b",;:",
        b"!",
        b"?",
        b"'\"()-",
        b"#*$%&",
        b"|",
        b"<>",
        b"{}[]=_/\\^~@`+",
    ),
    start=1,
):
    _CLASS[np.frombuffer(_members, np.uint8)] = _k
_CLASS[128:] = 15
CLASSES = 16
MEASURES = 8
FEATURES = 2 * (CLASSES + MEASURES)


def features(column: pa.Array) -> np.ndarray:
    """One row per text: shares of kinds of characters, and measures of words and lines.

    Shares are given plain and as square roots, so that rare characters count. Only the text
    is looked at. An empty text has zeros everywhere.
    """
    data, bounds = bpe.text_buffer(column)
    out = np.zeros((len(column), FEATURES), np.float64)
    hashes = bpe.RollingHash()
    for a, b in bpe.slices(bounds):
        part, cut = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        if not len(part):
            continue
        size = np.diff(cut)
        doc = np.repeat(np.arange(b - a), size)
        kinds = np.bincount(doc * CLASSES + _CLASS[part], minlength=(b - a) * CLASSES).reshape(b - a, CLASSES)
        shares = kinds / np.maximum(size, 1)[:, None]
        solid = (_CLASS[part] != 4) & (_CLASS[part] != 5)
        edge = np.zeros(len(part) + 1, bool)
        edge[cut] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        owner = doc[start]
        words = np.bincount(owner, minlength=b - a)
        many = np.maximum(words, 1)
        key = hashes.of(hashes.sums(part), start, end)
        same = np.zeros(len(start), bool)
        same[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
        # distinct words per text, and words that occur twice or more within 64 words
        order = np.lexsort((np.arange(len(key)), key, owner))
        k, o = key[order], owner[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
        close = twin.copy()
        close[1:] &= np.diff(order) <= 64
        last = part[end - 1]
        marked = (_CLASS[last] == 8) | (_CLASS[last] == 11) | (_CLASS[last] == 12)
        upper = (_CLASS[part[start]] == 2) & (end - start > 1) & (_CLASS[part[np.minimum(start + 1, len(part) - 1)]] == 2)
        length = np.bincount(owner, weights=np.minimum(end - start, 40), minlength=b - a) / many
        lines = np.bincount(doc[part == 10], minlength=b - a)
        measures = [
            np.bincount(owner[same], minlength=b - a) / many,
            np.bincount(o[twin], minlength=b - a) / many / np.log(many + np.e),
            np.bincount(o[close], minlength=b - a) / many,
            np.bincount(owner[marked], minlength=b - a) / many,
            np.bincount(owner[upper], minlength=b - a) / many,
            length / 10,
            lines / many,
            np.abs(length - 5) / 10,
        ]
        rows = np.column_stack([shares, *measures])
        out[a:b] = np.column_stack([rows, np.sqrt(rows)])
        out[a:b][size == 0] = 0
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the score that parts good from bad."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -50, 50)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> Ranking:
    """Bradley-Terry by logistic loss on feature differences of (better, worse) pairs.

    Pairs put a document of label 1 before one of label 0. The threshold is the quantile of
    the strengths at the share of label 0, so as many training documents fall below it.
    Without documents of both labels every score is one half.
    """
    n = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(n)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(n)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Ranking(mean, scale, np.zeros(n), 0.0)
    draw = np.random.default_rng(SEED)
    z = np.clip((x - mean) / scale, -8, 8)
    i, j = draw.choice(better, pairs), draw.choice(worse, pairs)
    weights, speed = np.zeros(n), np.zeros(n)
    for _ in range(STEPS):
        batch = draw.integers(0, pairs, 4096)
        apart = z[i[batch]] - z[j[batch]]
        chance = 1 / (1 + np.exp(np.clip(apart @ weights, -50, 50)))
        slope = -(apart * chance[:, None]).mean(0) + DECAY * weights
        speed = 0.9 * speed + slope
        weights = weights - RATE / 10 * speed
    strength = z @ weights
    share = len(worse) / (len(worse) + len(better))
    threshold = float(np.quantile(strength, share))
    # the cut lies between the two documents at the quantile, where they are far apart
    low, high = strength[strength < threshold], strength[strength >= threshold]
    if len(low) and len(high):
        threshold = float((low.max() + high.min()) / 2)
    return Ranking(mean, scale, weights, threshold)


def held_out(key: str) -> Column:
    """Documents that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    """Fit on labelled documents that aren't held out, ``MOST_LABELS`` at most, taken by a hash of the key.

    Of a repeated key one row counts, the least by a hash of its features.
    """
    key_type = docs.schema[key].dataType.simpleString()

    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    taken = (
        known.groupBy(key)
        .agg(F.max(label).cast("int").alias("good"))
        .orderBy(F.xxhash64(key), key)
        .limit(MOST_LABELS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            least: dict = {}  # a key's copies shrink to one per batch before they are shuffled
            for at, (k, row) in enumerate(zip(batch.column(0).to_pylist(), x)):
                mark = int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), "little", signed=True)
                if k not in least or mark < least[k][0]:
                    least[k] = mark, at
            kept = pa.array([at for _, at in least.values()], pa.int64())
            marks = pa.array([mark for mark, _ in least.values()], pa.int64())
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), marks, rows.take(kept), batch.column(2).take(kept)],
                names=[key, "mark", "x", "good"],
            )

    # the sample is bounded, so it may go to every task; texts stay where they are read
    sample = docs.select(key, text).join(F.broadcast(taken), key).select(key, text, "good")
    measured = sample.mapInArrow(run, f"`{key}` {key_type}, mark bigint, x array<double>, good int")
    table = measured.groupBy(key).agg(F.min(F.struct("mark", "x", "good")).alias("one")).select("one.x", "one.good").toArrow()
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    good = table.column("good").to_numpy()
    order = np.lexsort((*x.T[::-1], good))  # the same fit whatever order the rows come in
    return fit_pairs(x[order], good[order])


def score(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` and ``predicted`` of every document; one narrow pass."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ranking.score(features(batch.column(1))))], names=[key, "score"]
            )

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every document, learned from the labels of those that aren't held out.

    Scores come from texts alone. The fit reads a bounded sample of labelled documents
    (``MOST_LABELS``) and learns a weight per feature from pairs of a good and a bad one;
    the quantile of the scores at the share of bad labels becomes 0.5.

    A null or empty text has zero features and a score like others. A null key isn't held
    out. Labels other than 0 and 1 are ignored, of repeated labels the larger counts, repeated
    documents are learned from once and scored each. Without labels of both kinds all scores are 0.5. An empty table
    gives no rows. Other columns are not read.
    """
    scored = score(docs, fit(docs, labels, key, text), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The documents predicted good, with all their columns; only texts go to Python."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(ranking.score(features(texts)))

    return docs.filter(scored(F.col(text)) >= 0.5)
