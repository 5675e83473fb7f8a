"""Near-duplicate documents by Jaccard similarity of word n-grams, found with adaptive prefixes (operator 9).

Texts are sets of word shingles in one global order, the order of their 64-bit hashes. Two
sets that share enough must share a shingle among the first few of each (prefix filter), and
if both prefixes are longer by e, they must share e + 1 (multi-match). A shingle that many
documents have makes many candidates. So the cost of a document is estimated by how many such
shingles its prefix holds: they are not indexed, and what a pair has to share among the others
falls by as many. A document so full of them that nothing would be required has its prefix
lengthened to the whole set, and is joined with its like in the order of frequency there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm import bpe
from forgeline.session import new_run_folder
from forgeline.sources.tables import discard, settle, settle_at

FREQUENT = 16  # documents in which a shingle may be before it counts as frequent
EXTRA = 32  # how far every prefix is lengthened beyond the plain one
PIVOT_ROUNDS = 6  # rounds of linking to some members per bucket, at most
PIVOTS = 16  # members of a bucket that the others are compared with in a round
WORTH = 0.05  # share of a round's candidates that must have linked for another one
HEAD = 16  # tokens of a class that say in which bucket a pair is made
SKETCH = 512  # bits of a set's parity sketch
SLOTS = 1 << 18  # rows of the pre-filter that is broadcast, at most
MIX = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shingler:
    """Distinct word n-grams of texts as ascending 64-bit hashes."""

    def __init__(self, words: int) -> None:
        self.words = words

    def word_hashes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the first word of every text (n + 1 bounds)."""
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
        low = _LOWER[data]
        solid = ~_SPACE[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        spans = bpe.Spans(low, start, end)
        mixed = spans.head * MIX[0]
        for part in (spans.tail, spans.length.astype(np.uint64)):
            mixed = ((mixed ^ (mixed >> np.uint64(32))) + part) * MIX[1]
        mixed ^= mixed >> np.uint64(29)
        for k in np.flatnonzero(spans.long).tolist():  # a word's two ends are all of a shorter one
            digest = hashlib.blake2b(low[start[k] : end[k]].tobytes(), digest_size=8).digest()
            mixed[k] = int.from_bytes(digest, "little")
        return mixed, np.searchsorted(start, bounds)

    def _join(self, words: np.ndarray, count: int) -> np.ndarray:
        out = np.full(max(0, len(words) - count + 1), count, np.uint64)
        for k in range(count):
            out = (out ^ words[k : k + len(out)]) * MIX[0]
            out ^= out >> np.uint64(32)
        out *= MIX[1]
        return out ^ (out >> np.uint64(29))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The shingle set of every text; a text with fewer words is one shingle, without words none."""
        data, bounds = bpe.text_buffer(column)
        for a, b in bpe.slices(bounds):
            words, at = self.word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            joined = self._join(words, self.words)
            for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                if last - first >= self.words:
                    yield np.unique(joined[first : last - self.words + 1])
                else:
                    yield self._join(words[first:last], last - first) if last > first else words[:0]


def _share(count: Column, percent: int) -> Column:
    """Least overlap that a set of this size has with a similar one."""
    return F.ceil(count * percent / 100)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the set's shingles fall on it.

    Two sketches differ in no more bits than the sets differ in shingles, so sets whose
    sketches differ too much need no further look.
    """
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Per document: set size, digest and parity sketch of the set, and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            size, digest, first, count, sketch = [], [], [], [], []
            for s in shingler.sets(batch.column(1)):
                n = len(s)
                m = min(n, n - -(-n * percent // 100) + 1 + EXTRA) if n else 0
                size.append(n)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(s[:m])
                count.append(m)
                sketch.append(parity_sketch(s))
            flat = np.concatenate([*first, np.empty(0, np.uint64)]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            longs = SKETCH // 64
            bits = np.concatenate([*sketch, np.empty(0, np.int64)])
            ends = pa.array(np.arange(len(sketch) + 1, dtype=np.int32) * longs)
            sketches = pa.ListArray.from_arrays(ends, pa.array(bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists, sketches],
                names=[key, "n_shingles", "digest", "first", "sketch"],
            )

    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_shingles bigint, digest binary, first array<bigint>, sketch array<bigint>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the classes in ``wanted`` (cid, rep), with columns cid, rep and text.

    Before the shuffle, rows are dropped whose key falls in no slot of a wanted one. The slot
    table has ``SLOTS`` rows at most, whatever the input; the join that follows is exact.
    """
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS))
    slots = F.broadcast(wanted.select(slot.alias("slot")).distinct())
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    near = texts.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    return near.join(wanted, "rep")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int):
    """Pairs (a, b) of classes whose sets are similar; computed from the whole texts of both."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = settle(nodes.join(ends, "cid").select("cid", "rep", "digest"), "wanted")
    texts = texts_of(docs, wanted, key, text)
    side = {s: texts.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cid", "text", "digest")]) for s in "ab"}
    both = (
        pairs.join(side["a"], F.col("a") == F.col("cid_a"))
        .select("a", "b", "text_a", "digest_a")
        .join(side["b"], F.col("b") == F.col("cid_b"))
        .select("a", "b", "text_a", "text_b", "digest_a", "digest_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keep = []
            # equal keys may stand for different texts; the digest tells which one is meant
            digests = zip(batch.column("digest_a").to_pylist(), batch.column("digest_b").to_pylist())
            sets = zip(shingler.sets(batch.column("text_a")), shingler.sets(batch.column("text_b")))
            for (x, y), (dx, dy) in zip(sets, digests):
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                alike = 100 * shared >= percent * (len(x) + len(y) - shared)
                keep.append(
                    alike
                    and hashlib.blake2b(x.tobytes(), digest_size=16).digest() == dx
                    and hashlib.blake2b(y.tobytes(), digest_size=16).digest() == dy
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def spanning(links: DataFrame, turn: int) -> DataFrame:
    """Links (a, b) that connect the same classes with few of the given ones' number.

    Of the two ends of a link, one is later in this turn's order. It keeps the link to the first of
    those it is linked to, and the others of those are linked to that one instead. Members that were
    linked to the same pivots then give the same links between these, which are counted once.
    """

    def place(end: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), end).alias("h"), F.col(end).alias("cid"))

    ends = links.select(
        F.greatest(place("a"), place("b"))["cid"].alias("later"), F.least(place("a"), place("b")).alias("sooner")
    )
    first = ends.withColumn("first", F.min("sooner").over(Window.partitionBy("later"))).select(
        "later", F.col("sooner.cid").alias("sooner"), F.col("first.cid").alias("first")
    )
    kept = F.array(*[F.struct(F.least(e, "first").alias("a"), F.greatest(e, "first").alias("b")) for e in ("later", "sooner")])
    return first.select(F.inline(kept)).filter("a < b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cid, comp): the smallest node that each node of ``links`` (a, b) can reach.

    Each round a node takes the least label among its neighbours and itself, then the label of
    its label; rounds end when nothing changes. Counts and minima combine before the shuffle,
    and every round is written, so a lost executor costs one round.
    """
    edges = settle(links.union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.col("cid"), F.min("b")).alias("comp"))
    labels = settle(labels, name)
    while True:
        offered = edges.join(labels, edges["b"] == labels["cid"]).select(F.col("a").alias("cid"), "comp")
        least = labels.union(offered).groupBy("cid").agg(F.min("comp").alias("low"))
        above = labels.select(F.col("cid").alias("low"), F.col("comp").alias("up"))
        jumped = least.join(above, "low", "left").select("cid", F.least("low", F.coalesce("up", "low")).alias("comp"))
        new = settle(jumped, name)
        if new.join(labels, ["cid", "comp"], "left_anti").isEmpty():
            return new
        labels = new


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Rows (token, cid, n, pos) whose token is in two classes or more, with how many."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    return tokens.join(counts, "token")


def required(n: Column, percent: int) -> Column:
    """Shingles that the lengthened prefixes of two similar sets share, ``n`` being the larger size."""
    return F.least(F.lit(EXTRA + 1), _share(n, percent))


def light_index(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (token, cid, n, hot) of infrequent shingles, and the classes too full of frequent ones.

    ``hot`` is how many frequent shingles a class has in its prefix: of what a pair has to
    share, at most the smaller ``hot`` of both are among those. Where that is all, the class is
    heavy; a pair of which one is not heavy is found here.
    """
    hot = settle(
        shared.filter(F.col("df") > FREQUENT)
        .groupBy("cid", "n")
        .agg(F.count("*").alias("hot"))
        .withColumn("heavy", F.col("hot") >= required(F.col("n"), percent)),
        "hot",
    )
    rows = (
        shared.filter(F.col("df") <= FREQUENT)
        .join(hot.select("cid", "hot"), "cid", "left")
        .select("token", "cid", "n", F.coalesce("hot", F.lit(0)).alias("hot"))
    )
    return rows, hot.filter("heavy").select("cid")


def heavy_index(heavy: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int):
    """Index rows of the classes full of frequent shingles, among themselves.

    Here every shingle of a set is counted, so the order is infrequent ones first, then by
    hash, and the lengthened prefix in that order is indexed whole; frequent shingles come
    into it only for sets made up of little else.
    """
    wanted = settle(nodes.join(heavy, "cid").select("cid", "rep", "digest"), "heavy")
    texts = texts_of(docs, wanted, key, text).select("cid", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for cid, digest, s in zip(batch.column(0), batch.column(1).to_pylist(), shingler.sets(batch.column(2))):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(s), cid.as_py())),
                            pa.array(np.full(len(s), len(s))),
                            pa.array(s.view(np.int64)),
                        ],
                        names=["cid", "n", "token"],
                    )

    tokens = settle(texts.mapInArrow(run, "cid bigint, n bigint, token bigint").distinct(), "heavy-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = tokens.join(counts, "token", "left").select(
        "cid",
        "n",
        F.struct(
            (F.coalesce("df", F.lit(1)) > FREQUENT).alias("often"), "token", F.col("df").isNotNull().alias("twice")
        ).alias("at"),
    )
    length = F.col("n") - _share(F.col("n"), percent) + 1 + EXTRA
    first = ranked.groupBy("cid", "n").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return (
        first.select("cid", "n", F.explode(F.slice("at", F.lit(1), length.cast("int"))).alias("at"))
        .filter("at.twice")
        .select("at.token", "cid", "n", F.lit(0).cast("bigint").alias("hot"))
    )


def similar_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def enough_shared(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet in as many buckets as similar sets must, from rows (pass, a, b, need)."""
    return (
        met.groupBy("pass", "a", "b")
        .agg(F.count("*").alias("met"), F.first("need").alias("need"))
        .filter("need > 0 and met >= need")
        .select("a", "b")
        .distinct()
    )


def _need(n1: str, n2: str, hot1: str, hot2: str, percent: int) -> Column:
    return (required(F.greatest(n1, n2), percent) - F.least(hot1, hot2)).alias("need")


def near_sketches(percent: int, n1: str, n2: str, sketch1: str, sketch2: str) -> Column:
    """Whether two parity sketches differ in no more bits than similar sets of these sizes can.

    Similar sets differ in at most (1 - t) / (1 + t) of their sizes' sum, and sketches in no more.
    """
    apart = sum(
        (F.bit_count(F.get(sketch1, F.lit(k)).bitwiseXOR(F.get(sketch2, F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0)
    )
    return apart * (100 + percent) <= (F.col(n1) + F.col(n2)) * (100 - percent)


def pivot_pairs(index: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of a bucket and size band, each with those that are first in this turn's order.

    In the first turn that is one, later ``PIVOTS``, compared by sketch. A group whose members are near
    each other, but few of them near enough, is connected by some turns of these, not by all its
    pairs. Bands are moved by half their width every other turn, so a group on the edge of two is
    inside one in the next.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + turn % 2 / 2)
    order = F.struct(F.xxhash64(F.lit(turn), "cid").alias("h"), "cid")
    keys = ["pass", "token", "band"]
    banded = index.withColumns({"band": band, "order": order})
    # Without nulls both sides of the join are the same rows, which are then shuffled once.
    banded = banded.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in banded.columns])).repartition(*keys)
    columns = [c for c in ("cid", "n", "hot", "comp", "order", "sketch") if c in banded.columns]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("order"))
    first = banded.withColumn("place", place).filter(F.col("place") <= (PIVOTS if turn else 1))
    pivots = first.select(*keys, *[F.col(c).alias(f"{c}1") for c in columns])
    apart = (F.col("comp") != F.col("comp1")) & similar_size("n", "n1", percent) & (F.col("order1") < F.col("order"))
    if "sketch" in columns:
        apart &= near_sketches(percent, "n", "n1", "sketch", "sketch1")
    met = banded.join(pivots, keys).filter(apart)
    return enough_shared(
        met.select(
            "pass", F.least("cid", "cid1").alias("a"), F.greatest("cid", "cid1").alias("b"), _need("n", "n1", "hot", "hot1", percent)
        ),
        percent,
    )


def able(index: DataFrame, percent: int) -> DataFrame:
    """Rows of the classes that have as many buckets as a pair with any other must share.

    What a pair needs grows with the larger size and falls by the smaller ``hot`` of both, so a class
    with fewer buckets than its own size and ``hot`` ask for has no partner left here.
    """
    have = F.count("*").over(Window.partitionBy("pass", "cid"))
    return index.withColumn("have", have).filter(F.col("have") >= required(F.col("n"), percent) - F.col("hot")).drop("have")


def still_open(index: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Rows of the buckets whose members aren't all connected, with the component and sketch of each.

    Only of classes that are :func:`able` in these buckets. Sketches are many times as long as a row,
    so they are joined last, to rows that are dealt by class already.
    """
    labelled = index.drop("comp", "sketch").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_ones = (
        labelled.groupBy("pass", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    )
    rows = labelled.join(open_ones.select("pass", "token"), ["pass", "token"])
    return able(rows.repartition("cid"), percent).join(sketches, "cid")


def cross_pairs(index: DataFrame, percent: int) -> DataFrame:
    """All pairs within a bucket that are not connected yet and whose sketches are near enough.

    Those of a bucket's main component, the one of its least member, need no pairs among
    themselves; the others are paired with all that they are not connected with.
    A pair is made in the bucket of its least common token among the first ``HEAD`` of both, and in all
    its buckets only where these have none in common. Then the tokens of both are counted.
    """
    main = index.groupBy("pass", "token").agg(F.min(F.struct("cid", "comp"))["comp"].alias("main"))
    tokens = settle(index.groupBy("pass", "cid").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "open-tokens")
    heads = tokens.select("pass", "cid", F.slice("tokens", 1, HEAD).alias("head"))
    bucket = settle(index.join(main, ["pass", "token"]).join(heads, ["pass", "cid"]), "open-buckets")
    left = bucket.filter("comp != main").select(
        "pass", "token", *[F.col(c).alias(f"{c}1") for c in ("cid", "n", "hot", "comp", "sketch", "head")]
    )
    near = near_sketches(percent, "n", "n1", "sketch", "sketch1")
    least = F.array_min(F.array_intersect("head", "head1"))
    met = (
        bucket.join(left, ["pass", "token"])
        .filter((F.col("comp") != F.col("comp1")) & similar_size("n", "n1", percent))
        .filter((F.col("comp") == F.col("main")) | (F.col("cid") < F.col("cid1")))
        .filter(near & F.coalesce(least == F.col("token"), F.lit(True)))
        .select(
            "pass",
            F.least("cid", "cid1").alias("a"),
            F.greatest("cid", "cid1").alias("b"),
            _need("n", "n1", "hot", "hot1", percent),
        )
    )
    pairs = settle(met.filter("need > 0").distinct(), "open-pairs")
    side = {s: tokens.select("pass", F.col("cid").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab"}
    counted = pairs.join(side["a"], ["pass", "a"]).join(side["b"], ["pass", "b"])
    return counted.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("need")).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """Size of every document's shingle set, and the least key among all it is linked to, directly or not.

    Two documents link when their sets of ``words``-word shingles (A-Z lower-cased, words split
    at ASCII white space) have a Jaccard similarity of ``percent``/100 or more. Equal sets become
    one class before anything else, however many copies there are. Members of a bucket are first
    compared with a few of them, in turns with others, which connects large groups without
    pairing their members; at last pairs are made between all that is still unconnected. A
    candidate must meet in as many buckets as similar sets have to, and is verified on both whole
    texts. No connection between different texts is lost.

    A null or empty text, or one without words, has an empty set, links with nothing and is its
    own component. Rows with a null key link with nothing and have a null component. Repeated
    rows are copies like any other. An empty table gives no rows. Other columns are not read.
    """
    signed = signatures(docs, key, text, words, percent).withColumn("uid", F.monotonically_increasing_id())
    signed = settle(signed, "signatures")
    real = signed.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    classes = real.groupBy("digest").agg(
        F.min("uid").alias("cid"),
        F.min(key).alias("rep"),
        F.first("n_shingles").alias("n"),
        F.first("first").alias("first"),
    )
    tokens = classes.select("cid", "n", F.posexplode("first").alias("pos", "token"))
    spark = docs.sparkSession
    stored = new_run_folder(spark, "shared")
    shared = settle_at(shared_tokens(tokens), stored)
    nodes = settle(
        real.groupBy("digest").agg(
            F.min("uid").alias("cid"), F.min(key).alias("rep"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    light, heavy = light_index(shared, percent)
    dense = heavy_index(heavy, nodes, docs, key, text, words, percent)
    index = light.withColumn("pass", F.lit(1)).unionByName(dense.withColumn("pass", F.lit(2)))
    made = new_run_folder(spark, "index")
    index = settle_at(able(index, percent).withColumn("comp", F.col("cid")), made)
    discard(spark, stored)

    labels, tried, links, turn, last = None, None, None, 0, False
    while True:
        pairs = cross_pairs(index, percent) if last else pivot_pairs(index, turn, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        linked = settle(verify(pairs, nodes, docs, key, text, words, percent), "links")
        fewer = settle(spanning(linked, turn), "spanning")
        links = fewer if links is None else links.union(fewer)
        tried = pairs if tried is None else tried.union(pairs)
        labels = components(links)
        if last:
            break
        stored, made = made, new_run_folder(spark, "index")
        index = settle_at(still_open(index, labels, nodes.select("cid", "sketch"), percent), made)
        discard(spark, stored)
        turn += 1
        last = turn >= PIVOT_ROUNDS or turn > 1 and linked.count() <= WORTH * pairs.count()
    named = nodes.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    member = settle(named.join(least, "comp").select("digest", "component_id"), "members")
    plain = signed.select(key, "n_shingles", "digest")
    joined = plain.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull()).join(member, "digest")
    alone = plain.filter((F.col("n_shingles") == 0) | F.col(key).isNull())
    return joined.select(key, "n_shingles", "component_id").union(
        alone.select(key, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)))
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the row with the least key stays.

    Rows take part as rows: those with a null key or a repeated one join components by their text
    like all others, a null key coming after all keys. Rows that repeat key and text count once if
    the text has words. Documents without words link with nothing, so all of them stay. Only rows
    whose name falls in a slot of a removed or repeated one (``SLOTS`` slots at most are broadcast)
    are shuffled; the others pass where they are read. Columns may have any names.
    """
    said = F.coalesce(F.col(key).cast("string"), F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.length(said), F.lit(":"), said, F.coalesce(text, F.lit(""))), 256))
    row = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), name.alias("name"))
    named = docs.select(row.alias("row"), F.col(text).alias("text"))
    found = near_duplicates(named, "row", "text", words, percent).filter("n_shingles > 0")
    verdict = found.groupBy("row.name").agg(
        F.max(F.col("row") == F.col("component_id")).alias("stays"), F.count("*").alias("copies")
    )
    suspect = settle(verdict.filter("NOT stays OR copies > 1"), "near-duplicates")
    slots = F.broadcast(suspect.select(F.pmod(F.xxhash64("name"), F.lit(SLOTS)).alias("slot")).distinct())
    packed = docs.select(F.struct(*docs.columns).alias("doc"), name.alias("name"))
    slotted = packed.withColumn("slot", F.pmod(F.xxhash64("name"), F.lit(SLOTS)))
    clear = slotted.join(slots, "slot", "left_anti")
    unclear = slotted.join(slots, "slot", "left_semi").join(suspect, "name", "left")
    single = unclear.filter("stays IS NULL")
    kept = unclear.filter("stays")
    repeated = kept.groupBy("name").agg(F.first("doc").alias("doc"))
    return reduce(DataFrame.union, [part.select("doc.*") for part in (clear, single, repeated)])
