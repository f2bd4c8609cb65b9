"""Near copies by exact Jaccard similarity of word shingles: prefix filter, verification, components.

Texts whose shingle sets have similarity 0.8 share one of their first fifth of shingles in any order that all
texts follow, so no pair is missed. Shingles seen often in some texts come last in the order, which keeps
buckets small; the order never changes what is found. A bucket's members are first compared with one of
them, and so are pairs that are likely for another reason; only members whose groups are still apart after that
are compared with each other, where many of them are, by a second common shingle and within bands of length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_LOWER, BYTE_WORD, cut, drop, join_unique, release, scratch, small
from tidemark.llm.components import connected

SHINGLE_WORDS = 5
SEED = 42
#: One of so many texts says which shingles are frequent, and so many of those are moved to the order's end.
ORDER_TEXTS, ORDER_SHINGLES = 16, 100_000
#: Texts or pairs that a worker has in memory as arrays together.
TOGETHER = 64
#: Shingles in the sets that are broadcast, at most (8 bytes each).
BROADCAST_SHINGLES = 2_000_000
#: Pairs that meet one copy of a set; a set of more pairs gets more copies.
PAIRS_A_COPY = 1_000
#: Sets that aren't broadcast are parted in so many; a part meets a part at a time, and its shuffle is given up after that.
PARTS = 2
#: Bits of a filter for one digest, and places that one sets.
FILTER_BITS, FILTER_PLACES = 12, 4
#: A bucket of more members is dealt again by a second shingle; one of more than BLOCK after that is split.
MOST_IN_BUCKET, BLOCK = 256, 4_096
#: Lengths of one band are within this factor. Alike sets are within 1.25 of each other, so in one band or in neighbours.
BAND = 1.26

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends texts and sets to Python TOGETHER rows at a time: usual batches of long rows take many MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, TOGETHER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, TOGETHER) for i in range(0, b.num_rows, TOGETHER))
    pa.default_memory_pool().release_unused()


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle."""
    words = np.fromiter((_hash(m[0]) for m in BYTE_WORD.finditer(text.encode().translate(BYTE_LOWER))), np.uint64)
    size = min(size, len(words))
    if not size:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(31))) * _STEP + words[i : len(words) - size + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def alike(overlap: int, a: int, b: int) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * overlap >= 4 * (a + b)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that some texts repeat, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["h"])

    some = texts.filter(F.pmod("digest", F.lit(ORDER_TEXTS)) == 0).select("text").mapInArrow(run, "h long")
    counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _prefixes(texts: DataFrame, print_of: Callable[[np.ndarray], int]) -> DataFrame:
    """id, digest (of the text), s (of the set of shingles), n (their number), prefix, fp (print_of the set).

    prefix has one shingle more than a first common one needs: it holds a second common one of alike sets too.
    """
    frequent, times = _frequent(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            s, n, prefix, fp = [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingles(t)
                weight = np.zeros(len(own), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    weight = np.where(frequent[at] == own, times[at], 0)
                s.append(_hash(own.tobytes()))
                n.append(len(own))
                prefix.append(own[np.argsort(weight, kind="stable")[: len(own) // 5 + 2]])
                fp.append(print_of(own))
            longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s, fp))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), next(longs), pa.array(n, pa.int64()), _lists(prefix), next(longs)], names=["id", "digest", "s", "n", "prefix", "fp"])

    return texts.select("id", "digest", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, digest long, s long, n long, prefix array<long>, fp long")


def _may_be_alike(n_a: str, left_a: str, n_b: str, left_b: str):
    """For a shingle that is the first common one: left counts the shingles behind it."""
    return 9 * (1 + F.least(left_a, left_b)) >= 4 * (F.col(n_a) + F.col(n_b))


def _with_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, broadcast: bool) -> DataFrame:
    """rows, which have the sides of pairs, with the sets of one side; a set of many pairs is copied, and its pairs are dealt."""
    own = sets.select(F.col("s").alias(side), F.col("set").alias(f"set_{side}"))
    if broadcast:
        return rows.join(F.broadcast(own), side)
    degree = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("degree"))
    hot = cut(degree.filter(F.col("degree") > PAIRS_A_COPY).withColumn("copies", F.ceil(F.col("degree") / PAIRS_A_COPY)))
    copies = F.coalesce("copies", F.lit(1))
    dealt = join_unique(rows, hot, [side], "degree", pairs.count()).withColumn("copy", F.pmod(F.xxhash64("a", "b"), copies)).drop("degree", "copies")
    copied = own.join(small(hot.drop("degree")), side, "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
    return dealt.join(copied, [side, "copy"]).drop("copy")


def _places(digests: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of a filter that digests set."""
    low, high = digests & np.uint64(0xFFFFFFFF), digests >> np.uint64(32)
    return ((low + np.uint64(i) * high) * _STEP % np.uint64(bits) for i in range(FILTER_PLACES))


def _digest_filter(digests: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of a column of digests: some bits for each at the driver, whatever the texts are."""
    held = np.zeros(max(1, n * FILTER_BITS // 8), np.uint8)
    bits = 8 * len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(len(held), np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["held"])

    for row in digests.repartition(4).mapInArrow(run, "held binary").toLocalIterator():
        held |= np.frombuffer(row.held, np.uint8)
    return held


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    if pairs.isEmpty():
        return pairs
    with scratch(pairs.sparkSession) as done:
        return done.keep(_alike_pairs(pairs, nodes, texts))


def _alike_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    spark = pairs.sparkSession
    asked = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    asked = cut(nodes.select("s", "digest").join(asked, "s").select("digest"))
    held = _digest_filter(asked, asked.count())

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            wanted = np.ones(b.num_rows, bool)
            for at in _places(b.column(0).to_numpy().view(np.uint64), 8 * len(held)):
                wanted &= held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
            own = [shingles(t) for t in b.column(1).filter(pa.array(wanted)).to_pylist()]
            s = np.array([_hash(x.tobytes()) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(map(len, own), pa.int64()), _lists(own)], names=["s", "size", "set"])

    # no text is shuffled: a filter chooses them where they are read, and the few that it lets in beside are in no pair
    with _small_batches(spark):
        sets = cut(texts.select("digest", "text").mapInArrow(to_sets, "s long, size long, set array<long>"))
    twice = cut(sets.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("s"))
    if not twice.isEmpty():
        once = cut(sets.join(small(twice), "s", "left_semi").dropDuplicates(["s"]))
        sets = sets.join(small(twice), "s", "left_anti").unionByName(once)
    if (sets.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_SHINGLES:
        return _compared(pairs, sets, sets, True)
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(PARTS))
    found = []
    for i, j in product(range(PARTS), repeat=2):
        found.append(_compared(cut(pairs.filter((part("a") == i) & (part("b") == j))), sets.filter(part("s") == i), sets.filter(part("s") == j), False))
        release(spark)
    return cut(reduce(DataFrame.unionByName, found))


def _compared(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame, broadcast: bool) -> DataFrame:
    """The pairs (a, b) whose sets are alike, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = _with_sets(pairs, pairs, sets_a, "a", broadcast)
    both = _with_sets(one, pairs, sets_b, "b", broadcast).select("a", "b", "set_a", "set_b")
    with _small_batches(pairs.sparkSession):
        return cut(both.mapInArrow(run, "a long, b long"))


def _by_second(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (h, s, n, left, label) of crowded buckets, dealt again: by each shingle of the prefix behind h, and by bands of length.

    Alike sets have a second common shingle in their prefixes, behind the first. A row goes to its band and to
    the one before, so that rows of neighbouring bands meet.
    """
    behind = F.slice("prefix", (F.col("n") - F.col("left") + 1).cast("int"), F.size("prefix"))
    band = F.floor(F.log("n") / F.log(F.lit(BAND)))
    dealt = rows.join(nodes.select("s", "prefix"), "s").withColumn("second", F.explode(behind)).withColumn("band", F.explode(F.array(band, band - 1)))
    return dealt.select(F.xxhash64("h", "second", "band").alias("h"), "s", "n", "left", "label")


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (h, s, n, left, label) of buckets that hold several labels, written."""
    several = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h")
    return cut(rows.join(several, "h", "left_semi"))


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    return cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > most))


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket, of different labels, that may be alike; a large bucket's rows meet a block of it at a time."""
    large = _crowded(rows, BLOCK).withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = join_unique(rows, large, ["h"], "members", rows.count()).drop("members")
    own = dealt.withColumn("block", F.pmod(F.xxhash64("s"), blocks)).drop("blocks")
    other = dealt.select("h", *(F.col(c).alias(f"{c}_b") for c in ("s", "n", "left", "label")), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    met = own.join(other, ["h", "block"]).filter("label < label_b").filter(_may_be_alike("n", "left", "n_b", "left_b"))
    return met.select(F.least("s", "s_b").alias("a"), F.greatest("s", "s_b").alias("b")).distinct()


def _labels(nodes: DataFrame, texts: DataFrame, likely: DataFrame) -> DataFrame:
    """s, label: the groups of the sets by all alike pairs; sets that are like no other may have no row."""
    first = F.slice("prefix", F.lit(1), F.expr("int(n div 5 + 1)"))
    placed = nodes.select("s", "n", F.posexplode(first).alias("at", "h"))
    rows = placed.select("h", "s", F.shiftleft("n", 32).bitwiseOR(F.col("n") - F.col("at") - 1).alias("sizes"))  # n and left in one long
    spark = nodes.sparkSession
    counts = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    n_rows = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = join_unique(rows, counts, ["h"], "copies", n_rows, "inner")
    counted = counts._written_at
    shared = cut(shared.select("h", "s", F.shiftright("sizes", 32).alias("n"), F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)).alias("left"), "copies"))
    drop(spark, counted)
    # the member with the fewest shingles of its own is compared with the others first
    best = cut(shared.groupBy("h").agg(F.max(F.struct("left", "s", "n")).alias("best"), F.max("copies").alias("weight")))
    best = best.select("h", *(F.col(f"best.{c}").alias(f"{c}_b") for c in ("s", "n", "left")), "weight")
    star = join_unique(shared, best, ["h"], "weight", n_rows, "inner").filter("s <> s_b").filter(_may_be_alike("n", "left", "n_b", "left_b"))
    tried = cut(star.select(F.least("s", "s_b").alias("a"), F.greatest("s", "s_b").alias("b")).unionByName(likely).distinct())
    release(spark)
    links = _verified(tried, nodes, texts)
    with scratch(spark) as done:
        labels = done.keep(cut(connected(links).withColumnRenamed("node", "s")))
    known = cut(shared.drop("copies").join(small(labels), "s", "left").withColumn("label", F.coalesce("label", "s")))
    drop(spark, shared._written_at)
    apart = _apart(known)
    drop(spark, known._written_at)
    crowded = _crowded(apart, MOST_IN_BUCKET)
    if not crowded.isEmpty():
        crowded = small(crowded.select("h"))
        finer = _apart(_by_second(apart.join(crowded, "h", "left_semi"), nodes))
        apart = apart.join(crowded, "h", "left_anti").unionByName(finer)
    release(spark)
    more = _meeting(apart).join(tried, ["a", "b"], "left_anti")
    more = _verified(cut(more), nodes, texts)
    if more.isEmpty():
        return labels
    with scratch(spark) as done:
        return done.keep(cut(connected(links.unionByName(more)).withColumnRenamed("node", "s")))


def without_alike(docs: DataFrame, id_col: str, text_col: str, print_of: Callable[[np.ndarray], int], likely: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs, all columns as they are, with the smallest id of each group of texts linked by similarity 0.8 or more.

    print_of gives a set of shingles a fingerprint, and likely the pairs (a, b) of sets (s, fp) to look at first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    with _small_batches(docs.sparkSession):
        prints = cut(_prefixes(texts, print_of))
    # only sets that several rows have are put together; all others stay where they are written
    sets = prints.filter("n > 0").select("s", "digest", "n", "prefix", "fp")
    twice = cut(sets.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("s"))
    first = lambda c: F.first(c).alias(c)
    put = cut(sets.join(small(twice), "s", "left_semi").groupBy("s").agg(F.min("digest").alias("digest"), first("n"), first("prefix"), first("fp")))
    nodes = sets.join(small(twice), "s", "left_anti").unionByName(put)
    thin = prints.select("id", "digest", "s").filter("id is not null")
    with scratch(docs.sparkSession) as done:
        labels = done.keep(_labels(nodes, texts, likely(nodes)))
    grouped = cut(thin.join(small(labels), "s", "left").select("id", "digest", F.coalesce("label", "s").alias("part")))
    best = cut(grouped.groupBy("part").agg(F.min(F.struct("id", "digest")).alias("best"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    found = join_unique(grouped, best, ["part"], "members", grouped.count(), "inner")
    dropped = cut(found.filter("id <> best.id or digest <> best.digest").select(F.col("id").alias("_near_id"), F.col("digest").alias("_near_digest")).distinct())
    own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(id_col).alias("_near_id"), F.xxhash64(text).alias("_near_digest"))
    return own.join(small(dropped), ["_near_id", "_near_digest"], "left_anti").select("row.*")
