"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree on two of five blocks of bits. For each pair of blocks
the distinct fingerprints are dealt by those bits; a bucket's fingerprints are sorted by Gray rank and put
under a hierarchy whose nodes factor out the bits that all fingerprints below share. A search adds up the
differences on the factored bits on its way down and leaves out whole groups beyond three. Fingerprints
that a search reaches leave the index, so a bucket yields a spanning forest and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.common import BYTE_LOWER, BYTE_WORD, cut, join_unique, small
from tidemark.llm.components import connected

SEED = 42
#: Fingerprints of a bucket above which the bucket is dealt again by further bits.
MOST_IN_BUCKET = 20_000
FAN_OUT = 16
ALL_BITS = (1 << 64) - 1

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 where there is none."""
    hashes = hashes.astype(np.dtype(">u8"))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):  # a bounded part of a long text's bits at once
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The fingerprint of the hashes of a text's word shingles; 0 where there is no word."""
    words = BYTE_WORD.findall(text.encode().translate(BYTE_LOWER))
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    return fingerprint_of(np.fromiter(map(_hash, shingles), np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """id, fp (the fingerprint's bits as a long). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t or "", shingle_words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Levels of nodes over Gray-sorted fingerprints, from the root's children down to the fingerprints.

    Each level has, for each node, the bits that it adds to those shared by its parent (mask) and their
    pattern, and how many fingerprints below it are still in the index.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        n = len(fps)
        full = np.uint64(ALL_BITS)
        shared, pattern, alive = [np.full(n, full)], [self.fps], [np.ones(n, np.int64)]
        while len(shared[-1]) > FAN_OUT:
            starts = np.arange(0, len(shared[-1]), FAN_OUT)
            first = np.repeat(pattern[-1][starts], np.diff(np.r_[starts, len(pattern[-1])]))
            same = np.bitwise_and.reduceat(shared[-1] & ~(pattern[-1] ^ first), starts)
            shared.append(same)
            pattern.append(pattern[-1][starts] & same)
            alive.append(np.add.reduceat(alive[-1], starts))
        self.pattern, self.alive = pattern[::-1], alive[::-1]
        self.mask = [shared[-1]]
        for parent, child in zip(shared[:0:-1], shared[-2::-1], strict=True):
            self.mask.append(child & ~np.repeat(parent, FAN_OUT)[: len(child)])

    def remove(self, which: np.ndarray) -> None:
        for level in range(len(self.alive) - 1, -1, -1):
            np.subtract.at(self.alive[level], which, 1)
            which = which // FAN_OUT

    def near(self, queries: np.ndarray, most: int) -> np.ndarray:
        """Places of the fingerprints still in the index within most bits of a query."""
        found = []
        for q in np.array_split(queries, -(-len(queries) // 64)):
            rows = np.repeat(np.arange(len(q)), len(self.mask[0]))
            nodes = np.tile(np.arange(len(self.mask[0])), len(q))
            differ = np.zeros(len(rows), np.int64)
            for level, (mask, pattern, alive) in enumerate(zip(self.mask, self.pattern, self.alive, strict=True)):
                differ = differ + np.bitwise_count((q[rows] ^ pattern[nodes]) & mask[nodes])
                keep = (differ <= most) & (alive[nodes] > 0)
                rows, nodes, differ = rows[keep], nodes[keep], differ[keep]
                if level + 1 < len(self.mask):
                    below = len(self.mask[level + 1])
                    nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    rows, differ = np.repeat(rows, FAN_OUT), np.repeat(differ, FAN_OUT)
                    real = nodes < below
                    rows, nodes, differ = rows[real], nodes[real], differ[real]
            found.append(nodes)
        return np.unique(np.concatenate(found))

    def forest(self, most: int) -> list[tuple[int, int]]:
        """(place of a member, place of its group's seed), for members that are no seed."""
        links = []
        for seed in range(len(self.fps)):
            if not self.alive[-1][seed]:
                continue
            front = np.array([seed])
            self.remove(front)
            while len(front := self.near(self.fps[front], most)):
                self.remove(front)
                links += [(int(k), seed) for k in front]
        return links


def bucket_links(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of linked fingerprints that span the groups of one bucket."""
    index = GrayIndex(fps)
    if links := index.forest(most):
        a, b = np.array(links).T
        yield index.fps[a], index.fps[b]


def link_buckets(most: int):
    """Over rows (mask, bucket, fp) sorted by mask and bucket; a bucket may go on in the next batch."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        key = None
        for b in batches:
            mask, bucket, fp = (b.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(bucket) != 0)) + 1
            for part, at in zip(np.split(fp, new), np.r_[0, new], strict=True):
                if not len(part):
                    continue
                if (mask[at], bucket[at]) != key:
                    if sum(map(len, held)) > 1:
                        yield np.concatenate(held)
                    held, key = [], (mask[at], bucket[at])
                held.append(part)
        if sum(map(len, held)) > 1:
            yield np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in buckets(batches):
            for a, b in bucket_links(fps.view(np.uint64), most):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of each choice of agree out of so many blocks of the given bits."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    return [sum(choice) for choice in combinations(parts, agree)]


def fingerprint_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that join the same fingerprints into groups as all pairs within most bits do.

    fps has distinct values fp. Of most + 2 blocks any two fingerprints that link agree on two. A bucket of
    over MOST_IN_BUCKET is dealt again by most + 1 blocks of its other bits, of which they agree on one.
    """
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(list(range(64)), most + 2, 2)))
    rows = fps.select("fp", F.explode(masks).alias("mask"))
    links = None
    for _ in range(3):
        rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        large = cut(sizes.filter(F.col("size") > MOST_IN_BUCKET).select("mask", "bucket"))
        n_large = large.count()
        fit = rows if not n_large else rows.join(small(large), ["mask", "bucket"], "left_anti")
        dealt = fit.select("mask", "bucket", "fp").repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
        found = dealt.mapInArrow(link_buckets(most), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not n_large:
            return links
        finer = large.select("mask").distinct().collect()  # at most a mask for each choice of blocks
        again = {r.mask: [signed((r.mask & ALL_BITS) | m) for m in block_masks([b for b in range(64) if not (r.mask >> b) & 1], most + 1, 1)] for r in finer}
        deal = F.create_map(*(x for k, v in again.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        rows = rows.join(small(large), ["mask", "bucket"], "left_semi").select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
    # whatever is still crowded differs in few bits only: searched as it is
    rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
    dealt = rows.select("mask", "bucket", "fp").repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
    return links.unionByName(dealt.mapInArrow(link_buckets(most), "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, most: int = 3) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most most differing bits. A null text is
    empty; all texts without a word share fingerprint zero. A null id gets the component of its
    fingerprint, and is never a component's name unless the component has no other id. Rows that repeat an
    id get a row each, by their own text. An empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words))
    # copies meet here, counted before the shuffle
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    links = cut(fingerprint_links(distinct.select("fp"), most).distinct())
    labels = connected(links)
    grouped = distinct.join(labels.withColumnsRenamed({"node": "fp"}), "fp", "left")
    named = cut(grouped.withColumn("part", F.coalesce("label", "fp")))
    best = named.groupBy("part").agg(F.min("first").alias("component"))
    by_print = cut(named.join(best, "part").filter("copies > 1 or component <> first").select("fp", "component", "copies"))
    out = join_unique(prints, by_print, ["fp"], "copies", prints.count())
    return out.select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """docs, all columns as they are, with the smallest id of each group of texts linked by similarity 0.8 or more.

    Similarity is Jaccard's, of sets of shingles of five words, letters A-Z lower-cased. The Gray-order index
    links fingerprints of these sets within most bits, and sets with one fingerprint; each such link is
    verified. Sets of similarity 0.8 mostly differ in more bits than an index can search, so a prefix filter
    finds every other pair, and leaves out those that are linked already.

    A null text is empty; texts without a word are alike. What goes is told by id and text, so that a
    repeated id takes no other text with it. Rows without an id stay, and so do all rows with the id and text
    that stay. An empty table stays empty; columns may have any names.
    """

    def seed_links(nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets whose fingerprints are near, spanning their groups; nodes has s and fp."""
        first = cut(nodes.groupBy("fp").agg(F.min("s").alias("first"), F.count(F.lit(1)).alias("sets")))
        shared = first.filter("sets > 1")
        same = join_unique(nodes.select("s", "fp"), shared, ["fp"], "sets", first.count(), "inner").select(F.col("first").alias("a"), F.col("s").alias("b"))
        named = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_s"))
        near = fingerprint_links(first.select("fp"), most).distinct().join(named("a"), "a").join(named("b"), "b").select(F.col("a_s").alias("a"), F.col("b_s").alias("b"))
        return same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    return near_dedup.without_alike(docs, id_col, text_col, fingerprint_of, seed_links)
