"""Exact deduplication over a log-structured merge index of digests.

Every map task fills a memtable of digests and flushes it as a sorted run, cut into digest ranges, each with
a Bloom filter; a run's piece is one row, so hot texts reach the shuffle once for each run and not once for
each copy. The compaction of a digest range merges the pieces as they come, keeps the smallest and largest
identifier and the count of each digest, and reports digests that hit an earlier entry. Only documents behind
such hits have their bytes read again: a digest whose texts are byte for byte one text has the compaction's
answer, and texts that share a digest without being equal are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, join_unique, shuffle_partitions, small

#: Digests of a memtable, and of a digest range at most about.
MEMTABLE_ROWS, RANGE_ROWS = 65_536, 1 << 21
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BloomFilter:
    """16 bits for each key, four probes taken from one 64-bit digest."""

    def __init__(self, keys: np.ndarray):
        self.size = np.uint64(max(64, 16 * len(keys)))
        self.bits = np.zeros(int(self.size), bool)
        for at in self._probes(keys):
            self.bits[at] = True

    def _probes(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        for k in range(4):
            yield (keys + np.uint64(k) * step) % self.size

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._probes(keys):
            found &= self.bits[at]
        return found

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, stored: bytes, keys: int) -> BloomFilter:
        own = cls.__new__(cls)
        own.size = np.uint64(max(64, 16 * keys))
        own.bits = np.unpackbits(np.frombuffer(stored, np.uint8))[: int(own.size)].astype(bool)
        return own


#: A run: digests in order, the smallest and the largest identifier and the number of rows of each, and the filter.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, BloomFilter]


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    digests, least, most, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.argsort(digests, kind="stable")
    digests, least, most, counts = digests[order], least[order], most[order], counts[order]
    if not len(digests):
        return digests, least, most, counts
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    return digests[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.add.reduceat(counts, first)


class MergeIndex:
    """digest -> (smallest identifier, largest, count), in a memtable and levels of sorted, filtered runs."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = 8):
        self.memtable_rows, self.fan_in = memtable_rows, fan_in
        self.pending: list[tuple] = []
        self.pending_rows = 0
        self.levels: list[list[Run]] = []

    def put(self, digests: np.ndarray, least: np.ndarray, most: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((digests, least, most, counts))
        self.pending_rows += len(digests)
        if self.pending_rows >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            run = merged(self.pending)
            self.pending, self.pending_rows = [], 0
            self.add(0, (*run, BloomFilter(run[0])))

    def add(self, level: int, run: Run) -> None:
        """Take a sorted run as it is; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            parts, self.levels[level] = self.levels[level], []
            run = merged(parts)
            self.add(level + 1, (*run, BloomFilter(run[0])))

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Digests met more than once, each in the first run that holds it; filters spare most searches."""
        self.flush()
        runs = self.runs()
        for k, (digests, least, most, counts, _) in enumerate(runs):
            least, most, counts, new = least.copy(), most.copy(), counts.copy(), np.ones(len(digests), bool)
            for j, (there, their_least, their_most, their_counts, bloom) in enumerate(runs):
                if j == k or not len(there):
                    continue
                maybe = np.flatnonzero(bloom.may_hold(digests))
                at = np.minimum(np.searchsorted(there, digests[maybe]), len(there) - 1)
                same = there[at] == digests[maybe]
                maybe, at = maybe[same], at[same]
                if j < k:
                    new[maybe] = False
                least[maybe] = np.minimum(least[maybe], their_least[at])
                most[maybe] = np.maximum(most[maybe], their_most[at])
                counts[maybe] += their_counts[at]
            found = new & (counts > 1)
            yield digests[found], least[found], most[found], counts[found]


PIECE = "range int, digests binary, least binary, most binary, counts binary, filter binary"
HIT = "digest long, least long, most long, copies long"
_KINDS = (np.uint64, np.int64, np.int64, np.int64)


def flush_runs(ranges: int):
    """A map task's memtables, flushed as sorted runs in pieces of a digest range."""

    def pieces(run: Run) -> pa.RecordBatch:
        width = np.uint64(-(-(1 << 64) // ranges)) if ranges > 1 else None
        edges = [0, len(run[0])] if width is None else [*np.searchsorted(run[0], np.arange(ranges, dtype=np.uint64) * width), len(run[0])]
        kept = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        columns = [pa.array([x[s].tobytes() for _, s in kept], pa.binary()) for x in run[:4]]
        filters = pa.array([BloomFilter(run[0][s]).packed() for _, s in kept], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), *columns, filters], names=["range", "digests", "least", "most", "counts", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex(fan_in=1 << 60)
        for b in batches:
            digests = b.column(0).to_numpy().view(np.uint64)
            ids, known = b.column(1), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            least, most = np.where(known, ids, MOST), np.where(known, ids, LEAST)
            for i in range(0, len(digests), index.memtable_rows):
                part = slice(i, i + index.memtable_rows)
                index.put(digests[part], least[part], most[part], np.ones(len(digests[part]), np.int64))
                if not index.pending:
                    yield pieces(index.levels.pop()[0])
        index.flush()
        if index.levels:
            yield pieces(index.levels.pop()[0])

    return run


def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of each digest range, which come one range after the other; digests met more than once come out."""

    def found(index: MergeIndex) -> Iterator[pa.RecordBatch]:
        for digests, least, most, counts in index.hits():
            if len(digests):
                none = least == MOST  # no row has an identifier
                ids = (pa.array(x, mask=none) for x in (least, most))
                yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), *ids, pa.array(counts)], names=["digest", "least", "most", "copies"])

    index, own = MergeIndex(), None
    for b in batches:
        for k, *columns, bloom in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != own:
                yield from found(index)
                index, own = MergeIndex(), k
            run = tuple(np.frombuffer(c, kind) for c, kind in zip(columns, _KINDS, strict=True))
            index.add(0, (*run, BloomFilter.unpacked(bloom, len(run[0]))))
    yield from found(index)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=F.xxhash64) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text is the empty text. Of a group
    the row with the smallest (keep="largest": largest) id stays. Ids are whole numbers. Rows that repeat an
    id count as copies of their text, and each row that bears keep_id is kept. A null id stays only where
    its group has no other id. An empty table gives no rows; other columns are ignored, whatever they are
    called.
    """
    plain = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    keyed = plain.withColumn("digest", digest("norm"))
    thin = cut(keyed.select("id", "digest", F.sha2("norm", 256).alias("sha")))
    rows = thin.count()
    ranges = max(shuffle_partitions(docs.sparkSession), -(-rows // RANGE_ROWS))
    pieces = thin.select("digest", F.col("id").cast("long").alias("id")).mapInArrow(flush_runs(ranges), PIECE)
    hits = cut(pieces.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(compact, HIT))
    own = hits.select("digest")
    behind = keyed.join(small(own), "digest", "left_semi")
    # the bytes themselves: one row for each text behind a hit, copies meet before the shuffle
    texts = cut(behind.select("digest", "norm").distinct().select("digest", F.sha2("norm", 256).alias("sha")))
    parted = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))
    pick = "least" if keep == "smallest" else "most"
    groups = hits.join(texts, "digest").select("digest", "sha", F.col(pick).alias("keep_id"), F.col("copies").alias("group_size"))
    if not parted.isEmpty():  # unequal texts with one digest
        best = F.min("id") if keep == "smallest" else F.max("id")
        unequal = behind.join(parted, "digest", "left_semi").groupBy("digest", "norm").agg(best.cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.join(parted, "digest", "left_anti").unionByName(unequal.select("digest", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").filter("group_size > 1"))
    joined = join_unique(thin, cut(groups), ["digest", "sha"], "group_size", rows)
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id").cast(dict(thin.dtypes)["id"]))
    return joined.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs, all columns as they are, with one row of each group of equal texts.

    What goes is told by id and text, so that a repeated id takes no other text with it. Of rows that repeat
    an id and a text one stays, whichever is read first. Rows without an id stay.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    named = groups.filter((F.col("group_size") > 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    told = cut(named.groupBy("id", "sha").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not kept"))
    out = own.join(small(told), ["id", "sha"], "left_anti").select("row.*")
    repeats = told.filter("kept").select("id", "sha")
    if repeats.isEmpty():
        return out
    twice = own.join(repeats, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"])
    return out.unionByName(twice.select("row.*"))
