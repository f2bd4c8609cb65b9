"""Hard negatives: rows of other labels that score between shares of an anchor's positives.

Scores are inner products of vectors of whole numbers. A vector is stored with the mean and the deviation (the
length of what the mean leaves) of each of its segments. Two vectors' product in a segment is its width times the
product of the means, plus or minus at most the product of the deviations; the sum over segments
bounds the score. Segments are halved from one that spans the vector down to the stored ones, and only pairs
whose bounds still meet what an anchor asks for go on; the last are scored exactly.

Rows lie in pieces, to which the anchors (blocks of them, if they are many) are sent. The first pass finds each
anchor's positives, the second, which knows their scores, its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Components of a stored segment.
WIDTH = 8
#: Rows of a piece at most, and pieces at least.
PIECE, PIECES = 1 << 18, 16
#: Anchors that are sent to a piece together. Rows are sent once for each block of them.
MOST_ANCHORS = 1 << 17
#: Rows packed together, and anchors and rows that are bounded together.
PACK, STRIP, CHUNK = 512, 64, 4_096
#: Pieces whose lists are merged at a time.
MERGE = 16
#: No score: below all.
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max - 1


def _widths(dims: int) -> np.ndarray:
    return np.minimum(WIDTH, dims - np.arange(0, dims, WIDTH))


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the stored segments of each row."""
    n, dims = x.shape
    widths = _widths(dims)
    padded = np.zeros((n, len(widths) * WIDTH))
    padded[:, :dims] = x
    parts = padded.reshape(n, -1, WIDTH)
    means = parts.sum(axis=2) / np.maximum(widths, 1)
    inside = np.arange(WIDTH) < widths[:, None]
    left = np.where(inside, parts - means[:, :, None], 0.0)
    return means.astype(np.float32), np.sqrt((left * left).sum(axis=2)).astype(np.float32)


def levels(means: np.ndarray, devs: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means times the root of the width, deviations) from one segment down to the stored ones."""
    widths, means, devs = _widths(dims).astype(np.float64), means.astype(np.float64), devs.astype(np.float64)
    out = []
    while True:
        out.append(((means * np.sqrt(widths)).astype(np.float32), devs.astype(np.float32)))
        if len(widths) < 2:
            return out[::-1]
        if len(widths) % 2:
            widths, means, devs = np.append(widths, 0.0), np.pad(means, ((0, 0), (0, 1))), np.pad(devs, ((0, 0), (0, 1)))
        both = widths.reshape(-1, 2)
        m, d = means.reshape(len(means), -1, 2), devs.reshape(len(devs), -1, 2)
        mean = (m * both).sum(axis=2) / both.sum(axis=1)
        devs = np.sqrt((d * d + both * (m - mean[:, :, None]) ** 2).sum(axis=2))
        widths, means = both.sum(axis=1), mean


@dataclass
class Rows:
    """Rows in order of label, then id."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    def take(self, which: np.ndarray | slice) -> Rows:
        return Rows(self.ids[which], self.labels[which], self.x[which], [(m[which], d[which]) for m, d in self.levels])

    def part(self, label: str) -> tuple[int, int]:
        lo, hi = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, side="right")
        return int(lo), int(hi)


def within(anchors: Rows, rows: Rows, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that some anchor may score from least to most, by bounds of finer and finer segments, and for which anchors each does."""
    left, open_ = np.arange(len(rows.ids)), np.ones((len(anchors.ids), len(rows.ids)), bool)
    own, theirs = (np.sqrt((x.levels[0][0] ** 2 + x.levels[0][1] ** 2).sum(axis=1)) for x in (anchors, rows))
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True):
        middle, reach = am @ rm[left].T, ad @ rd[left].T
        reach += 1e-5 * np.outer(own, theirs[left]) + 1e-3  # rounding of sums in single precision
        open_ &= (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
        some = open_.any(axis=0)
        left, open_ = left[some], open_[:, some]
    return left, open_


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, whole numbers, exactly; beyond a long they stop at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    sum_of = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    for most, kind in ((2.0**24, np.float32), (2.0**53, np.float64)):
        if sum_of < most:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


class Best:
    """The best scores of each of n lists, ties by the smaller id."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.score, self.id = np.full((n, most), NONE), np.zeros((n, most), np.int64)

    @property
    def last(self) -> np.ndarray:
        """What a score must reach to enter: NONE while there is room."""
        return self.score[:, -1]

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        lists = np.unique(which)
        old_s, old_i = self.score[lists], self.id[lists]
        real = old_s > NONE
        w = np.concatenate([np.repeat(lists, real.sum(axis=1)), which])
        s, i = np.concatenate([old_s[real], score]), np.concatenate([old_i[real], ids])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        keep = place < self.most
        self.score[lists] = NONE
        self.score[w[keep], place[keep]], self.id[w[keep], place[keep]] = s[keep], i[keep]


def _strips(anchors: Rows) -> Iterator[slice]:
    """Slices of anchors of one label."""
    edges = np.flatnonzero(np.r_[True, anchors.labels[1:] != anchors.labels[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield from (slice(at, min(at + STRIP, hi)) for at in range(lo, hi, STRIP))


def find_positives(anchors: Rows, rows: Rows, most: int) -> Best:
    best = Best(len(anchors.ids), most)
    for strip in _strips(anchors):
        mine = anchors.take(strip)
        lo, hi = rows.part(mine.labels[0])
        for at in range(lo, hi, CHUNK):
            some = rows.take(slice(at, min(at + CHUNK, hi)))
            least = best.last[strip]
            left, open_ = within(mine, some, least, np.full(len(least), np.inf))
            found = scores(mine.x, some.x[left])
            a, r = np.nonzero(open_ & (found >= least[:, None]) & (some.ids[left][None, :] != mine.ids[:, None]))
            best.add(strip.start + a, found[a, r], some.ids[left][r])
    return best


def find_negatives(anchors: Rows, rows: Rows, least: np.ndarray, most: np.ndarray, n: int) -> Best:
    """Lists of anchors times positives; least and most are anchors x positives, least above most where there is none."""
    each = least.shape[1]
    best = Best(len(anchors.ids) * each, n)
    for strip in _strips(anchors):
        mine = anchors.take(strip)
        lo, hi = rows.part(mine.labels[0])
        top = most[strip]
        asks = least[strip] <= top
        for start, stop in ((0, lo), (hi, len(rows.ids))):
            for at in range(start, stop, CHUNK):
                some = rows.take(slice(at, min(at + CHUNK, stop)))
                floor = np.maximum(least[strip], best.last.reshape(-1, each)[strip])
                low = np.where(asks, floor.astype(np.float64), np.inf).min(axis=1)
                left, open_ = within(mine, some, low, np.where(asks, top.astype(np.float64), -np.inf).max(axis=1))
                found, ids = scores(mine.x, some.x[left]), some.ids[left]
                for k in range(each):
                    a, r = np.nonzero(open_ & (found >= floor[:, k : k + 1]) & (found <= top[:, k : k + 1]))
                    best.add((strip.start + a) * each + k, found[a, r], ids[r])
    return best


PACKS = "first long, ids binary, labels array<string>, kind string, vectors binary, means binary, devs binary"


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def pack_rows(rows: DataFrame) -> DataFrame:
    """Up to PACK rows (id, label, vector) in one, with their summaries. No shuffle."""
    names = [c.split()[0] for c in PACKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, PACK) for at in range(0, whole.num_rows, PACK)):
                x = _matrix(b.column(2), b.num_rows)
                size = np.abs(x).max() if x.size else 0.0
                kind = "<i2" if size < 2**15 else "<f8"
                ids = b.column(0).to_numpy()
                means, devs = summaries(x)
                values = [[int(ids[0])], [ids.astype("<i8").tobytes()], [b.column(1).to_pylist()], [kind], [x.astype(kind).tobytes()], [means.tobytes()], [devs.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), pa.array(values[1], pa.binary()), pa.array(values[2], pa.list_(pa.string())), pa.array(values[3]), *(pa.array(v, pa.binary()) for v in values[4:])], names=names)

    return rows.select("id", "label", "vector").mapInArrow(run, PACKS)


def _ordered(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, means: np.ndarray, devs: np.ndarray, dims: int) -> Rows:
    order = np.lexsort((ids, labels))
    return Rows(ids[order], labels[order], x[order], levels(means[order], devs[order], dims))


def _piece(packs: pa.Table, dims: int, most: int) -> Rows:
    """The rows of a piece; of those with equal labels and vectors the most smallest ids, as more can't be asked for."""
    made = [(np.frombuffer(p["ids"], "<i8"), np.array(p["labels"], str), np.frombuffer(p["vectors"], p["kind"])) for p in packs.to_pylist()]
    stored = [(np.frombuffer(m, np.float32), np.frombuffer(d, np.float32)) for m, d in zip(packs.column("means").to_pylist(), packs.column("devs").to_pylist(), strict=True)]
    ids, labels = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    n = len(ids)
    x = np.concatenate([m[2] for m in made]).reshape(n, dims)
    means, devs = (np.concatenate([s[k] for s in stored]).reshape(n, -1) for k in (0, 1))
    alike = np.unique(labels, return_inverse=True)[1]
    if dims:
        same = np.unique(np.ascontiguousarray(x).view(f"V{dims * x.itemsize}").ravel(), return_inverse=True)[1]
        alike = np.unique(alike * n + same, return_inverse=True)[1]
    order = np.lexsort((ids, alike))
    alike = alike[order]
    order = order[np.arange(n) - np.searchsorted(alike, alike) < most]
    return _ordered(ids[order], labels[order], x[order], means[order], devs[order], dims)


def _anchors(asked: pa.Table, dims: int) -> tuple[Rows, np.ndarray]:
    """Anchors in order of label and id, and where each stood."""
    n = asked.num_rows
    ids, labels, x = asked.column("id").to_numpy(), np.array(asked.column("label").to_pylist(), str), _matrix(asked.column("vector"), n).reshape(n, dims)
    return _ordered(ids, labels, x, *summaries(x), dims), np.lexsort((ids, labels))


_NEAR = pa.list_(pa.struct([("far", pa.int64()), ("id", pa.int64())]))


def _lists(best: Best, which: np.ndarray) -> pa.Array:
    score, ids = best.score[which], best.id[which]
    real = score > NONE
    ends = np.r_[0, np.cumsum(real.sum(axis=1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(-score[real]), pa.array(ids[real])], fields=list(_NEAR.value_type)))


def _merged(found: DataFrame, keys: list[str], pieces: int, most: int) -> DataFrame:
    while pieces > 1:
        pieces = -(-pieces // MERGE)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near")
        found = found.groupBy(*keys, F.floor(F.col("c") / MERGE).cast("int").alias("c")).agg(best)
    return found


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector_col holds whole numbers; a score is the inner product with the anchor, largest first, ties to the
    smaller id. The positives of an anchor are its first others of the same label. For each positive come the first rows of
    other labels with low / 100 of its score <= score <= high / 100 of it. Rows with a null id or label or a vector
    that is null or holds null or non-finite components take no part, nor do vectors of another length than most
    have (of equally frequent lengths the largest). Of rows that repeat an id the one with the smallest label and vector stays, an
    anchor if any of them is one. Scores stop at the ends of a long. A lone label gives no rows, nor does an empty table.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    lengths = own.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dims = lengths.dims
    own = own.filter(F.size("vector") == dims)
    repeats = cut(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    if not repeats.isEmpty():
        one = own.join(repeats, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"), F.max("asks").alias("asks"))
        own = cut(own.join(repeats, "id", "left_anti").unionByName(one.select("id", "x.label", "x.vector", "asks")))
    n, asked = own.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    pieces, blocks = max(PIECES, -(-n // PIECE)), max(1, -(-asked // MOST_ANCHORS))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    deal = lambda c, many: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(many)).cast("int")
    packs = cut(pack_rows(own)).withColumn("c", deal("first", pieces)).withColumn("q", every(blocks))
    anchors = cut(own.filter("asks").select("id", "label", "vector", deal("id", blocks).alias("q")))
    most = max(positives + 1, negatives)

    def positives_of(asks: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("c", pa.int32()), ("id", pa.int64()), ("near", _NEAR)])
        if not asks.num_rows or not held.num_rows:
            return schema.empty_table()
        a, order = _anchors(asks, dims)
        best = find_positives(a, _piece(held, dims, most), positives)
        return pa.Table.from_arrays([asks.column("c").take(order), pa.array(a.ids), _lists(best, np.arange(len(a.ids)))], schema=schema)

    def negatives_of(asks: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("c", pa.int32()), ("id", pa.int64()), ("positive", pa.int64()), ("score", pa.int64()), ("near", _NEAR)])
        if not asks.num_rows or not held.num_rows:
            return schema.empty_table()
        a, order = _anchors(asks, dims)
        asked_for = asks.column("near").take(order).to_pylist()
        least, top = np.full((len(order), positives), MOST), np.full((len(order), positives), -MOST)
        for k, near in enumerate(asked_for):
            for j, p in enumerate(near):
                least[k, j] = -((low * p["far"]) // 100)  # far is the score with its sign turned: the next whole number at or above
                top[k, j] = min(MOST, (high * -p["far"]) // 100)
        best = find_negatives(a, _piece(held, dims, most), least, top, negatives)
        slots = np.array([k * positives + j for k, near in enumerate(asked_for) for j in range(len(near))], int)
        slots = slots[best.score[slots, 0] > NONE] if len(slots) else slots
        of = [asked_for[s // positives][s % positives] for s in slots]
        c = pa.array(np.full(len(slots), asks.column("c")[0].as_py(), np.int32))
        return pa.Table.from_arrays([c, pa.array(a.ids[slots // positives]), pa.array([p["id"] for p in of], pa.int64()), pa.array([-p["far"] for p in of], pa.int64()), _lists(best, slots)], schema=schema)

    def meet(asks: DataFrame, f, schema: str) -> DataFrame:
        return asks.withColumn("c", every(pieces)).groupBy("q", "c").cogroup(packs.groupBy("q", "c")).applyInArrow(f, schema)

    near = "near array<struct<far: long, id: long>>"
    found = _merged(meet(anchors, positives_of, f"c int, id long, {near}"), ["id"], pieces, positives)
    with_positives = cut(anchors.join(found.filter(F.size("near") > 0).select("id", "near"), "id"))
    lists = _merged(meet(with_positives, negatives_of, f"c int, id long, positive long, score long, {near}"), ["id", "positive", "score"], pieces, negatives)
    ranked = lists.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode("near").alias("rank", "x"))
    return ranked.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.far")).alias("negative_score"))
