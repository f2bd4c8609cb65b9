"""Shards of nearly equal bytes, over ranges of keys that sampled splitters part.

A record's key is a hash of its text, its id and a number of its own, so that copies of a text are
neighbours. Keys drawn with a chance that grows with a record's size give quantiles, which part the records into
ranges; a range that is still too full is parted again by keys drawn from it, by the first part of the key that
differs there. In a range of bounded size a running sum gives each record its place among all bytes, and
seven places part eight shards. Texts take part in no shuffle unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, shuffle_partitions

#: A range holds at most so many records and bytes, or one record; and a quarter of a task's even share.
RANGE_ROWS, RANGE_BYTES = 1 << 20, 1 << 30
SHARE = 4
#: Keys drawn for each range that there will be.
DRAWN = 16
#: Copies of a text stay together where they are at most so large a part of a shard, or no larger than one record.
TOGETHER = 0.01
#: The parts of a key, in order.
KEY = ("h", "d", "u")


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


class Ranges:
    """Numbers of ranges in key order: one at first; each level parts some of the last level's."""

    def __init__(self):
        self.count, self.levels = 1, []

    def part(self, splits: dict[int, tuple[int, np.ndarray]]) -> None:
        """splits: range -> (part of the key, values; a value is the least of the next range)."""
        more = np.zeros(self.count, np.int64)
        for r, (_, values) in splits.items():
            more[r] = len(values)
        base = np.arange(self.count) + np.concatenate([[0], np.cumsum(more)[:-1]])
        self.levels.append((base, splits))
        self.count += int(more.sum())

    def of(self, key: Sequence[np.ndarray]) -> np.ndarray:
        found = np.zeros(len(key[0]), np.int64)
        for base, splits in self.levels:
            order = np.argsort(found, kind="stable")
            edges = np.flatnonzero(np.diff(found[order], prepend=-1))
            step = np.zeros(len(found), np.int64)
            for rows in np.split(order, edges[1:]) if len(order) else ():
                if (split := splits.get(int(found[rows[0]]))) is not None:
                    step[rows] = np.searchsorted(split[1], key[split[0]][rows], side="right")
            found = base[found] + step
        return found


def with_ranges(keys: DataFrame, ranges: Ranges) -> DataFrame:
    """keys with their range r, found in the task that reads them."""
    if not ranges.levels:
        return keys.withColumn("r", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in KEY]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges.of(key))], names=[*b.schema.names, "r"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("r", T.LongType())]))


def _quantiles(values: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Values that part the weights into about equal parts, each the least of its part; a value of more than one part's weight gets one of its own."""
    order = np.argsort(values, kind="stable")
    values, total = values[order], np.cumsum(weights[order])
    found, times = np.unique(values[np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)], return_counts=True)
    return np.union1d(found, found[times > 1] + 1)


def find_ranges(keys: DataFrame, most_rows: int, most_bytes: int) -> Ranges:
    """Ranges of at most most_rows and most_bytes, or one record.

    The driver gets counts of the ranges and DRAWN keys for each that is wanted: with 2**20 records and
    2**30 bytes a range, some 100,000 ranges at 100 TB.
    """
    ranges = Ranges()
    while True:
        placed = with_ranges(keys.select(*KEY, "size"), ranges)
        spread = [e for c in KEY for e in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))]
        sizes = placed.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *spread).toPandas()
        full = sizes[((sizes.n > most_rows) | (sizes.bytes > most_bytes)) & (sizes.n > 1)]
        if not len(full):
            return ranges
        parts, by = {}, {}
        for f in full.itertuples(index=False):
            # twice as many as needed, so that uneven samples seldom ask for another level
            parts[f.r] = 2 * int(max(-(-f.n // most_rows), -(-f.bytes // most_bytes)))
            by[f.r] = next(k for k, c in enumerate(KEY) if getattr(f, f"{c}0") < getattr(f, f"{c}1"))
        # a record is drawn with a chance in proportion to its size and its share of the rows
        info = full.assign(want=[DRAWN * parts[r] for r in full.r])[["r", "n", "bytes", "want"]]
        marks = keys.sparkSession.createDataFrame(info.rename(columns={"n": "rn", "bytes": "rb"}).astype("int64"))
        part = (F.col("size") / F.col("rb") + 1 / F.col("rn")) / 2
        chance = F.least(F.lit(1.0), F.col("want") * part)
        coin = F.pmod(F.xxhash64("u", F.lit(len(ranges.levels))), F.lit(1 << 30)) / float(1 << 30)
        # as many marks as ranges that are too full, which the driver holds
        drawn = placed.join(F.broadcast(marks), "r").filter(coin < chance).select("r", *KEY, (part / chance).alias("w")).toPandas()
        splits, drawn_in = {}, dict(iter(drawn.groupby("r")))
        for f in full.itertuples(index=False):
            k, c = by[f.r], KEY[by[f.r]]
            mine = drawn_in.get(f.r)
            values = np.zeros(0, np.int64) if mine is None else _quantiles(mine[c].to_numpy(), mine.w.to_numpy(), parts[f.r])
            lo, hi = int(getattr(f, f"{c}0")), int(getattr(f, f"{c}1"))
            values = values[(values > lo) & (values <= hi)]
            # too few different keys drawn: part in the middle, so that every level parts
            splits[int(f.r)] = (k, values if len(values) else np.array([lo + (hi - lo + 1) // 2]))
        ranges.part(splits)


def _placed(keys: DataFrame, ranges: Ranges) -> tuple[DataFrame, int]:
    """keys with at (bytes before the record) and k (records before it) in key order, and all bytes."""
    placed = with_ranges(keys, ranges)
    sizes = placed.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).toPandas().sort_values("r")
    start = sizes.assign(k0=sizes.n.cumsum() - sizes.n, at0=sizes.bytes.cumsum() - sizes.bytes)[["r", "k0", "at0"]].astype("int64")
    w = Window.partitionBy("r").orderBy(*KEY)
    own = placed.withColumn("_at", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_k", F.row_number().over(w) - 1)
    # a row for each range, which the driver has held already
    joined = own.join(F.broadcast(keys.sparkSession.createDataFrame(start)), "r")
    at, k = (F.col("_at") + F.col("at0")).alias("at"), (F.col("_k") + F.col("k0")).alias("k")
    return joined.select(*keys.columns, at, k), int(sizes.bytes.sum())


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and, in the struct `row`, the columns to carry: a row for each row of docs.

    The law is `bytes`: shards are stretches of the records in key order, each ending where the bytes so far
    are nearest to its share. An edge that would fall among copies of a text moves to their nearer end, if together they are
    no larger than TOGETHER of a shard or than the largest record; a group too large for that is parted among
    its records. A null text has no bytes and size 1; rows that repeat an id are records of their own, and a null id
    comes before all others of its text. An empty table gives no rows, and fewer records than shards leave shards empty.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    keys = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        text_hash(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.monotonically_increasing_id().alias("u"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    keys = cut(keys)  # u differs from run to run, so it is written once
    total, n, largest = keys.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
    columns = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law")]
    tail = [*(["row"] if carry else [])]
    if not n:
        return keys.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *tail)
    even = SHARE * max(shuffle_partitions(spark), shards)
    ranges = find_ranges(keys, min(RANGE_ROWS, -(-n // even)), min(RANGE_BYTES, -(-total // even)) if carry else total)
    placed, total = _placed(keys, ranges)
    placed = cut(placed)
    edges = _edges(placed, shards, total, largest)
    shard = sum((F.when(F.col("at") >= at, 1).otherwise(0) for at, _ in edges), F.lit(0))
    first = F.element_at(F.array(F.lit(0).cast("long"), *(F.lit(k).cast("long") for _, k in edges)), F.col("shard") + 1)
    out = placed.withColumn("shard", shard)
    return out.select(*columns, "shard", (F.col("k") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *tail)


def _edges(placed: DataFrame, shards: int, total: int, largest: int) -> list[tuple[int, int]]:
    """(bytes, records) before each shard but the first."""
    aims = [total * s // shards for s in range(1, shards)]
    holds = [(F.col("at") <= a) & (F.col("at") + F.col("size") > a) for a in aims]
    over = placed.filter(sum((h.cast("int") for h in holds), F.lit(0)) > 0).select("h", "at", "k", "size").collect()  # at most a record for each aim
    groups = {
        g.h: g for g in placed.filter(F.col("h").isin(sorted({r.h for r in over}))).groupBy("h").agg(F.min("at").alias("at"), F.min("k").alias("k"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    }
    edges = []
    for aim in aims:
        r = next(r for r in over if r.at <= aim < r.at + r.size)
        g = groups[r.h]
        whole = g.size <= max(total / shards * TOGETHER, largest)
        at, k, size, n = (g.at, g.k, g.size, g.n) if whole else (r.at, r.k, r.size, 1)
        edges.append((at, k) if 2 * (aim - at) < size else (at + size, k + n))
    return edges


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of docs, in order of their slots, as Parquet under path/shard=.../ and return them as read back with shard and slot.

    Rows travel whole; a shard is written as files of about RANGE_BYTES of its stretches, so that no task holds one.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = assign_shards(docs, shards, id_col, text_col, own)
    size, n = placed.agg(F.sum("size"), F.count(F.lit(1))).first()
    parts = max(shuffle_partitions(docs.sparkSession), -(-(size or 0) // RANGE_BYTES))
    rows = placed.select("shard", "slot", "row.*").repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    schema = T.StructType([*rows.drop("shard").schema.fields, T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)
