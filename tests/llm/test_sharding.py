import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def plainly(rows, shards=8):
    """Shards of rows (id, text) by one sort: a multiset of (id, size, crc, shard, slot)."""
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(data[k]).hexdigest()[:15], rows[k][0] is not None, rows[k][0] or 0))
    size = [len(data[k]) + 1 for k in order]
    at = np.cumsum([0, *size])
    total, edges = int(at[-1]), []
    for s in range(1, shards):
        aim = total * s // shards
        k = int(np.searchsorted(at, aim, side="right")) - 1
        same = [j for j in range(len(order)) if data[order[j]] == data[order[k]]]
        lo, hi = (same[0], same[-1] + 1) if at[same[-1] + 1] - at[same[0]] <= max(total / shards * sharding.TOGETHER, max(size)) else (k, k + 1)
        edges.append(lo if 2 * (aim - at[lo]) < at[hi] - at[lo] else hi)
    out = Counter()
    for j, k in enumerate(order):
        shard = sum(e <= j for e in edges)
        out[(rows[k][0], size[j], zlib.crc32(data[k]), shard, j - ([0, *edges][shard]))] += 1
    return out


def run(docs, shards=8):
    made = sharding.assign_shards(docs, shards)
    assert {(r.law, r.grown_shard) for r in made.select("law", "grown_shard").distinct().collect()} <= {("bytes", None)}
    return Counter(map(tuple, made.select("doc_id", "size", "text_crc32", "shard", "slot").collect()))


def table(n, copies=0, same_id=0, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, "é" * int(rng.integers(0, 9)) + "x" * int(rng.pareto(1.2) * 30) + str(i)) for i in range(n)]
    rows += [(10_000 + i, "a copy of one text") for i in range(copies)]
    return rows + [(-1, "a repeated row")] * same_id + [(None, None), (None, ""), (None, "no id")]


@pytest.mark.parametrize(("n", "copies", "same_id", "shards"), [(300, 0, 0, 8), (300, 400, 0, 8), (100, 0, 300, 8), (40, 20, 0, 3), (2, 0, 0, 8), (60, 0, 0, 1)])
def test_shards_are_those_of_one_sort(spark, n, copies, same_id, shards):
    rows = table(n, copies, same_id)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards) == plainly(rows, shards)


def test_ranges_are_bounded_whatever_is_hot(spark):
    rows = table(300, 700, 600)
    keys = sharding.cut(
        spark.createDataFrame(rows, "doc_id long, text string").select(
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), sharding.text_hash(F.col("text")).alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.monotonically_increasing_id().alias("u")
        )
    )
    ranges = sharding.find_ranges(keys, 20, 4_000)
    got = sharding.with_ranges(keys, ranges).toPandas()
    sizes = got.groupby("r").agg(n=("u", "size"), size=("size", "sum"))
    assert sizes.n.max() <= 20 and (sizes["size"][sizes.n > 1] <= 4_000).all() and sizes.n.sum() == len(rows)
    assert got.sort_values(["h", "d", "u"]).r.is_monotonic_increasing
    assert len(ranges.levels) < 12


def test_sizes_are_nearly_equal_and_copies_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = sharding.assign_shards(docs)
    sizes = [r.s for r in made.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    largest = made.agg(F.max("size")).first()[0]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * max(largest, 0.01 * sum(sizes) / 8)
    apart = made.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).filter("n > 1")
    assert apart.count() == 0


def test_slots_have_no_gaps(spark):
    docs = spark.createDataFrame(table(500, 200), "doc_id long, text string")
    made = sharding.assign_shards(docs).groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in made)


def test_written_shards_hold_every_row_whole(spark, tmp_path):
    rows = table(200, 100)
    docs = spark.createDataFrame([(*r, "l", "s", "k") for r in rows], "doc_id long, text string, lang string, shard string, row string")
    back = sharding.write_shards(docs, str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text", "lang", "row").collect())) == Counter((*r, "l", "k") for r in rows)
    want = Counter((i, shard, slot) for i, _, _, shard, slot in plainly(rows).elements())
    assert Counter(map(tuple, back.select("doc_id", "shard", "slot").collect())) == want


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(docs).count() == 0
    assert sharding.write_shards(docs, str(tmp_path / "out")).count() == 0
