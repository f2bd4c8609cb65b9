"""Places, ranks and group statistics without a window over a whole group.

Rows are sorted into ranges by value and a unique tie, so that neither a large group nor a common value lands in
one task. A row's place is its number in its range plus the rows of the ranges before it. Runs of equal rows
are aggregated and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.interim import written

#: Parts of a group whose best rows are found apart from each other.
PARTS = 32
#: monotonically_increasing_id numbers the rows of a partition in its lower bits.
_BITS = 33


def with_group(df: DataFrame, group: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """df with aggregates of its groups, null keys being a group like any other.

    Aggregated before the shuffle and joined back: a few groups are broadcast by their size at run time, and a
    hot one among many is split there.
    """
    stats = df.groupBy(*(F.col(g).alias(f"_by{k}") for k, g in enumerate(group))).agg(*(c.alias(n) for n, c in columns.items()))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_by{k}")) for k, g in enumerate(group)))
    return df.join(stats, same, "left").drop(*(f"_by{k}" for k in range(len(group))))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "_at") -> DataFrame:
    """df with each row's place, from 0, in the order of all rows. The order should end in something unique.

    The driver gets a count for each range, as many as there are shuffle partitions.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = written(sorted_.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _BITS)
    counts = {r.part: r.n for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = [], 0
    for k in sorted(counts):
        before.append((k, rows))
        rows += counts[k]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    own = held.withColumn("_part", part.cast("long"))
    placed = own.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << _BITS) - 1))
    return placed.drop("_m", "_part", "_before")


def with_place(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's place in its group, from 1, as row_number over the group would give it."""
    placed = with_group(with_position(df, [*map(F.col, group), *order]), group, {"_first": F.min("_at")})
    return placed.withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def with_average_rank(df: DataFrame, group: Sequence[str], value: str, tie: str, name: str) -> DataFrame:
    """df with the rank of value in its group, from 1, equal values sharing the mean of their places; null for null."""
    known = df.filter(F.col(value).isNotNull())
    placed = with_group(with_position(known, [*map(F.col, group), F.col(value), F.col(tie)]), group, {"_first": F.min("_at")})
    shared = with_group(placed, [*group, value], {"_low": F.min("_at"), "_high": F.max("_at")})
    ranked = shared.withColumn(name, (F.col("_low") + F.col("_high")) / 2 - F.col("_first") + 1).drop("_at", "_first", "_low", "_high")
    return ranked.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def with_dense_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the number of distinct values of its group up to its own."""
    values = df.select(*group, value).distinct()
    placed = with_place(values, group, [F.asc(value)], name)
    keys = [*group, value]
    other = placed.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), name)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(keys)))
    return df.join(other, same).drop(*(f"_by{i}" for i in range(len(keys))))


def with_best(df: DataFrame, group: Sequence[str], score: Column, tie: str, k: int, name: str) -> DataFrame:
    """df with whether a row is among the k best scores of its group, ties to the smaller tie, which is unique in it.

    Parts of a group give their k best each, and of those the k best are the group's: what meets in one task is
    PARTS * k rows. A null score is the worst.
    """
    from tidemark.operators.asof import first_by

    far = F.coalesce(F.when(~F.isnan(score), -score.cast("double")), F.lit(float("inf")))
    keyed = df.select(*group, far.alias("_far"), F.col(tie).alias("_tie"), F.pmod(F.xxhash64(tie), F.lit(PARTS)).alias("_part"))
    few = first_by(keyed, [*group, "_part"], [F.asc("_far"), F.asc("_tie")], k)
    best = F.slice(F.array_sort(F.collect_list(F.struct("_far", "_tie"))), 1, k)
    chosen = few.groupBy(*group).agg(best.alias("_b")).select(*group, F.explode("_b._tie").alias("_tie"), F.lit(True).alias(name))
    chosen = chosen.select(*(F.col(g).alias(f"_by{i}") for i, g in enumerate(group)), "_tie", name)
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_by{i}")) for i, g in enumerate(group)), F.col(tie) == F.col("_tie"))
    return df.join(chosen, same, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_tie", *(f"_by{i}" for i in range(len(group))))
