"""Point-in-time reads and temporal joins.

A versioned fact has available_at (when it became knowable) and source_version. Reads see the versions with
available_at <= as_of; of a key's visible versions the one with the largest (available_at, source_version)
wins, versions compared by bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = ("available_at", "source_version")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; the rank filter lets Spark drop rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def latest_version(facts: DataFrame, key: Sequence[str], as_of: Column, *where: Column) -> DataFrame:
    """The newest visible version of each key. Null key values are one value. where holds before the choice."""
    visible = facts.filter(F.col("available_at") <= as_of)
    for condition in where:
        visible = visible.filter(condition)
    return first_by(visible, key, [F.desc(c) for c in NEWEST])


def within(column: str, as_of: Column, lookback: str) -> Column:
    """column in (as_of - lookback, as_of]."""
    return (F.col(column) > as_of - F.expr(f"interval {lookback}")) & (F.col(column) <= as_of)


def after(column: str, as_of: Column, lookback: str) -> Column:
    """column > as_of - lookback, without an upper bound."""
    return F.col(column) > as_of - F.expr(f"interval {lookback}")


def at_dates(facts: DataFrame, dates: Sequence[Column], key: Sequence[str]) -> DataFrame:
    """latest_version at each of a few as_of parameters, in one plan: a fact goes to the dates that see it."""
    seen = F.filter(F.array(*dates), lambda d: F.col("available_at") <= d)
    return first_by(facts.withColumn("as_of", F.explode(seen)), ["as_of", *key], [F.desc(c) for c in NEWEST])


def newest_vectors(features: DataFrame, as_of: Column, key: str = "security_id") -> DataFrame:
    """Of each key the newest event's newest visible version, in one pass."""
    visible = features.filter(F.col("available_at") <= as_of)
    return first_by(visible, [key], [F.desc("event_time"), *(F.desc(c) for c in NEWEST)])


def newest_snapshot(members: DataFrame, as_of: Column, key: str = "security_id") -> DataFrame:
    """The newest visible snapshot date's members, each in its newest version."""
    visible = members.filter(F.col("available_at") <= as_of)
    newest = visible.agg(F.max("snapshot_date").alias("snapshot_date"))
    return first_by(visible.join(F.broadcast(newest), "snapshot_date"), [key], [F.desc(c) for c in NEWEST])


def valid_on(dimension: DataFrame, day: Column, start: str = "listed_from", end: str = "listed_to") -> DataFrame:
    """Rows whose interval holds the day; a null bound is open."""
    return dimension.filter((F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day)))


def overlapping(facts: DataFrame, array: str, wanted: Sequence) -> DataFrame:
    return facts.filter(F.arrays_overlap(F.col(array), F.array(*map(F.lit, wanted))))


def vintages_before(rows: DataFrame, accrual_date: Column) -> DataFrame:
    return rows.filter(F.col("vintage_date") < accrual_date)


def unfinished(requests: DataFrame, results: DataFrame, key: Sequence[str], expected: str) -> DataFrame:
    """Requests that lack an expected number or have fewer results than that."""
    done = results.groupBy(*key).agg(F.count(F.lit(1)).alias("_done"))
    return requests.join(done, list(key), "left").filter(F.col(expected).isNull() | (F.coalesce("_done", F.lit(0)) < F.col(expected))).drop("_done")


def staleness(health: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """feed, age_hours, stale for each feed with a limit; one that never ran is stale."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / 1e6
    age = F.greatest(seconds / 3600, F.lit(0.0))
    age = F.when(F.col("last_success").isNotNull(), age)
    return limits.join(health, "feed", "left").select("feed", age.alias("age_hours"), (age.isNull() | (age > F.col("sla_hours"))).alias("stale"))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], direction: str = "backward", ties: Sequence[str] = ()) -> DataFrame:
    """left with columns of right's nearest row at or before (forward: at or after) its time, or nulls.

    Both sides are united and sorted once within the key; no pair of rows is ever formed. Of right rows at
    one time the largest by ties wins backward, and the smallest forward. A key is one task's: asof_join_split is for
    keys that hold a large share of the rows.
    """
    rows, order = _united(left, right, on, left_time, right_time, columns, direction, ties)
    window = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_right", ignorenulls=True).over(window)
    return _found(rows.withColumn("_found", found), right_time, columns)


def asof_join_split(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], direction: str = "backward", ties: Sequence[str] = ()) -> DataFrame:
    """asof_join for any skew: both sides are sorted into ranges of key and time, and the value at the end of a range is
    carried over its edge. What is carried is a row for each range; keys must not be null.
    """
    from tidemark.sources.interim import written

    rows, order = _united(left, right, on, left_time, right_time, columns, direction, ties)
    ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = [*(F.asc(c) for c in on), *order]
    held = written(rows.repartitionByRange(ranges, *keyed).sortWithinPartitions(*keyed).withColumn("_m", F.monotonically_increasing_id()))
    held = held.withColumn("_part", F.shiftright("_m", 33))
    key = F.struct(*on)
    edges = held.groupBy("_part").agg(F.min_by(key, "_m").alias("_first"), F.max_by(key, "_m").alias("_last"))
    tails = held.filter(F.col("_right").isNotNull()).groupBy("_part", *on).agg(F.max_by("_right", "_m").alias("_tail"))
    ends = edges.join(tails.select("_part", key.alias("_last"), "_tail"), ["_part", "_last"]).select(F.col("_part").alias("_from"), F.col("_last").alias("_first"), "_tail")
    # a row for each range on either side; ranges are as many as shuffle partitions
    into = edges.join(F.broadcast(ends), "_first").filter("_from < _part").groupBy("_part", "_first").agg(F.max_by("_tail", "_from").alias("_carried"))
    own = held.withColumn("_first", key).join(F.broadcast(into), ["_part", "_first"], "left")
    window = Window.partitionBy("_part", *on).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_right", ignorenulls=True).over(window), "_carried")
    return _found(own.withColumn("_found", found), right_time, columns)


def _united(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], direction: str, ties: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Rows of both sides, left's whole in _row and right's columns in _right, and the order in which values are carried."""
    payload = F.struct(F.col(right_time).alias("_at"), *columns)
    lefts = left.withColumn("_row", F.struct(*left.columns)).select(*on, F.col(left_time).alias("_t"), F.lit(None).cast(_type(right, payload)).alias("_right"), F.col("_row"), F.lit(1 if direction == "backward" else 0).alias("_side"), *(F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_tie{i}") for i, c in enumerate(ties)))
    rights = right.select(*on, F.col(right_time).alias("_t"), payload.alias("_right"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.lit(0 if direction == "backward" else 1).alias("_side"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)))
    # forward is backward with time turned round, so that either way a running value is carried along
    way = F.asc if direction == "backward" else F.desc
    order = [way(c) for c in ("_t", "_side", *(f"_tie{i}" for i in range(len(ties))))]
    return lefts.unionByName(rights), order


def _found(rows: DataFrame, right_time: str, columns: Sequence[str]) -> DataFrame:
    joined = rows.filter(F.col("_row").isNotNull())
    return joined.select("_row.*", F.col("_found._at").alias(f"matched_{right_time}"), *(F.col(f"_found.{c}").alias(c) for c in columns))


def _type(df: DataFrame, column: Column):
    return df.select(column.alias("x")).schema["x"].dataType


#: A slice of a key's dates is so many times as long as what a tolerance reaches over.
SLICE = 32


def nearest_within(left: DataFrame, right: DataFrame, on: Sequence[str], left_date: Column, right_date: str, days: int, value: str, name: str) -> DataFrame:
    """left with right's value at the date nearest to left_date, at most days away; of two the earlier.

    Both sides are united and sorted within slices of a key's dates, once forwards and once backwards, and the last
    right row on either way is a candidate; no pair of rows is ever formed. A right row near the edge of a slice is in both.
    """
    width = SLICE * (2 * days + 1)
    number = lambda c: F.floor(F.unix_date(c) / width)
    wanted = F.to_date(left_date)
    asked = left.withColumns({"_row": F.lit(True), "_date": wanted, "_slice": number(wanted), "_side": F.lit(1)})
    date = F.to_date(right_date)
    known = right.select(*on, date.alias("_date"), F.struct(date.alias("date"), F.col(value).alias("value")).alias("_right"), F.lit(0).alias("_side"))
    known = known.dropna(subset=[*on, "_date"]).withColumn("_slice", F.explode(F.array_distinct(F.array(number(F.date_sub("_date", days)), number(F.date_add("_date", days))))))
    rows = asked.unionByName(known, allowMissingColumns=True)
    own = Window.partitionBy(*on, "_slice")
    upto = lambda *order: F.last("_right", ignorenulls=True).over(own.orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_before", upto(F.asc("_date"))).withColumn("_after", upto(F.desc("_date"))).filter("_row")
    before, after = F.datediff("_date", "_before.date"), F.datediff("_after.date", "_date")
    best = F.when((before <= days) & ((after >= before) | after.isNull()), F.col("_before.value")).when(after <= days, F.col("_after.value"))
    return rows.select(*left.columns, best.alias(name))


def first_range(value: Column, ranges: Sequence[tuple]) -> Column:
    """The result of the first of the (lo, hi, result) ranges, a lookup table of a few rows, that holds the value."""
    table = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(result).alias("result")) for lo, hi, result in ranges))
    return F.try_element_at(F.filter(table, lambda r: (r.lo <= value) & (value <= r.hi)), F.lit(1))["result"]


def covered(df: DataFrame, day: Column, ranges: DataFrame, name: str = "covered") -> DataFrame:
    """df with whether a range (range_start, range_end) of a short table holds the day; the table is read once, as a scalar."""
    table = ranges.agg(F.collect_list(F.struct("range_start", "range_end"))).scalar()
    held = F.exists("_ranges", lambda r: (r.range_start <= day) & (day <= r.range_end))
    return df.withColumn("_ranges", table).withColumn(name, held).drop("_ranges")
