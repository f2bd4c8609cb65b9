"""Books that are matched to another one, and weights that drift with returns between rebalances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_weights(members: DataFrame, period: str = "period") -> DataFrame:
    """period, security_id, weight: one over the period's number of members."""
    n = members.groupBy(period).agg(F.count(F.lit(1)).alias("_n"))
    return members.join(n, period).select(period, "security_id", (1 / F.col("_n")).alias("weight"))


def drifted(targets: DataFrame, returns: DataFrame, bills: DataFrame) -> DataFrame:
    """period, t, security_id, weight, value, drifted: each name's weight as prices move it.

    targets (period, security_id, weight) are set before a period's first t; returns (period, t, security_id, ret);
    bills (period, t, bill) is what cash, one less the weights, earns. value is the book's for 1 at the start of the
    period, drifted the name's share of it. A running product of a name in a period; periods don't touch.
    """
    run = Window.partitionBy("period", "security_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grown = targets.join(returns, ["period", "security_id"]).withColumn("_g", F.exp(F.sum(F.log1p("ret")).over(run)))
    held = grown.groupBy("period", "t").agg(F.sum(F.col("weight") * F.col("_g")).alias("_held"), F.count("ret").alias("_n"), F.sum("weight").alias("_w"))
    due = targets.groupBy("period").agg(F.count(F.lit(1)).alias("_due"), F.sum("weight").alias("_gross"))
    cash_run = Window.partitionBy("period").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a period's few times
    cash = bills.withColumn("_c", F.exp(F.sum(F.log1p("bill")).over(cash_run)))
    value = F.col("_held") + (1 - F.col("_gross")) * F.col("_c")
    # a name without a return leaves the book without a value from then on
    books = held.join(due, "period").join(cash, ["period", "t"]).withColumn("_short", F.min((F.col("_n") == F.col("_due")).cast("int")).over(cash_run))
    books = books.select("period", "t", F.when(F.col("_short") == 1, value).alias("value"))
    return grown.join(books, ["period", "t"]).select("period", "t", "security_id", "weight", "value", (F.col("weight") * F.col("_g") / F.col("value")).alias("drifted"))


def book_returns(weights: DataFrame) -> DataFrame:
    """period, t, ret of a drifted book; null where a name's return is missing."""
    values = weights.groupBy("period", "t").agg(F.first("value").alias("value"))
    before = F.coalesce(F.lag("value").over(Window.partitionBy("period").orderBy("t")), F.when(F.row_number().over(Window.partitionBy("period").orderBy("t")) == 1, 1.0))
    return values.select("period", "t", (F.col("value") / before - 1).alias("ret"))


def turnover(weights: DataFrame, targets: DataFrame, next_period: Column) -> DataFrame:
    """period, turnover: the sum of |target - drifted weight of the period before|; from cash where there is none.

    next_period gives, from a row's period, the one that follows it.
    """
    last = weights.groupBy("period", "security_id").agg(F.max_by("drifted", "t").alias("_was")).select(next_period.alias("period"), "security_id", "_was")
    periods = targets.select("period").distinct()
    both = targets.join(last.join(periods, "period", "left_semi"), ["period", "security_id"], "full_outer")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0)))
    return both.groupBy("period").agg(F.sum(change).alias("turnover"))


def exposure_matched(gross: DataFrame, index: DataFrame, bills: DataFrame, on: Sequence[str] = ("period",)) -> DataFrame:
    """on, ret: the index at the book's gross exposure, the rest in bills."""
    g = F.col("gross")
    return gross.join(index, list(on)).join(bills, list(on)).select(*on, (g * F.col("index_ret") + (1 - g) * F.col("bill")).alias("ret"))


def sector_matched(book: DataFrame, sector_returns: DataFrame, bills: DataFrame) -> DataFrame:
    """period, ret: the sectors' returns at the book's sector weights, the rest in bills; null if a sector's return is missing."""
    held = book.groupBy("period", "sector").agg(F.sum("weight").alias("_w"))
    joined = held.join(sector_returns, ["period", "sector"], "left")
    sums = joined.groupBy("period").agg(F.sum(F.col("_w") * F.col("sector_ret")).alias("_r"), F.sum("_w").alias("_g"), F.count_if(F.col("sector_ret").isNull()).alias("_none"))
    return sums.join(bills, "period").select("period", F.when(F.col("_none") == 0, F.col("_r") + (1 - F.col("_g")) * F.col("bill")).alias("ret"))
