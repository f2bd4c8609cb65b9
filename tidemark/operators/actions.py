"""Corporate actions: adjusted prices as of an instant, and returns over horizons that actions fall into.

An action (action_id, security_id, ex_date, kind, rate, available_at, source_version, withdrawn) is a versioned
fact. Prices are stored raw; every factor is made from the versions that the reader can see, so that a late
correction reprices the past only for later readers. A security has at most a bar a day, which bounds what one
window sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import at_dates

# Kinds of actions by what they do. Fixed values.
SPLITS = ("forward_split", "reverse_split")
CASH = ("cash_dividend", "capital_gains_distribution")
SHARES = ("stock_dividend",)
TERMINAL = ("cash_merger", "stock_merger", "stock_and_cash_merger", "redemption", "worthless_removal")
UNINTERPRETED = ("unit_split", "spin_off", "rights_distribution", "partial_call", "reorganization")
#: The share of its last price that a removal of unknown terms is taken to pay.
DEFAULT_RECOVERY = 0.7


def share_factor(kind: Column, rate: Column) -> Column:
    """Shares after the action for one before it."""
    return F.when(kind.isin(*SPLITS), rate).when(kind.isin(*SHARES), 1 + rate).otherwise(1.0)


def cash_per_share(kind: Column, rate: Column) -> Column:
    return F.when(kind.isin(*CASH), rate).otherwise(0.0)


def visible_actions(actions: DataFrame, dates: Sequence[Column]) -> DataFrame:
    """as_of and each action's newest version that is visible then, without withdrawn ones."""
    return at_dates(actions, dates, ["action_id"]).filter(~F.coalesce("withdrawn", F.lit(False)))


def _daily(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key and day: the day's share factor, cash per share held after it, and uninterpreted actions."""
    kind, rate = F.col("kind"), F.col("rate")
    return actions.filter(~kind.isin(*TERMINAL)).groupBy(*keys, F.col("ex_date").alias("day")).agg(
        F.product(share_factor(kind, rate)).alias("_shares"), F.sum(cash_per_share(kind, rate)).alias("_cash"), F.count_if(kind.isin(*UNINTERPRETED)).alias("_unknown")
    )


def adjusted_prices(bars: DataFrame, actions: DataFrame, dates: Sequence[Column]) -> DataFrame:
    """as_of, security_id, day, close, split_close, total_close for each of the dates and the bars up to it.

    Factors multiply backwards over the actions after a bar: one over the day's share factor, and for the
    total return also one less the day's cash over the last close before it (in shares after that day's split). A price is
    null before cash that is no less than the price it was paid from.
    """
    keys = ["as_of", "security_id"]
    seen = F.filter(F.array(*dates), lambda d: F.to_date("day") <= F.to_date(d))
    rows = bars.withColumn("as_of", F.explode(seen)).select(*keys, "day", "close", F.lit(1).alias("_side"))
    events = _daily(visible_actions(actions, dates), keys).select(*keys, "day", "_shares", "_cash", F.lit(0).alias("_side"))
    line = rows.unionByName(events, allowMissingColumns=True)
    forward = Window.partitionBy(*keys).orderBy("day", "_side")
    before = F.last("close", ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("_before", before)
    left = F.when(F.col("_cash") == 0, 1.0).otherwise(1 - F.col("_cash") * F.col("_shares") / F.col("_before"))
    left = F.when(F.col("_before").isNull(), 1.0).otherwise(left)  # nothing before it to adjust
    line = line.withColumn("_split", -F.log("_shares")).withColumn("_left", left).withColumn("_lost", (F.col("_left") <= 0).cast("int"))
    line = line.withColumn("_total", F.col("_split") + F.when(F.col("_left") > 0, F.log("_left")).otherwise(0.0))
    # what comes after a bar is the whole less what comes up to it, so that one order, and one sort, serves both ways
    upto, whole = (forward.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    after = lambda c: F.coalesce(F.sum(c).over(whole), F.lit(0)) - F.coalesce(F.sum(c).over(upto), F.lit(0))
    placed = line.withColumns({"split_close": F.col("close") * F.exp(after("_split")), "total_close": F.when(after("_lost") == 0, F.col("close") * F.exp(after("_total")))})
    return placed.filter("_side = 1").select(*keys, "day", "close", "split_close", "total_close")


def horizon_returns(bars: DataFrame, actions: DataFrame, horizon: int) -> DataFrame:
    """security_id, day, end_day, ret, source, reason: the return from each bar to the horizon-th after it.

    ret is (exit price times the shares that one became, plus the cash received) / entry price - 1; an action counts if
    entry day < ex_date <= exit day, cash of a day being paid on the shares after that day's split. Where bars end
    before the horizon a terminal action stands in for the exit: its cash, nothing for a worthless removal, or a
    DEFAULT_RECOVERY of the last close where its terms are missing; source says which. Without a return, reason is
    `no_exit`, `uninterpreted` (such an action lies between) or `acquirer` (paid in shares of another security). Nothing is
    ever filled forward.

    actions are visible ones. Running sums stand at each bar, so that no bar meets an action in a join.
    """
    kind, rate = F.col("kind"), F.col("rate")
    terminal = actions.filter(kind.isin(*TERMINAL)).groupBy("security_id").agg(F.min_by(F.struct("ex_date", "kind", "rate"), "ex_date").alias("_end"))
    events = _daily(actions, ["security_id"]).withColumn("_side", F.lit(0))
    rows = bars.select("security_id", "day", "close").withColumn("_side", F.lit(1))
    line = rows.unionByName(events, allowMissingColumns=True).join(terminal, "security_id", "left")
    w = Window.partitionBy("security_id").orderBy("day", "_side")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_c", F.exp(F.coalesce(F.sum(F.log("_shares")).over(upto), F.lit(0.0))))
    line = line.withColumn("_k", F.coalesce(F.sum(F.col("_cash") * F.col("_c")).over(upto), F.lit(0.0))).withColumn("_u", F.coalesce(F.sum("_unknown").over(upto), F.lit(0)))
    whole = Window.partitionBy("security_id")
    reached = (F.col("day") <= F.col("_end.ex_date")) | F.col("_end").isNull()
    last = F.max_by(F.struct("_c", "_k", "_u"), F.when(reached, F.struct("day", "_side"))).over(whole)
    line = line.withColumn("_last", last).withColumn("_last_close", F.max_by("close", F.when(F.col("_side") == 1, F.col("day"))).over(whole))
    own = line.filter("_side = 1")
    at = lambda c: F.lead(c, horizon).over(Window.partitionBy("security_id").orderBy("day"))
    own = own.withColumns({"_exit_day": at("day"), "_exit": at("close"), "_exit_c": at("_c"), "_exit_k": at("_k"), "_exit_u": at("_u")})
    end_kind, end_rate = F.col("_end.kind"), F.col("_end.rate")
    ended = F.col("_exit_day").isNull() & (F.col("_end.ex_date") > F.col("day"))
    source = F.when(~ended, "bar").when(end_kind == "worthless_removal", "worthless").when(end_kind.isin("cash_merger", "redemption") & end_rate.isNotNull(), "consideration").when(end_kind.isin("cash_merger", "redemption"), "default")
    pick = lambda exit_, last_: F.when(ended, F.col(f"_last.{last_}")).otherwise(F.col(exit_))
    price = F.when(~ended, F.col("_exit")).when(source == "worthless", 0.0).when(source == "consideration", end_rate).when(source == "default", DEFAULT_RECOVERY * F.col("_last_close"))
    own = own.withColumns({"source": source, "_price": price, "_c1": pick("_exit_c", "_c"), "_k1": pick("_exit_k", "_k"), "_u1": pick("_exit_u", "_u"), "end_day": F.when(ended, F.col("_end.ex_date")).otherwise(F.col("_exit_day"))})
    reason = F.when(F.col("end_day").isNull(), "no_exit").when(F.col("_u1") > F.col("_u"), "uninterpreted").when(F.col("source").isNull(), "acquirer").when(F.col("close") <= 0, "no_entry")
    ret = (F.col("_price") * F.col("_c1") + F.col("_k1") - F.col("_k")) / (F.col("close") * F.col("_c")) - 1
    own = own.withColumn("reason", reason)
    clean = F.col("reason").isNull()
    return own.select("security_id", "day", "end_day", F.when(clean, ret).alias("ret"), F.when(clean, F.col("source")).alias("source"), "reason")
