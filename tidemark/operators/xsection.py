"""Cross-sectional operators: ranks, scores and labels within one as_of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.operators.ranks import with_dense_rank, with_group, with_place

LEAST_GROUP = 3


def position_percentile(value: Column, group: Sequence[str], tie: str = "security_id") -> Column:
    """Place by (value, tie) over max(n - 1, 1) among the finite values of the group."""
    usable = finite(value)
    w = Window.partitionBy(*group, usable.isNull())
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(usable, tie)) - 1
    return F.when(usable.isNotNull(), place / F.greatest(n - 1, F.lit(1)))


def midrank_percentile(value: Column, group: Sequence[str], least: int = 2) -> Column:
    """(values below + half of the other equal ones) / (n - 1); null for fewer than least finite values."""
    usable = finite(value)
    w = Window.partitionBy(*group, usable.isNull())
    n = F.count(F.lit(1)).over(w)
    below = F.rank().over(w.orderBy(usable)) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*group, usable))
    return F.when(usable.isNotNull() & (n >= max(2, least)), (below + 0.5 * (equal - 1)) / (n - 1))


def group_zscore(value: Column, group: Sequence[str], least: int = LEAST_GROUP) -> Column:
    """Population z-score; null for small groups, 0 in one without spread."""
    usable = finite(value)
    w = Window.partitionBy(*group)
    spread = F.stddev_pop(usable).over(w)
    score = F.when(spread == 0, 0.0).otherwise((usable - F.avg(usable).over(w)) / spread)
    return F.when(usable.isNotNull() & (F.count(usable).over(w) >= least), score)


def imputed_zscores(df: DataFrame, names: Sequence[str], group: Sequence[str], low_is_good: Sequence[str] = ()) -> DataFrame:
    """df with each of names as its population z-score, missing values at the mean (0); without spread the scale is 1.

    All means and deviations of a group come from one aggregate, which is joined back.
    """
    usable = {n: finite(F.col(n)) for n in names}
    stats = {f"_{what}{k}": f(c) for k, c in enumerate(usable.values()) for what, f in (("mean", F.avg), ("spread", F.stddev_pop))}
    known = with_group(df, group, stats)
    scores = {}
    for k, (n, c) in enumerate(usable.items()):
        mean, spread = F.col(f"_mean{k}"), F.col(f"_spread{k}")
        scale = F.when(spread > 0, spread).otherwise(1.0)
        scores[n] = F.coalesce((-1.0 if n in low_is_good else 1.0) * ((F.coalesce(c, mean) - mean) / scale), F.lit(0.0))
    return known.withColumns(scores).drop(*stats)


def top_share(df: DataFrame, score: Column, group: Sequence[str], share: float, tie: str, name: str) -> DataFrame:
    """df with whether the row is in the group's best ceil(n * share), ties to the smaller tie."""
    w = Window.partitionBy(*group)
    place = F.row_number().over(w.orderBy(F.desc("_score"), tie))
    marked = df.withColumn("_score", score).withColumn("_place", place).withColumn("_n", F.count(F.lit(1)).over(w))
    return marked.withColumn(name, F.col("_place") <= F.ceil(F.col("_n") * share)).drop("_score", "_place", "_n")


def tercile_labels(returns: DataFrame) -> DataFrame:
    """returns (feature_time, security_id, sector, ret, label_end) with is_top_tercile of |ret - the sector's mean|."""
    relative = F.abs(F.col("ret") - F.avg("ret").over(Window.partitionBy("feature_time", "sector")))
    scored = returns.withColumn("relative", relative)
    w = Window.partitionBy("feature_time")
    place = F.row_number().over(w.orderBy(F.desc("relative"), "security_id"))
    n = F.count(F.lit(1)).over(w)
    # 3 * place < n + 3 is place <= ceil(n / 3) in whole numbers
    return scored.withColumn("_place", place).withColumn("_n", n).withColumn("is_top_tercile", 3 * F.col("_place") < F.col("_n") + 3).drop("_place", "_n")


def tier(market_cap: Column) -> Column:
    return F.when(market_cap < 2e9, "small").when(market_cap < 10e9, "mid").when(market_cap.isNotNull(), "large")


def universe_rules(candidates: DataFrame, *, price_min: float, cap_min: float, cap_max: float, volume_min: float, top_n: int, days: int = 20, group: Sequence[str] = ("snapshot_date",)) -> DataFrame:
    """candidates (security_id, price, adv, n_bars, mcap) with rank, included, reason, tier and score.

    Every candidate stays, with the first rule that it fails; the passing ones are ranked by adv.
    """
    reason = (
        F.when(F.col("price").isNull(), "no_price")
        .when(F.col("n_bars") < days, "insufficient_history")
        .when(F.col("price") < price_min, "price")
        .when(F.col("mcap").isNull(), "no_shares")
        .when(~F.col("mcap").between(cap_min, cap_max), "mcap")
        .when(F.col("adv") < volume_min, "adv")
        .otherwise("ok")
    )
    ruled = candidates.withColumn("reason", reason)
    placed = with_place(ruled.filter("reason = 'ok'"), group, [F.desc_nulls_last("adv"), F.asc("security_id")], "rank")
    ranked = placed.unionByName(ruled.filter("reason <> 'ok'").withColumn("rank", F.lit(None).cast("long")))
    included = F.coalesce(F.col("rank") <= top_n, F.lit(False))
    return ranked.withColumns({
        "included": included,
        "mcap_tier": tier(F.col("mcap")),
        "score": F.when(F.col("adv") > 0, F.log("adv")),
        "reason": F.when(included, "included").when(F.col("reason") == "ok", "rank").otherwise(F.col("reason")),
    })


def entity_tokens(df: DataFrame, order: str, group: Sequence[str], name: str = "token", prefix: str = "TICKER") -> DataFrame:
    """df with a token by the rank of order among the group's distinct values."""
    ranked = with_dense_rank(df, group, order, "_place")
    return ranked.withColumn(name, F.format_string(f"{prefix}_%02d", "_place")).drop("_place")


#: Sector of a SIC code: (lo, hi, sector), the first that holds it. Fixed values.
SIC_SECTORS = (
    (1300, 1399, "Energy"), (2830, 2836, "Health Care"), (2840, 2844, "Consumer Staples"), (2900, 2999, "Energy"),
    (3100, 3199, "Consumer Discretionary"), (3570, 3579, "Information Technology"), (3630, 3639, "Consumer Discretionary"),
    (3710, 3716, "Consumer Discretionary"), (3840, 3851, "Health Care"), (5120, 5122, "Health Care"), (5140, 5149, "Consumer Staples"),
    (5400, 5499, "Consumer Staples"), (5912, 5912, "Consumer Staples"), (6500, 6553, "Real Estate"), (6798, 6798, "Real Estate"),
    (7370, 7379, "Information Technology"), (100, 999, "Consumer Staples"), (1000, 1499, "Materials"), (1500, 1799, "Industrials"),
    (2000, 2199, "Consumer Staples"), (2200, 2399, "Consumer Discretionary"), (2400, 2699, "Materials"), (2700, 2799, "Communication Services"),
    (2800, 2899, "Materials"), (3000, 3499, "Materials"), (3500, 3599, "Industrials"), (3600, 3699, "Information Technology"),
    (3700, 3799, "Industrials"), (3800, 3899, "Information Technology"), (3900, 3999, "Consumer Discretionary"), (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"), (4900, 4999, "Utilities"), (5000, 5199, "Industrials"), (5200, 5999, "Consumer Discretionary"),
    (6000, 6799, "Financials"), (7000, 7299, "Consumer Discretionary"), (7300, 7399, "Industrials"), (7800, 7999, "Communication Services"),
    (8000, 8099, "Health Care"), (8700, 8799, "Industrials"),
)


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Rows of a crosswalk (lo, hi) whose range starts before an earlier one ended."""
    w = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_end", F.max("hi").over(w)).filter(F.col("_end") >= F.col("lo")).drop("_end")
