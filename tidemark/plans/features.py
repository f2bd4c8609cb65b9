"""Feature builds and step reads over whole universes, as single plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fu
from tidemark.operators.asof import first_by, latest_version, within
from tidemark.operators.gate import decide, feature_names, fit_logistic_dates
from tidemark.operators.series import newest_features, over, trailing
from tidemark.operators.sizing import Limits, size_book
from tidemark.operators.xsection import position_percentile, universe_rules
from tidemark.sources.interim import written

PRICE = (
    "return_1m", "return_3m", "return_6m", "momentum_12_1", "sma_20d_distance", "sma_50d_distance", "sma_200d_distance", "realized_vol_20d", "atr_20d_pct",
    "max_drawdown_63d", "volume_zscore_20d", "distance_52w_high",
)
FUNDAMENTAL = ("ev_sales", "ev_ebit", "fcf_yield", "gross_margin_trend", "revenue_growth_yoy", "revenue_growth_3y_cagr", "net_debt_ebitda", "share_count_change", "accruals_ratio")
COUNTS = ("insider_net_open_market_buy_usd_90d", "insider_distinct_buyers_90d", "insider_ceo_cfo_buy_flag_90d", "news_count_zscore_7d", "news_source_diversity_7d")


def newest_price_features(bars: DataFrame) -> DataFrame:
    """Each security's features as of its newest bar."""
    return newest_features(bars).select("security_id", *PRICE)


def build_features(as_of: Column, members: DataFrame, bars: DataFrame, facts: DataFrame, insiders: DataFrame, news: DataFrame, version: str = "fs_v1") -> DataFrame:
    """security_id, event_time, available_at, source_version, values (a map) for the members (security_id, sector, market_cap).

    Every input is read as of the instant: prices of 400 days, insider lines of 90 by their filing, news of 56.
    """
    visible = latest_version(bars, ["security_id", "event_time"], as_of, within("event_time", as_of, "400 days"))
    filed = latest_version(facts, ["security_id", "concept", "unit", "period_start", "period_end"], as_of)
    lines = latest_version(insiders, ["accession", "seq"], as_of)
    items = latest_version(news, ["item_id"], as_of).withColumn("security_id", F.explode("security_ids"))
    recent = fu.recent_values(fu.to_series(filed)).join(members.select("security_id", "market_cap"), "security_id")
    wide = (
        members.select("security_id", "sector").join(newest_price_features(visible), "security_id", "left").join(fu.ratios(recent), "security_id", "left")
        .join(fu.insider_features(lines, as_of), "security_id", "left").join(fu.news_features(items.filter(within("event_time", as_of, "56 days")), as_of), "security_id", "left")
        .fillna(0, list(COUNTS))
    )
    wide = wide.withColumns({f"{n}_sector_percentile": position_percentile(F.col(n), ["sector"]) for n in FUNDAMENTAL})
    names = (*PRICE, *FUNDAMENTAL, *COUNTS, *(f"{n}_sector_percentile" for n in FUNDAMENTAL))
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names)))
    return wide.select("security_id", as_of.alias("event_time"), as_of.alias("available_at"), F.lit(version).alias("source_version"), values.alias("values"))


def step_inputs(facts: DataFrame, bars: DataFrame, securities: DataFrame, as_of: Column) -> DataFrame:
    """securities with the number of visible facts and the 30-bar mean dollar volume, null with fewer bars."""
    seen = latest_version(facts, ["security_id", "day"], as_of).groupBy("security_id").agg(F.count(F.lit(1)).alias("items"))
    tail = first_by(bars, ["security_id"], [F.desc("event_time")], 30)
    volume = tail.groupBy("security_id").agg(F.when(F.count(F.lit(1)) >= 30, F.avg(F.col("close") * F.col("volume"))).alias("adv30"))
    return securities.join(volume, "security_id").join(seen, "security_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def universe_snapshots(snapshot_times: Sequence[tuple[Column, Column]], bars: DataFrame, shares: DataFrame, securities: DataFrame, **rules) -> DataFrame:
    """Universe members of each (snapshot_date, instant): prices of 45 days, 20-bar dollar volume, market value."""
    out = None
    for day, instant in snapshot_times:
        visible = latest_version(bars, ["security_id", "event_time"], instant, within("event_time", instant, "45 days"))
        stats = visible.withColumn("_n", F.count(F.lit(1)).over(trailing(20))).withColumn("_adv", F.avg(F.col("close") * F.col("volume")).over(trailing(20)))
        last = first_by(stats, ["security_id"], [F.desc("event_time")]).select("security_id", F.col("close").alias("price"), F.col("_adv").alias("adv"), F.col("_n").alias("n_bars"))
        held = latest_version(shares, ["security_id", "period_end"], instant).groupBy("security_id").agg(F.max_by("value", "period_end").alias("_shares"))
        one = securities.select("security_id").join(last, "security_id", "left").join(held, "security_id", "left")
        one = one.withColumn("mcap", F.col("price") * F.col("_shares")).withColumn("snapshot_date", day).drop("_shares")
        out = one if out is None else out.unionByName(one)
    return universe_rules(out, **rules)


def walk_forward(features: DataFrame, labelled: DataFrame, dates: Sequence[Column], sectors: DataFrame, volatilities: DataFrame, top_k: int, limits: Limits = Limits()) -> DataFrame:
    """as_of, security_id, score, passed, weight over the dates: at each the gate is fitted on labels that ended
    before it, scores that date's rows, and the passing names are sized. All dates are fitted together. The dates
    are in order of time. Features are written once, as they are named, fitted and scored."""
    features = written(features)
    names = feature_names(features)
    models = fit_logistic_dates(features, labelled, dates, names)
    # a model for each of the dates given, which are a list on the driver
    rows = features.withColumn("as_of", F.col("event_time").cast("string")).join(F.broadcast(models.withColumnRenamed("group", "as_of")), "as_of")
    z = F.zip_with(F.arrays_zip("names", "means", "scales"), "coefficients", lambda m, c: c * (F.coalesce(F.try_element_at(F.col("values"), m.names), m.means) - m.means) / m.scales)
    total = F.col("intercept") + F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    clamped = F.least(F.greatest(total, F.lit(-35.0)), F.lit(35.0))
    scored = rows.withColumn("score", 1 / (1 + F.exp(-clamped))).select("as_of", "security_id", "score")
    decided = decide(scored, top_k, ["as_of"]).join(sectors, "security_id").join(volatilities, ["as_of", "security_id"], "left")
    sized = size_book(decided.withColumn("pooled_p", F.when(F.col("passed"), F.col("score")).otherwise(0.0)).withColumn("dispersion", F.lit(0.0)).withColumn("bear_severity", F.lit("low")), limits, ["as_of"])
    return sized.select("as_of", "security_id", "score", "passed", "weight")


__all__ = ["build_features", "newest_price_features", "over", "step_inputs", "universe_snapshots", "walk_forward"]
