"""Ratios of as-filed facts, insider and news features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import fiscal_index, is_quarterly
from tidemark.functions.numbers import cube_root_growth, safe_div
from tidemark.operators.asof import first_by, nearest_within
from tidemark.operators.series import latest_week_z, weekly_counts

#: Concepts of each series, the first that a security has any row of is used. Fixed values.
CONCEPTS = {
    "revenue": ("us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:SalesRevenueNet", "us-gaap:Revenues"),
    "gross_profit": ("us-gaap:GrossProfit",),
    "operating_income": ("us-gaap:OperatingIncomeLoss",),
    "net_income": ("us-gaap:NetIncomeLoss",),
    "cash": ("us-gaap:CashAndCashEquivalentsAtCarryingValue",),
    "debt": ("us-gaap:LongTermDebtAndFinanceLeaseObligationsCurrent", "us-gaap:LongTermDebtCurrent"),
    "long_debt": ("us-gaap:LongTermDebtAndFinanceLeaseObligationsNoncurrent", "us-gaap:LongTermDebtNoncurrent"),
    "shares": ("dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStocksIncludingAdditionalPaidInCapital"),
    "assets": ("us-gaap:Assets",),
    "current_assets": ("us-gaap:AssetsCurrent",),
    "cash_flow": ("us-gaap:NetCashProvidedByUsedInOperatingActivities",),
    "capex": ("us-gaap:PaymentsToAcquirePropertyPlantAndEquipment",),
    "da": ("us-gaap:DepreciationDepletionAndAmortization",),
}


def to_series(facts: DataFrame, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """facts with a column series, each security's series from its first concept that has any row."""
    place = F.create_map(*(F.lit(x) for name, aliases in concepts.items() for k, c in enumerate(aliases) for x in (c, f"{name}:{k}")))
    named = facts.withColumn("_alias", place[F.col("concept")]).filter(F.col("_alias").isNotNull())
    named = named.withColumn("series", F.substring_index("_alias", ":", 1)).withColumn("_order", F.substring_index("_alias", ":", -1).cast("int"))
    best = F.min("_order").over(Window.partitionBy("security_id", "series"))
    return named.withColumn("_best", best).filter(F.col("_order") == F.col("_best")).drop("_alias", "_order", "_best")


def recent_values(series: DataFrame, depth: int = 13) -> DataFrame:
    """security_id and for each series an array of its values, the newest first, depth at most."""
    newest = first_by(series, ["security_id", "series"], [F.desc("period_end"), F.desc("available_at")], depth)
    packed = newest.groupBy("security_id", "series").agg(F.reverse(F.array_sort(F.collect_list(F.struct("period_end", "available_at", "value")))).alias("v"))
    return packed.groupBy("security_id").agg(*(F.max(F.when(F.col("series") == s, F.col("v.value"))).alias(s) for s in CONCEPTS))


def ratios(recent: DataFrame) -> DataFrame:
    """security_id and the fundamental features from recent_values and a column market_cap.

    Growth goes by position in the series; missing cash, debt and depreciation count as 0.
    """
    at = lambda s, k=1: F.try_element_at(F.col(s), F.lit(k))
    zero = lambda s: F.coalesce(at(s), F.lit(0.0))
    cap = F.col("market_cap")
    debt = zero("debt") + zero("long_debt")
    value = cap + debt - zero("cash")
    free_cash = at("cash_flow") - at("capex")
    ebitda = at("operating_income") + zero("da")
    tails = [F.reverse(F.slice(F.col(s), 1, 5)) for s in ("gross_profit", "revenue")]
    margins = F.filter(F.transform(F.arrays_zip(*tails), lambda x: safe_div(x["0"], x["1"])), lambda m: m.isNotNull())
    trend = F.when(F.size(margins) >= 2, F.element_at(margins, -1) - F.element_at(margins, 1))
    return recent.select(
        "security_id",
        safe_div(value, at("revenue")).alias("ev_sales"),
        safe_div(value, at("operating_income")).alias("ev_ebit"),
        safe_div(free_cash, cap).alias("fcf_yield"),
        trend.alias("gross_margin_trend"),
        (safe_div(at("revenue"), at("revenue", 5)) - 1).alias("revenue_growth_yoy"),
        cube_root_growth(safe_div(at("revenue"), at("revenue", 13))).alias("revenue_growth_3y_cagr"),
        safe_div(debt - zero("cash"), ebitda).alias("net_debt_ebitda"),
        (safe_div(at("shares"), at("shares", 5)) - 1).alias("share_count_change"),
        safe_div(at("net_income") - at("cash_flow"), at("assets")).alias("accruals_ratio"),
    )


def quarterly_history(facts: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """security_id, label (Q-n), period_end and ratios of each quarter, the newest most.

    Year-to-date rows are left out before the newest version of a (concept, period_end) is chosen.
    """
    visible = facts.filter((F.col("available_at") <= as_of) & is_quarterly(F.col("period_start"), F.col("period_end")))
    latest = first_by(visible, ["security_id", "concept", "period_end"], [F.desc("available_at"), F.desc("source_version")])
    wide = to_series(latest).groupBy("security_id", "period_end").agg(*(F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in ("revenue", "gross_profit", "operating_income", "net_income", "cash_flow", "assets", "shares")))
    year_before = F.date_sub("period_end", 365)
    for name in ("revenue", "shares"):
        wide = nearest_within(wide, wide.filter(F.col(name).isNotNull()).select("security_id", F.col("period_end").alias("_end"), F.col(name).alias("_v")), ["security_id"], year_before, "_end", 10, "_v", f"{name}_before")
    labelled = wide.filter(F.col("revenue").isNotNull()).withColumn("label", fiscal_index(F.col("period_end"), as_of)).filter(F.col("label").isNotNull())
    newest = first_by(labelled, ["security_id"], [F.desc("period_end")], most)
    growth = lambda now, before: F.when(F.col(before) != 0, F.col(now) / F.col(before) - 1)
    return newest.select(
        "security_id", "label", "period_end",
        *(safe_div(F.col(s), F.col("revenue")).alias(n) for s, n in (("gross_profit", "gross_margin"), ("operating_income", "operating_margin"), ("net_income", "net_margin"), ("cash_flow", "cfo_margin"))),
        growth("revenue", "revenue_before").alias("revenue_growth_yoy"),
        growth("shares", "shares_before").alias("share_change_yoy"),
        safe_div(F.col("net_income") - F.col("cash_flow"), F.col("assets")).alias("accruals_ratio"),
    )


def insider_features(txns: DataFrame, as_of: Column) -> DataFrame:
    """Open-market purchases of the last 90 days by the time they became known; plan trades don't count."""
    title = F.upper(F.coalesce("officer_title", F.lit("")))
    chief = (F.col("role") == "officer") & title.rlike("CEO|CFO|CHIEF EXECUTIVE|CHIEF FINANCIAL")
    buys = txns.filter((F.col("available_at") <= as_of) & (F.col("available_at") > as_of - F.expr("interval 90 days")) & (F.col("code") == "P") & F.col("acquired") & ~F.col("is_10b5_1"))
    return buys.groupBy("security_id").agg(
        F.sum(F.col("shares") * F.coalesce("price", F.lit(0.0))).alias("insider_net_open_market_buy_usd_90d"),
        F.count_distinct("filer").alias("insider_distinct_buyers_90d"),
        F.max(chief.cast("int")).alias("insider_ceo_cfo_buy_flag_90d"),
    )


def news_features(items: DataFrame, as_of: Column) -> DataFrame:
    """items: one row for each (security_id, item). Diversity has no upper bound in time."""
    z = weekly_counts(items, "security_id", as_of).select("security_id", latest_week_z().alias("news_count_zscore_7d"))
    recent = items.filter(F.col("event_time") > as_of - F.expr("interval 7 days"))
    width = recent.groupBy("security_id").agg(F.count_distinct("publisher").alias("d"))
    return z.join(width, "security_id", "left").select("security_id", "news_count_zscore_7d", F.coalesce("d", F.lit(0)).alias("news_source_diversity_7d"))


def trade_tags(txns: DataFrame, years: int = 3, history: DataFrame | None = None, span: tuple[Column, Column] | None = None) -> DataFrame:
    """txns with tag: ROUTINE if the filer traded in that month of each of the prior years, UNKNOWN if the
    security's history is too short to tell, else OPPORTUNISTIC.

    history has all trades by which txns are judged, txns themselves by default. Of it only the months that lie years before
    those of span, which is of some decades at most, are looked at, if all of txns have their day in span: a bit for each year.
    """
    history = txns if history is None else history
    month = lambda d: F.year(d) * 12 + F.month(d)
    now = month(F.col("txn_date"))
    known = history.filter(F.col("code").isin("P", "S"))
    key = ["security_id", "filer"]
    if span is None:
        traded = known.groupBy(*key).agg(F.collect_set(now).alias("_months"))
        months = F.coalesce("_months", F.array().cast("array<int>"))
        routine = F.forall(F.array(*(now - 12 * k for k in range(1, years + 1))), lambda m: F.array_contains(months, m))
    else:
        low, high = map(month, span)
        turn = F.pmod(high - now, F.lit(12))
        back = F.floor((high - now) / 12).cast("int")
        shift = lambda bits, by: F.call_function("shiftleft", F.lit(bits).cast("long"), by)
        key.append("_turn")
        known = known.filter(now.between(low - 12 * years, high - 12) & (turn <= high - low))
        traded = known.withColumn("_turn", turn).groupBy(*key).agg(F.bit_or(shift(1, back)).alias("_months"))
        txns = txns.withColumn("_turn", turn)
        asked = shift(2**years - 1, back + 1)
        routine = F.coalesce("_months", F.lit(0)).bitwiseAND(asked) == asked
    first = history.groupBy("security_id").agg(F.min("txn_date").alias("_first"))
    joined = txns.join(traded, key, "left").join(first, "security_id")
    covered = F.col("_first") <= F.add_months(F.trunc("txn_date", "month"), -12 * years)
    return joined.withColumn("tag", F.when(routine, "ROUTINE").when(covered, "OPPORTUNISTIC").otherwise("UNKNOWN")).drop("_months", "_first", "_turn")


def buyer_clusters(txns: DataFrame, days: int = 14, history: DataFrame | None = None, span: tuple[Column, Column] | None = None) -> DataFrame:
    """txns with cluster: distinct buyers within days of the trade, either way; 0 where its day or security is null.

    A buyer comes in days before a purchase and goes out days after it, or where the next one comes in; a running sum
    over a security's days counts who is in. No trade meets a buyer, and no set of buyers is made. history has all
    trades that count, txns themselves by default; of it only those within days of span, if all of txns have their day in span.
    """
    bought = (txns if history is None else history).filter((F.col("code") == "P") & F.col("acquired")).filter("filer is not null")
    if span is not None:
        bought = bought.filter(F.col("txn_date").between(F.date_sub(span[0], days), F.date_add(span[1], days)))
    bought = bought.select("security_id", "filer", F.unix_date("txn_date").alias("_day")).filter("_day is not null").distinct()
    bought = bought.withColumn("_next", F.lead("_day").over(Window.partitionBy("security_id", "filer").orderBy("_day")))
    moves = F.array(F.struct((F.col("_day") - days).alias("_day"), F.lit(1).alias("_n")), F.struct(F.least(F.col("_day") + days + 1, F.col("_next") - days).alias("_day"), F.lit(-1).alias("_n")))
    steps = bought.select("security_id", F.inline(moves)).unionByName(txns.select("security_id", F.unix_date("txn_date").alias("_day"), F.lit(0).alias("_n")))
    # a row for each security and day
    daily = steps.groupBy("security_id", "_day").agg(F.sum("_n").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy("security_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    counted = daily.select("security_id", F.date_from_unix_date("_day").alias("txn_date"), running.cast("int").alias("cluster"))
    out = txns.join(counted, ["security_id", "txn_date"], "left")
    return out.select(*txns.columns, F.coalesce("cluster", F.lit(0)).alias("cluster"))


def position_change(shares: Column, acquired: Column, held_after: Column) -> Column:
    before = F.when(acquired, held_after - shares).otherwise(held_after + shares)
    return F.when(before > 0, shares / before)


def volume_intensity(shares: Column, price: Column, adv: Column) -> Column:
    return F.when(adv > 0, shares * price / adv)


def in_news(as_of: Column, days: int = 30) -> Column:
    """Whether an item is of the last days."""
    return (F.col("event_time") <= as_of) & (F.col("event_time") >= as_of - F.expr(f"interval {days} days"))


def visible_news(news: DataFrame, as_of: Column, analyst: Column, days: int = 30, most: int = 10) -> DataFrame:
    """Each item's newest visible revision, of the last days, without analyst items, the newest most of a security."""
    latest = first_by(news.filter(F.col("available_at") <= as_of), ["security_id", "item_id"], [F.desc("available_at")])
    recent = latest.filter(in_news(as_of, days) & ~analyst)
    return first_by(recent, ["security_id"], [F.desc("event_time"), F.desc("item_id")], most)
